"""Places of values among sorted edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_place(rows: DataFrame, name: str, edges: str, most: int, passed: Callable[[Column], Column]) -> DataFrame:
    """``rows`` plus ``name``: how many elements of the ascending array column ``edges`` are ``passed``.

    ``passed`` holds for a prefix of the array, which has at most ``most`` elements. Every step is a projection of its own that halves what
    is left, all of them compiled; a lambda over the array would be interpreted once per element and row.
    """
    place = rows.withColumn(name, F.lit(0))
    for k in reversed(range(most.bit_length())):
        reached = passed(F.get(F.col(edges), F.col(name) + F.lit((1 << k) - 1)))  # unknown beyond the end
        place = place.withColumn(name, F.col(name) + F.when(reached, F.lit(1 << k)).otherwise(F.lit(0)))
    return place
