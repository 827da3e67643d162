"""Row filters and value filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.schema import KEY


def finite_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL for infinities and NaN in the named columns."""
    return df.withColumns({c: W.finite(F.col(c)) for c in columns})


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named features in that order; those not there become 0."""
    held = set(df.columns)
    columns = [F.col(f) if f in held else F.lit(0.0).alias(f) for f in features]
    return df.select(*keep, *columns)


def fill_with_mean(df: DataFrame, columns: Sequence[str], key: str = KEY) -> DataFrame:
    """Unknown values become the symbol's mean, or 0 where it has none."""
    own = Window.partitionBy(key)
    return df.select(*[F.coalesce(F.col(c), F.avg(c).over(own), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def row_counts(df: DataFrame) -> DataFrame:
    """Rows per symbol and in all."""
    per_symbol = df.groupBy(KEY).agg(F.count("*").alias("rows"))
    return per_symbol.withColumn("total", per_symbol.agg(F.sum("rows").alias("total")).scalar())
