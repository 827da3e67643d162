"""Columns worked out in Python from whole symbols, beside rows that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import KEY, TIME
from barloom.session import spread

INPUTS = ["Open", "High", "Low", "Close", "Volume"]
HELD = 1 << 16  # bars gathered before whole symbols are worked on


def whole_symbols(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches, gathered and cut anew between symbols, with the bounds of the symbols.

    The symbol at the end waits for its next rows. What is held is ``HELD`` bars and one symbol, at
    most one bar per day of history.
    """
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size < HELD:
            continue
        rows = pd.concat(held, ignore_index=True)
        starts = _starts(rows)
        if starts[-1]:
            yield rows.iloc[: starts[-1]], starts
        held, size = [rows.iloc[starts[-1] :]], len(rows) - starts[-1]
    if size:
        rows = pd.concat(held, ignore_index=True)
        yield rows, np.append(_starts(rows), len(rows))


def _starts(rows: pd.DataFrame) -> np.ndarray:
    key = rows[KEY].to_numpy()
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])


def with_columns_of_symbols(
    bars: DataFrame, names: list[str], work: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]], placed: bool = False
) -> DataFrame:
    """``bars`` plus double columns that ``work`` makes of whole symbols in date order and their bounds; NaN becomes NULL.

    The rows are partitioned and sorted by symbol and date once; only the inputs pass through Python, as a stream beside
    the rows, whatever other columns there are. ``placed`` says that the bars are already partitioned by symbol. Spark does not know
    the partitioning of rows with Python columns, so windows that follow shuffle once more. The stream depends on the
    order of rows, hence it is not deterministic for the optimizer, which keeps filters above it.
    """
    schema = ", ".join(f"`{n}` double" for n in names)

    @F.pandas_udf(schema)
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole_symbols(batches):
            found = work(rows, bounds)
            yield pd.DataFrame({n: found[n] for n in names})

    given = [F.unix_date(TIME).alias("day")] + [F.col(c).cast("double").alias(c) for c in INPUTS if c in bars.columns]
    ordered = (bars if placed else spread(bars, KEY)).sortWithinPartitions(KEY, TIME)
    made = stream.asNondeterministic()(F.struct(F.col(KEY).alias(KEY), *given)).alias("_made")
    held = [c for c in bars.columns if c not in names]
    return ordered.select(*held, made).select(*held, *[F.col(f"_made.`{n}`").alias(n) for n in names])
