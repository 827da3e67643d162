"""Reading market context: closes of indices and funds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.schema import CONTEXT_SYMBOLS, TIME
from barloom.sources.bars import between
from barloom.sources.universe import without_caret


def normalize_context(raw: DataFrame, start=None, end=None, symbols: Sequence[str] = tuple(CONTEXT_SYMBOLS)) -> DataFrame:
    """``(ctx_symbol, Date, Close)`` of the wanted series with ``start <= Date < end``.

    Symbols are compared and returned without a leading caret. Both spellings of a name and the bounds are plain comparisons
    of columns, so they reach the scan. A day given twice for one series keeps the spelling without caret, then the larger
    close; a close that is no finite number is NULL; series that are not there are left out.
    """
    names = [s.lstrip("^") for s in symbols]
    wanted = between(raw, start, end).filter(F.col("ctx_symbol").isin(*names, *[f"^{s}" for s in names]))
    close = W.finite(F.col("Close").cast("double"))
    rows = wanted.select(without_caret("ctx_symbol").alias("ctx_symbol"), F.col(TIME).cast("date").alias(TIME), close.alias("Close"), F.col("ctx_symbol").startswith("^").alias("_caret"))
    best = F.struct(~F.col("_caret"), "Close")
    return rows.filter(F.col(TIME).isNotNull()).groupBy("ctx_symbol", TIME).agg(F.max_by("Close", best).alias("Close"))


def read_context(spark: SparkSession, path: str, start=None, end=None, symbols: Sequence[str] = tuple(CONTEXT_SYMBOLS), format: str = "parquet") -> DataFrame:
    """Context closes from a Parquet or CSV table with ``ctx_symbol``, ``Date`` and ``Close``, filtered at the scan."""
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).schema(f"ctx_symbol string, {TIME} date, Close double").option("enforceSchema", False)
    return normalize_context(reader.format(format).load(path), start, end, symbols)
