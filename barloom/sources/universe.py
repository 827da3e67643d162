"""Symbol lists and the small tables that describe symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import DEFAULT_SYMBOLS, FUNDAMENTALS, KEY, SECTOR_ETF, SYMBOL_SECTOR


def _clean(name: str) -> F.Column:
    return F.upper(F.trim(F.col(name)))


def without_caret(name: str | F.Column) -> F.Column:
    """Index symbols without the caret some vendors put before them."""
    return F.ltrim(F.col(name) if isinstance(name, str) else name, F.lit("^"))


def symbols_from_file(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, trimmed and upper-cased, blanks dropped, first mention wins: ``(Symbol, pos)``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "part"))
    return first_mention(lines.select("pos", _clean("part").alias(KEY)).filter(F.col(KEY) != ""))


def joined_symbols(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ordered ``(Symbol, pos)`` lists, one after the other, first mention wins."""
    last = first.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last")).scalar()
    return first_mention(first.union(second.select(KEY, (F.col("pos") + 1 + last).alias("pos"))))


def symbols_from_text(spark: SparkSession, text: str) -> DataFrame:
    """A comma list in its order, first mention wins: ``(Symbol, pos)``."""
    row = spark.createDataFrame([(text,)], "value string")
    parts = row.select(F.posexplode(F.split("value", ",")).alias("pos", "part"))
    return first_mention(parts.select("pos", _clean("part").alias(KEY)).filter(F.col(KEY) != ""))


def symbols_from_list(spark: SparkSession, symbols: Sequence[str] | None = None) -> DataFrame:
    """Given symbols (the default universe when none) in order, each once."""
    names = DEFAULT_SYMBOLS if symbols is None else symbols
    return spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(names))], f"{KEY} string, pos int")


def first_mention(symbols: DataFrame) -> DataFrame:
    """Ordered de-duplication of ``(Symbol, pos)``: the smallest position stays."""
    return symbols.groupBy(KEY).agg(F.min("pos").alias("pos"))


def sector_table(spark: SparkSession) -> DataFrame:
    """The fixed ``(Symbol, Sector)`` assignment."""
    return spark.createDataFrame(list(SYMBOL_SECTOR.items()), f"{KEY} string, Sector string")


def sector_etf_table(spark: SparkSession) -> DataFrame:
    """The fixed ``(Sector, ETF)`` assignment."""
    return spark.createDataFrame(list(SECTOR_ETF.items()), "Sector string, ETF string")


def normalize_fundamentals(raw: DataFrame) -> DataFrame:
    """Seven snapshot values per symbol; market value in billions."""

    def given(name):
        return F.col(name).cast("double") if name in raw.columns else F.lit(None).cast("double")

    values = {name: given(name) for name in FUNDAMENTALS}
    values["Market_Cap_B"] = F.coalesce(given("marketCap"), F.lit(0.0)) / 1e9
    values["Dividend_Yield"] = F.coalesce(values["Dividend_Yield"], F.lit(0.0))
    return raw.select(KEY, *[v.alias(k) for k, v in values.items()])
