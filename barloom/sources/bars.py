"""Price bars: normalising, building from ticks, reading by date range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BAR_SCHEMA, KEY, REQUIRED, TIME

_SPELLINGS = {"Adj Close": "Adj_Close", "adjclose": "Adj_Close"}


def normalize_bars(raw: DataFrame, unique: bool = False) -> DataFrame:
    """Bars in ``BAR_SCHEMA`` from a loosely typed table.

    Alternative spellings are renamed, text that is no number becomes NULL, and
    a missing required column raises ``ValueError``. Of columns that share a
    name the first is kept. Pass ``unique=True`` when the source already holds
    one row per symbol and day.
    """
    names = [_SPELLINGS.get(n, n) for n in raw.columns]
    if len(set(names)) < len(names):
        raw = raw.toDF(*[f"c{i}" for i in range(len(names))])
        first = {n: f"c{names.index(n)}" for n in dict.fromkeys(names)}
    else:
        first = dict(zip(names, raw.columns))
    missing = [c for c in [KEY, TIME] + REQUIRED if c not in first]
    if missing:
        raise ValueError(f"missing bar columns: {missing}")
    numbers = {c: _number(_quoted(first[c])) for c in REQUIRED}
    adjusted = _number(_quoted(first["Adj_Close"])) if "Adj_Close" in first else numbers["Close"]
    bars = raw.select(
        _quoted(first[KEY]).cast("string").alias(KEY),
        F.to_date(_quoted(first[TIME])).alias(TIME),
        *[numbers[c].alias(c) for c in ("Open", "High", "Low", "Close")],
        adjusted.alias("Adj_Close"),
        numbers["Volume"].alias("Volume"),
    )
    return bars if unique else one_bar_per_day(bars)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _number(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def one_bar_per_day(bars: DataFrame) -> DataFrame:
    """Fail when a symbol has two bars on one day.

    This is what bounds every per-symbol group by the number of calendar days,
    whatever share of the input one symbol holds. The check is an aggregate
    with map-side combine, so repeated keys collapse before the shuffle.
    """
    values = [c for c in bars.columns if c not in (KEY, TIME)]
    grouped = bars.groupBy(KEY, TIME).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values])
    message = F.concat(F.lit("more than one bar for "), F.col(KEY), F.lit(" on "), F.col(TIME).cast("string"))
    # in a filter, so that no column pruning removes it
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.filter(single).select(KEY, TIME, *values)


def bars_from_ticks(
    ticks: DataFrame,
    symbol: Column,
    date: Column,
    price: Column,
    size: Column,
    order: Sequence[Column],
) -> DataFrame:
    """One bar per symbol and day from single trades.

    ``order`` must be a total order of the trades of a day. All aggregates merge,
    so a symbol with most of the trades shuffles one row per task and day.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    flat = ticks.select(
        symbol.cast("string").alias(KEY), date.cast("date").alias(TIME), price.alias("p"), size.alias("v"), key.alias("k")
    )
    daily = flat.groupBy(KEY, TIME).agg(
        F.min_by("p", "k").alias("Open"),
        F.max("p").alias("High"),
        F.min("p").alias("Low"),
        F.max_by("p", "k").alias("Close"),
        F.sum("v").alias("Volume"),
    )
    return daily.select(KEY, TIME, "Open", "High", "Low", "Close", F.col("Close").alias("Adj_Close"), "Volume")


def wide_to_bars(wide: DataFrame, symbols: Sequence[str], separator: str = "|") -> DataFrame:
    """Long bars from one row per day with columns like ``Open|AAA``.

    One row turns into one per symbol in place, without a shuffle.
    """
    fields = ["Open", "High", "Low", "Close", "Adj_Close", "Volume"]
    held = set(wide.columns)
    missing = [f"{f}{separator}{s}" for s in symbols for f in REQUIRED if f"{f}{separator}{s}" not in held]
    if missing:
        raise ValueError(f"missing bar columns: {missing}")

    def bar(s):
        cells = []
        for f in fields:
            name = f"{f}{separator}{s}"
            source = name if name in held else f"Close{separator}{s}"
            cells.append(_number(_quoted(source)).alias(f))
        return F.struct(F.lit(s).alias(KEY), *cells)

    rows = wide.select(F.to_date(F.col(TIME)).alias(TIME), F.explode(F.array(*[bar(s) for s in symbols])).alias("b"))
    bars = rows.select(f"b.{KEY}", TIME, *[f"b.{f}" for f in fields])
    return bars.filter(F.coalesce(*[F.col(f) for f in REQUIRED]).isNotNull())


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with ``start <= Date < end``; plain comparisons, so they reach the scan."""
    if start is not None:
        df = df.filter(F.col(TIME) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(TIME) < F.lit(end).cast("date"))
    return df


def default_range(days: int = 6 * 365, today: str | None = None) -> tuple[Column, Column]:
    """Start and end of the default history as date columns."""
    end = F.lit(today).cast("date") if today else F.current_date()
    return F.date_sub(end, days), end


def read_bars(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    format: str = "parquet",
    symbols: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """Bars from a Parquet or CSV table, filtered at the scan."""
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True)
    raw = reader.format(format).load(path)
    raw = between(raw, start, end)
    if symbols is not None:
        raw = keep_symbols(raw, symbols)
    return normalize_bars(raw, unique=unique)


def keep_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the wanted symbols."""
    return df.join(symbols.select(KEY), KEY, "left_semi")


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, clustered by symbol so that row-group statistics prune readers."""
    bars.repartitionByRange(KEY, TIME).sortWithinPartitions(KEY, TIME).write.mode(mode).parquet(path)


__all__ = [
    "BAR_SCHEMA",
    "bars_from_ticks",
    "between",
    "default_range",
    "keep_symbols",
    "normalize_bars",
    "one_bar_per_day",
    "read_bars",
    "wide_to_bars",
    "write_bars",
]
