"""The feature panel: bars in, one wide row per symbol and day out."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.features import Catalog, add_features
from barloom.operators import calendar, candles, context, recurrence, rolling, streams, timeframe
from barloom.schema import FUNDAMENTALS, KEY, MIN_BARS, MIN_ROWS, TIME, is_target
from barloom.session import spread
from barloom.sources import universe

log = logging.getLogger(__name__)

CATALOG = Catalog()
for _module in (rolling, recurrence, calendar, candles, context):
    _module.register(CATALOG)

_CARRIED = timeframe.WEEKLY + timeframe.MONTHLY
_RECURRENT = [n for n in recurrence.RECURRENCES if not n.startswith("_")]
FEATURES = CATALOG.group(*CATALOG.groups()) + _RECURRENT + _CARRIED + ["VIX"]
WARM_UP = ["MA_200", "RSI_14", "Ichimoku_Kijun"]
LABEL = "Target_Return_1d"


def with_features(
    bars: DataFrame,
    names: Iterable[str],
    ctx: DataFrame | None = None,
    sectors: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    placed: bool = False,
) -> DataFrame:
    """``bars`` plus the named columns, computing only what they need.

    Order of work: recurrences, weeks and months stream beside the bars in one pass, on narrow rows; then the
    small tables are joined and all window expressions run over one partitioning by symbol.
    """
    names = list(dict.fromkeys(names))
    held = bars.columns
    reads = CATALOG.closure(names)
    out = bars
    recurrent = [n for n in recurrence.RECURRENCES if n in reads]
    carried = [n for n in _CARRIED if n in reads]
    if recurrent or carried:

        def work(rows, bounds):
            return recurrence.columns_of_symbols(rows, bounds, recurrent) | timeframe.timeframe_columns(rows, bounds, carried)

        out = spread(streams.with_columns_of_symbols(out, recurrent + carried, work, placed), KEY)
    if "Sector" in reads or reads & {"_fund_ret"}:
        out = context.with_sector(out, sectors if sectors is not None else universe.sector_table(bars.sparkSession))
    if reads & {"VIX", "_market_ret", "_fund_ret"}:
        out = context.with_context(out, ctx) if ctx is not None else context.without_context(out)
    given = [n for n in names if n in FUNDAMENTALS]
    if given:
        if fundamentals is None:
            out = out.select("*", *[F.lit(None).cast("double").alias(n) for n in given])
        else:
            out = context.with_fundamentals(out, fundamentals.select(KEY, *given))
    return add_features(out, names, CATALOG).select(*held, *names)


def enough_history(bars: DataFrame, minimum: int = MIN_BARS) -> DataFrame:
    """Bars of symbols with at least ``minimum`` bars."""
    per_symbol = Window.partitionBy(KEY)
    return (
        bars.withColumn("_bars", F.count("*").over(per_symbol)).filter(F.col("_bars") >= minimum).drop("_bars")
    )


def feature_panel(
    bars: DataFrame,
    ctx: DataFrame | None = None,
    sectors: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    symbols: DataFrame | None = None,
    features: Iterable[str] | None = None,
    multi_horizon_targets: bool = True,
    labelled: bool = True,
    null_unknown: bool = False,
    min_bars: int = MIN_BARS,
    min_rows: int = MIN_ROWS,
    required: bool = False,
) -> DataFrame:
    """The full panel.

    ``required`` raises at once when no symbol has enough rows; that is found on the few columns that decide it.

    ``labelled`` keeps rows whose next-day return is known and symbols with
    ``min_rows`` of them; scoring passes ``labelled=False`` and keeps the newest
    bar. ``null_unknown`` blanks direction targets that lie past the last bar
    instead of reporting 0.
    """
    if required and feature_panel(bars, symbols=symbols, features=[], labelled=labelled, min_bars=min_bars, min_rows=min_rows).isEmpty():
        raise ValueError("no symbol has enough valid bars")
    names = list(FEATURES if features is None else features)
    if features is None:
        names = ["Sector"] + names + FUNDAMENTALS
    keep = list(names)
    names += [n for n in WARM_UP + ([LABEL] if labelled else []) if n not in names]
    if symbols is not None:
        bars = bars.join(symbols.select(KEY), KEY, "left_semi")
    # the history count and the recurrences share this partitioning
    placed = enough_history(spread(bars, KEY), min_bars)
    panel = with_features(placed, names, ctx, sectors, fundamentals, placed=True)
    panel = panel.dropna(subset=WARM_UP + ([LABEL] if labelled else []))
    if labelled:
        panel = enough_history(panel, min_rows)
    if null_unknown:
        panel = blank_unknown(panel)
    if not multi_horizon_targets:
        legacy = ("Target_Next_Day_Return", "Target_Next_Day_Direction")
        keep = [n for n in keep if not is_target(n) or n in legacy]
    return panel.select(*bars.columns, *[n for n in keep if n not in bars.columns])


def blank_unknown(panel: DataFrame) -> DataFrame:
    """NULL for direction targets whose return is not known."""
    pairs = {c: c.replace("Direction", "Return") for c in panel.columns if c.startswith("Target_Direction_")}
    known = {c: F.when(F.col(r).isNotNull(), F.col(c)) for c, r in pairs.items() if r in panel.columns}
    return panel.withColumns(known)


def require_rows(panel: DataFrame, min_rows: int = 10_000) -> int:
    """Row count; raises when empty, warns below ``min_rows``."""
    n = panel.count()
    if n == 0:
        raise ValueError("no symbol has enough valid bars")
    if n < min_rows:
        log.warning("panel has %d rows, fewer than the %d asked for", n, min_rows)
    return n


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that may enter a model: no key, no target."""
    kinds = ("double", "int", "bigint", "float", "smallint", "tinyint")
    skip = (KEY, TIME, "Sector")
    return [n for n, t in df.dtypes if t in kinds and n not in skip and not is_target(n) and not n.startswith("_")]


def target_column(df: DataFrame, horizon: int = 1, regression: bool = False) -> str:
    """Target of a horizon; the next-day column when that one is not there."""
    kind = "Return" if regression else "Direction"
    name = f"Target_{kind}_{horizon}d"
    return name if name in df.columns else f"Target_Next_Day_{kind}"
