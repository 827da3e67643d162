"""Market context: index and sector-fund series, and features against them.

A context table is long, ``(ctx_symbol, Date, Close)``, with a fixed number of
series. It is folded to one row per calendar day before it meets the bars; the
number of days bounds that table whatever the input size, which is what allows
the broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.features import Catalog
from barloom.functions import windows as W
from barloom.schema import (
    ANNUAL_DAYS,
    BROAD_MARKET,
    CONTEXT_SYMBOLS,
    OTHER_SECTOR,
    SECTOR_ETF,
    SECTORS,
    TIME,
    VOLATILITY_INDEX,
)

def _by_series():
    return {"key": "ctx_symbol", "time": TIME}


def context_returns(ctx: DataFrame) -> DataFrame:
    """Daily return and 20-day annualised volatility per context series."""
    changed = ctx.withColumn("Ret", W.pct_change(F.col("Close"), 1, **_by_series()))
    frame = W.trailing(20, **_by_series())
    spread = F.when(F.count("Ret").over(frame) == 20, F.stddev_samp("Ret").over(frame))
    return changed.withColumn("Vol20", spread * math.sqrt(ANNUAL_DAYS))


def context_frame(ctx: DataFrame, symbols: Sequence[str] = tuple(CONTEXT_SYMBOLS)) -> DataFrame:
    """All series side by side, one row per day any of them has: 29 columns."""
    series = context_returns(ctx.filter(F.col("ctx_symbol").isin(*symbols)))
    columns = []
    for s in symbols:
        mine = F.col("ctx_symbol") == s
        if s == VOLATILITY_INDEX:
            columns.append(F.max(F.when(mine, F.col("Close"))).alias(s))
        else:
            columns.append(F.max(F.when(mine, F.col("Ret"))).alias(f"{s}_Ret"))
            columns.append(F.max(F.when(mine, F.col("Vol20"))).alias(f"{s}_Vol20"))
    return series.groupBy(TIME).agg(*columns)


def context_by_day(ctx: DataFrame) -> DataFrame:
    """One row per calendar day from the first to the last context day.

    The returns stand only on days that have them; the index level is carried
    from the newest earlier context row, also when its level is NULL, so the
    as-of join becomes an equality join on the date.
    """
    funds = list(SECTOR_ETF.values())
    series = ctx.filter(F.col("ctx_symbol").isin(BROAD_MARKET[0], VOLATILITY_INDEX, *funds))
    series = series.withColumn("Ret", W.pct_change(F.col("Close"), 1, **_by_series()))
    mine = lambda s: F.col("ctx_symbol") == s
    days = series.groupBy(TIME).agg(
        F.max(F.when(mine(BROAD_MARKET[0]), F.col("Ret"))).alias("_market_ret"),
        F.max(F.when(mine(VOLATILITY_INDEX), F.col("Close"))).alias("VIX"),
        *[F.max(F.when(mine(f), F.col("Ret"))).alias(f"_ret_{f}") for f in funds],
    )
    # days only: this single-partition window is bounded by the calendar
    following = F.lead(TIME).over(Window.partitionBy(F.lit(0)).orderBy(TIME))
    days = days.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col(TIME)))
    spread = days.select(
        "*", F.explode(F.sequence(F.col(TIME), F.col("_until"), F.expr("interval 1 day"))).alias("_day")
    )
    own = F.col("_day") == F.col(TIME)
    exact = ["_market_ret"] + [f"_ret_{f}" for f in funds]
    return spread.select("_day", "VIX", *[F.when(own, F.col(c)).alias(c) for c in exact])


def with_sector(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sector name per symbol, ``Other`` when none is known.

    No broadcast hint: the table grows with the universe, and Spark picks the
    join from its size.
    """
    return bars.join(sectors.select("Symbol", "Sector"), "Symbol", "left").withColumn(
        "Sector", F.coalesce("Sector", F.lit(OTHER_SECTOR))
    )


def with_context(bars: DataFrame, ctx: DataFrame) -> DataFrame:
    """Market return, index level and sector-fund return of each bar's day.

    One broadcast join on the day. Bars later than the last context day look
    that day up for the index level and get no returns.
    """
    held = bars.columns
    last = ctx.agg(F.max(TIME)).scalar()
    keyed = bars.withColumn("_last", last).withColumn("_day", F.least(TIME, "_last"))
    joined = keyed.join(F.broadcast(context_by_day(ctx)), "_day", "left")
    current = F.col(TIME) <= F.col("_last")
    added = [F.when(current, F.col("_market_ret")).alias("_market_ret"), F.col("VIX")]
    if "Sector" in held:
        fund = F.lit(None).cast("double")
        for sector, etf in SECTOR_ETF.items():
            fund = F.when(F.col("Sector") == sector, F.col(f"_ret_{etf}")).otherwise(fund)
        added.append(F.when(current, fund).alias("_fund_ret"))
    return joined.select(*held, *added)


def without_context(bars: DataFrame) -> DataFrame:
    """The same columns, all unknown."""
    names = ["_market_ret", "VIX", "_fund_ret"]
    return bars.select("*", *[F.lit(None).cast("double").alias(n) for n in names])


def with_fundamentals(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """One snapshot row per symbol repeated on all its bars."""
    return bars.join(fundamentals, "Symbol", "left")


def register(cat: Catalog) -> None:
    add = lambda name, build: cat.add("context", name, build)
    add("SPY_Corr_20", lambda c: c.full_corr("Return", "_market_ret", 20))

    def beta(c):
        spread = c.full_var("_market_ret", 60)
        return W.ratio(c.full_cov("Return", "_market_ret", 60), spread)

    add("Beta_SPY_60", beta)
    add("Alpha_SPY_20", lambda c: c("Return") - c("Beta_SPY_60") * c("_market_ret"))
    add("VIX_Change", lambda c: c.pct("VIX"))
    add("High_VIX", lambda c: W.flag(c("VIX") > 25))
    add("Crisis_VIX", lambda c: W.flag(c("VIX") > 40))
    add("SectorETF_Corr_20", lambda c: c.full_corr("Return", "_fund_ret", 20))
    add("Excess_Ret_Sector", lambda c: c("Return") - c("_fund_ret"))
    for sector in SECTORS:
        cat.add("sector", f"Sector_{sector}", lambda c, sector=sector: W.flag(c("Sector") == sector))
