"""Weekly and monthly bars, and their features carried back to daily rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import windows as W
from barloom.operators import streams
from barloom.operators.recurrence import _place, rsi
from barloom.schema import KEY, TIME
from barloom.session import spread

WEEKLY = ["W_Return", "W_Range", "W_Vol", "W_RSI14", "W_MA4", "W_MA12", "W_Mom4"]
MONTHLY = ["M_Return", "M_Range", "M_Vol", "M_MA3", "M_MA12", "M_Mom3"]


def week_label(date: Column) -> Column:
    """The Sunday that ends the Monday-to-Sunday week of ``date``."""
    return F.next_day(F.date_sub(date, 1), "SU")


def month_label(date: Column) -> Column:
    return F.last_day(date)


_LABELS = {"week": week_label, "month": month_label}


def resample(bars: DataFrame, period: str, fill: bool = True) -> DataFrame:
    """One bar per symbol and week or month, labelled with the period's last day.

    With ``fill`` the periods between two bars that hold none appear as rows
    with NULL prices and no volume.
    """
    label = _LABELS[period](F.col(TIME)).alias("label")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(TIME))
    grouped = bars.groupBy(KEY, label).agg(
        F.min_by("Open", known("Open")).alias("Open"),
        F.max("High").alias("High"),
        F.min("Low").alias("Low"),
        F.max_by("Close", known("Close")).alias("Close"),
        F.coalesce(F.sum("Volume"), F.lit(0.0)).alias("Volume"),
    )
    if not fill:
        return grouped
    following = F.lead("label").over(W.by_symbol(time="label"))
    if period == "week":
        step, last = F.expr("interval 7 days"), F.date_sub(F.col("_next"), 7)
    else:
        step, last = F.expr("interval 1 month"), F.add_months(F.trunc(F.col("_next"), "month"), -1)
    start = F.col("label") if period == "week" else F.trunc(F.col("label"), "month")
    spans = F.sequence(start, F.coalesce(last, start), step)
    rows = grouped.withColumn("_next", following).select("*", F.explode(spans).alias("_at"))
    at = F.col("_at") if period == "week" else F.last_day("_at")
    held = at == F.col("label")
    return rows.select(
        KEY,
        at.alias("label"),
        *[F.when(held, F.col(c)).alias(c) for c in ("Open", "High", "Low", "Close")],
        F.when(held, F.col("Volume")).otherwise(F.lit(0.0)).alias("Volume"),
    )


def _full(agg, x: str, n: int) -> Column:
    frame = W.trailing(n, time="label")
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def _change(k: int) -> Column:
    return W.pct_change(F.col("Close"), k, time="label")


def _with_rsi(weeks: DataFrame) -> DataFrame:
    fields = list(weeks.schema.fields) + [T.StructField("W_RSI14", T.DoubleType())]

    def per_symbol(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label", ignore_index=True)
        close = pdf["Close"].to_numpy(dtype=float)
        known = ~np.isnan(close)
        strength = np.full(len(close), np.nan)
        strength[known] = rsi(close[known], 14)
        return pdf.assign(W_RSI14=strength)

    return weeks.groupBy(KEY).applyInPandas(per_symbol, T.StructType(fields))


def weekly_features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    weeks = resample(bars, "week")
    if names is None or "W_RSI14" in names:
        weeks = _with_rsi(weeks)
    weeks = weeks.withColumn("W_Return", _change(1))
    columns = {
        "W_Return": F.col("W_Return"),
        "W_Range": W.ratio(F.col("High") - F.col("Low"), F.col("Open")),
        "W_Vol": _full(F.stddev_samp, "W_Return", 4),
        "W_RSI14": F.col("W_RSI14") if "W_RSI14" in weeks.columns else None,
        "W_MA4": _full(F.avg, "Close", 4),
        "W_MA12": _full(F.avg, "Close", 12),
        "W_Mom4": _change(4),
    }
    return weeks.select(KEY, "label", *[columns[n].alias(n) for n in (names or WEEKLY)])


def monthly_features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    months = resample(bars, "month").withColumn("M_Return", _change(1))
    columns = {
        "M_Return": F.col("M_Return"),
        "M_Range": W.ratio(F.col("High") - F.col("Low"), F.col("Open")),
        "M_Vol": _full(F.stddev_samp, "M_Return", 3),
        "M_MA3": _full(F.avg, "Close", 3),
        "M_MA12": _full(F.avg, "Close", 12),
        "M_Mom3": _change(3),
    }
    return months.select(KEY, "label", *[columns[n].alias(n) for n in (names or MONTHLY)])


def carry_back(bars: DataFrame, *frames: DataFrame) -> DataFrame:
    """As-of join: each bar gets the newest row of every frame with ``label <= Date``.

    Bars and frame rows are stacked, partitioned once by symbol and walked in
    date order, so the join shuffles each side once however many frames there
    are. A whole frame row is carried, including its NULLs.
    """
    held = bars.columns
    stacked = bars.withColumn("_kind", F.lit(len(frames)))
    for i, frame in enumerate(frames):
        values = [c for c in frame.columns if c not in (KEY, "label")]
        row = frame.select(KEY, F.col("label").alias(TIME), F.lit(i).alias("_kind"), F.struct(*values).alias(f"_row{i}"))
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    order = Window.partitionBy(KEY).orderBy(TIME, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    stacked = spread(stacked, KEY).select(
        *held,
        "_kind",
        *[F.last(f"_row{i}", ignorenulls=True).over(order).alias(f"_row{i}") for i in range(len(frames))],
    )
    found = [
        F.col(f"_row{i}")[c].alias(c)
        for i, frame in enumerate(frames)
        for c in frame.columns
        if c not in (KEY, "label")
    ]
    return stacked.filter(F.col("_kind") == len(frames)).select(*held, *found)


def _period_of(day: np.ndarray, period: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of the week or month of each day since the epoch, and whether the day is the period's last."""
    if period == "week":  # Monday to Sunday
        return (day + 3) // 7, (day + 3) % 7 == 6
    dates = day.astype("datetime64[D]")
    months = dates.astype("datetime64[M]")
    return months.astype(np.int64), (dates + 1).astype("datetime64[M]") != months


class _Periods:
    """Weeks or months of several symbols after each other, empty ones included, in arrays."""

    def __init__(self, rows: pd.DataFrame, bounds: np.ndarray, period: str):
        first, last = bounds[:-1], bounds[1:] - 1
        number, ends = _period_of(rows["day"].to_numpy(np.int64), period)
        sizes = number[last] - number[first] + 1
        begin = np.cumsum(sizes) - sizes
        own = np.repeat(begin - number[first], np.diff(bounds)) + number
        self.symbol = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = begin[self.symbol]
        # A bar sees its own period on that one's last day, else the one before.
        self.seen = own - ~ends
        self.seen[self.seen < np.repeat(begin, np.diff(bounds))] = -1
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        value = {c: rows[c].to_numpy(float) for c in ("Open", "High", "Low", "Close")}
        self.open, self.high, self.low, self.close = (np.full(sizes.sum(), np.nan) for _ in range(4))
        known = np.flatnonzero(~np.isnan(value["Open"]))[::-1]
        self.open[own[known]] = value["Open"][known]  # the first known one is written last
        self.high[own[starts]] = np.fmax.reduceat(value["High"], starts)
        self.low[own[starts]] = np.fmin.reduceat(value["Low"], starts)
        known = np.flatnonzero(~np.isnan(value["Close"]))
        self.close[own[known]] = value["Close"][known]
        at = np.maximum.accumulate(np.where(np.isnan(self.close), -1, np.arange(len(self.close))))
        self.padded = np.where(at >= self.begin, self.close[at], np.nan)

    def change(self, k: int) -> np.ndarray:
        """Relative change of the newest known close over ``k`` periods."""
        at = np.arange(len(self.padded)) - k
        before = np.where(at >= self.begin, self.padded[np.maximum(at, 0)], np.nan)
        return self.padded / np.where(before == 0, np.nan, before) - 1

    def full(self, fn, x: np.ndarray, n: int, **options) -> np.ndarray:
        """``fn`` over ``n`` periods of one symbol, all known."""
        out = np.full(len(x), np.nan)
        if len(x) >= n:
            out[n - 1 :] = fn(sliding_window_view(x, n), axis=-1, **options)
        return np.where(np.arange(len(x)) - n + 1 >= self.begin, out, np.nan)

    def span(self) -> np.ndarray:
        return (self.high - self.low) / np.where(self.open == 0, np.nan, self.open)

    def strength(self) -> np.ndarray:
        return _place(pd.DataFrame({"Close": self.close}), ["Close"], lambda c: (rsi(c, 14),), ["x"], self.symbol)["x"]


_COLUMNS = {
    "W_Return": lambda p: p.change(1),
    "W_Range": lambda p: p.span(),
    "W_Vol": lambda p: p.full(np.std, p.change(1), 4, ddof=1),
    "W_RSI14": lambda p: p.strength(),
    "W_MA4": lambda p: p.full(np.mean, p.close, 4),
    "W_MA12": lambda p: p.full(np.mean, p.close, 12),
    "W_Mom4": lambda p: p.change(4),
    "M_Return": lambda p: p.change(1),
    "M_Range": lambda p: p.span(),
    "M_Vol": lambda p: p.full(np.std, p.change(1), 3, ddof=1),
    "M_MA3": lambda p: p.full(np.mean, p.close, 3),
    "M_MA12": lambda p: p.full(np.mean, p.close, 12),
    "M_Mom3": lambda p: p.change(3),
}


def timeframe_columns(rows: pd.DataFrame, bounds: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    """The named weekly and monthly columns as each bar sees them: the newest period that has ended by its day."""
    out = {}
    for period, known in (("week", WEEKLY), ("month", MONTHLY)):
        wanted = [n for n in names if n in known]
        if wanted:
            with np.errstate(divide="ignore", invalid="ignore"):
                periods = _Periods(rows, bounds, period)
                for n in wanted:
                    out[n] = np.where(periods.seen >= 0, _COLUMNS[n](periods)[periods.seen], np.nan)
    return out


def with_timeframes(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Daily rows plus weekly and monthly columns (all by default), in one pass over the sorted bars.

    The weeks and months of a symbol are made from its bars as they stream by; ``weekly_features``, ``monthly_features`` and
    ``carry_back`` give the same as tables and a join.
    """
    names = [n for n in WEEKLY + MONTHLY if names is None or n in set(names)]
    return streams.with_columns_of_symbols(bars, names, lambda rows, bounds: timeframe_columns(rows, bounds, names)) if names else bars


__all__ = ["MONTHLY", "WEEKLY", "carry_back", "monthly_features", "resample", "timeframe_columns", "weekly_features", "with_timeframes"]
