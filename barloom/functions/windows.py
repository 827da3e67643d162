"""Frames and null-safe arithmetic used by every per-symbol feature.

All frames run over one symbol's bars in date order. ``(Symbol, Date)`` is
unique (see ``sources.bars.one_bar_per_day``) and ``Date`` is a calendar day,
so a window partition never holds more than one row per day of history.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.schema import KEY, TIME


@lru_cache(maxsize=None)
def by_symbol(key: str = KEY, time: str = TIME):
    return Window.partitionBy(key).orderBy(time)


@lru_cache(maxsize=None)
def trailing(n: int, key: str = KEY, time: str = TIME):
    """The newest ``n`` rows up to and including the current one."""
    return by_symbol(key, time).rowsBetween(-(n - 1), 0)


@lru_cache(maxsize=None)
def preceding(n: int):
    """The ``n`` rows before the current one."""
    return by_symbol().rowsBetween(-n, -1)


@lru_cache(maxsize=None)
def since_start(upto: int = 0, key: str = KEY, time: str = TIME):
    """Everything from the first row to ``upto`` rows after the current one."""
    return by_symbol(key, time).rowsBetween(Window.unboundedPreceding, upto)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is zero or either side is NULL."""
    return F.try_divide(a, b)


def flag(condition: Column, otherwise: int = 0) -> Column:
    """1 when true, ``otherwise`` when false or unknown; never NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(otherwise))


def padded(x: Column, back: int = 0, key: str = KEY, time: str = TIME) -> Column:
    """Newest known value of ``x`` at the row ``back`` rows ago."""
    return F.last(x, ignorenulls=True).over(since_start(-back, key, time))


def pct_change(x: Column, k: int = 1, key: str = KEY, time: str = TIME) -> Column:
    """Relative change over ``k`` rows of the forward-filled series."""
    return ratio(padded(x, 0, key, time), padded(x, k, key, time)) - 1


def bounded(x: Column, low: float, high: float) -> Column:
    """Clip to ``[low, high]``; NULL stays NULL."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
