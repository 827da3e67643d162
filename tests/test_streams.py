"""Symbols that step together against symbols alone, and the plan around the stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import recurrence, streams, timeframe
from barloom.plans import panel


def frame(seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for s, n in enumerate([300, 1, 14, 90, 2, 300, 41, 15, 28, 700]):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        h, low = c * (1 + rng.random(n) * 0.02), c * (1 - rng.random(n) * 0.02)
        day = np.sort(rng.choice(np.arange(9000, 9000 + 3 * n + 5), n, replace=False))
        part = pd.DataFrame({"Symbol": f"S{s}", "day": day, "Open": c, "High": h, "Low": low, "Close": c, "Volume": 10.0})
        for col in ("Open", "High", "Low", "Close", "Volume"):
            part.loc[rng.random(n) < 0.03, col] = np.nan
        if s == 3:
            part[["High", "Low", "Close"]] = 7.0
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def test_symbols_together_are_symbols_alone():
    rows = frame()
    (whole, bounds), = streams.whole_symbols([rows.iloc[a : a + 97] for a in range(0, len(rows), 97)])
    assert len(bounds) == 11 and len(whole) == len(rows)
    got = recurrence.columns_of_symbols(whole, bounds, recurrence.RECURRENCES) | timeframe.timeframe_columns(whole, bounds, timeframe.WEEKLY + timeframe.MONTHLY)
    for a, b in zip(bounds[:-1], bounds[1:]):
        one = rows.iloc[a:b].reset_index(drop=True)
        alone = recurrence.recurrence_columns(one) | recurrence.hurst_columns(one["Close"].to_numpy()) | timeframe.timeframe_columns(one, np.array([0, b - a]), timeframe.WEEKLY + timeframe.MONTHLY)
        for name, x in alone.items():
            np.testing.assert_allclose(got[name][a:b], x, rtol=1e-12, atol=1e-12, err_msg=name)
    few = recurrence.columns_of_symbols(whole, bounds, ["SAR", "RSI_14"])
    assert set(few) >= {"SAR", "RSI_14"} and "EMA_5" not in few


def test_batches_are_cut_between_symbols(monkeypatch):
    monkeypatch.setattr(streams, "HELD", 50)
    rows = frame()
    seen = []
    for part, bounds in streams.whole_symbols(iter([rows.iloc[a : a + 31] for a in range(0, len(rows), 31)])):
        assert bounds[0] == 0 and bounds[-1] == len(part)
        for a, b in zip(bounds[:-1], bounds[1:]):
            assert part["Symbol"].iloc[a:b].nunique() == 1
            seen.append(part["Symbol"].iloc[a])
    assert seen == list(dict.fromkeys(rows["Symbol"]))
    assert list(streams.whole_symbols(iter([]))) == []


@pytest.fixture(scope="module")
def bars(spark):
    rows = frame(4)
    rows["Date"] = pd.to_datetime(rows["day"], unit="D").dt.date
    return spark.createDataFrame(rows.drop(columns="day").astype(object).where(rows.drop(columns="day").notna(), None), "Symbol string, Open double, High double, Low double, Close double, Volume double, Date date")


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_one_stream_and_one_window_shuffle(bars):
    names = panel.CATALOG.group("moving_average", "oscillator", "recurrence") + recurrence.RECURRENCES + timeframe.WEEKLY + timeframe.MONTHLY
    plan = plan_of(panel.with_features(bars, names))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and plan.count("LocalTableScan") == 1


def test_filters_stay_above_the_stream(bars):
    made = recurrence.with_recurrences(bars, ["EMA_20"])
    late = made.filter(F.col("Date") > F.lit("1998-01-01").cast("date"))
    want = {(r.Symbol, r.Date): r.EMA_20 for r in made.collect() if str(r.Date) > "1998-01-01"}
    got = {(r.Symbol, r.Date): r.EMA_20 for r in late.collect()}
    assert got == want and any(v is not None for v in got.values())
    assert made.limit(0).count() == 0 and recurrence.with_recurrences(bars.limit(0), ["EMA_20"]).count() == 0


def test_stream_is_the_joins(bars):
    names = timeframe.WEEKLY + timeframe.MONTHLY
    want = timeframe.carry_back(bars, timeframe.weekly_features(bars), timeframe.monthly_features(bars)).toPandas()
    got = timeframe.with_timeframes(bars).toPandas()
    key = ["Symbol", "Date"]
    got, want = got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True)
    for n in names:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=n)
