"""Hand-made bars at the edges, and properties that hold for any bars."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import context, hurst, metrics, recurrence, scaling, splits, timeframe
from barloom.plans import panel
from barloom.schema import DEFAULT_SYMBOLS, FUNDAMENTALS, SYMBOL_SECTOR
from barloom.sources import bars as B
from barloom.sources import universe
from checks import market

START = dt.date(2020, 1, 1)


def make_bars(spark, symbol="AAA", n=60, seed=1, change=None):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.005, n))
    pdf = pd.DataFrame(
        {
            "Symbol": symbol,
            "Date": [START + dt.timedelta(days=i) for i in range(n)],
            "Open": open_,
            "High": np.maximum(open_, close) * 1.01,
            "Low": np.minimum(open_, close) * 0.99,
            "Close": close,
            "Volume": rng.integers(100, 1000, n).astype(float),
        }
    )
    if change is not None:
        change(pdf)
    schema = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"
    return spark.createDataFrame(pdf, schema).withColumn("Adj_Close", F.col("Close"))


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("Symbol", "Date").select(*names).collect()]


def test_two_bars_on_a_day_fail(spark):
    twice = make_bars(spark, n=5).unionByName(make_bars(spark, n=1))
    with pytest.raises(Exception, match="more than one bar for AAA on 2020-01-01"):
        B.normalize_bars(twice).count()


def test_missing_volume_fails(spark):
    with pytest.raises(ValueError, match="Volume"):
        B.normalize_bars(make_bars(spark, n=3).drop("Volume"))


def test_bad_text_and_repeated_columns(spark):
    raw = make_bars(spark, n=2).withColumn("Close", F.lit("oops")).drop("Adj_Close")
    twice = raw.select("*", F.lit(7.0).alias("Open"))
    bars = B.normalize_bars(twice, unique=True)
    assert [r.Close for r in bars.collect()] == [None, None]
    assert all(r.Open != 7.0 for r in bars.collect())


def test_full_window_and_null_close(spark):
    def blank(pdf):
        pdf.loc[10, "Close"] = np.nan

    got = rows(panel.with_features(make_bars(spark, n=30, change=blank), ["MA_5", "Return", "EMA_5", "RSI_7"]), "MA_5", "Return", "EMA_5", "RSI_7")
    ma = [r[0] for r in got]
    assert [i for i, v in enumerate(ma) if v is None] == [0, 1, 2, 3, 10, 11, 12, 13, 14]
    # a missing close repeats the last one, so its change is 0 and the next spans two bars
    assert got[10][1] == 0.0 and got[11][1] is not None
    # recurrences skip the bar and go on
    assert got[10][2] is None and got[11][2] is not None and got[11][3] is not None


def test_flat_run(spark):
    def flat(pdf):
        pdf[["Open", "High", "Low", "Close"]] = 50.0
        pdf["Volume"] = 0.0

    names = ["Return_Skew_5", "Return_Std_5", "PV_Corr_5", "RSI_14", "CCI", "Williams_R", "StochF_K", "BB_Position_20"]
    last = panel.with_features(make_bars(spark, n=40, change=flat), names + ["Volume_Change", "VWAP", "CMF_20", "MFI_14"])
    last = last.orderBy(F.desc("Date")).first()
    assert (last.Return_Skew_5, last.Return_Std_5, last.RSI_14, last.CCI) == (0, 0, 0, 0)
    assert last.PV_Corr_5 is None and last.BB_Position_20 is None and last.VWAP is None
    assert last.Volume_Change is None and last.CMF_20 is None and last.MFI_14 == 0


def test_zero_open_and_non_positive_prices(spark):
    def zero(pdf):
        pdf.loc[3, ["Open", "Low"]] = 0.0

    got = rows(panel.with_features(make_bars(spark, n=30, change=zero), ["Price_Range_Pct", "Gap_Size", "YZ_Volatility_20", "Parkinson_Vol_20"]), "Price_Range_Pct", "YZ_Volatility_20", "Parkinson_Vol_20")
    assert got[3][0] is None and got[22][1] is None and got[29][1] is not None


def test_history_and_row_limits(spark):
    bars = make_bars(spark, "LONG", 200).unionByName(make_bars(spark, "SHORT", 199))
    assert {r.Symbol for r in panel.enough_history(bars).select("Symbol").distinct().collect()} == {"LONG"}
    with pytest.raises(ValueError):
        panel.require_rows(panel.feature_panel(bars, features=["Return"]))


def test_small_panel_warns(spark, caplog):
    bars = make_bars(spark, "A", 320)
    assert panel.require_rows(panel.feature_panel(bars, features=["Return"])) == 120
    assert "fewer" in caplog.text


def test_newest_bar_is_kept_for_scoring(spark):
    bars = make_bars(spark, "A", 260)
    newest = lambda df: df.agg(F.max("Date")).first()[0]
    assert newest(panel.feature_panel(bars, features=["Return"], min_rows=1)) == START + dt.timedelta(days=258)
    assert newest(panel.feature_panel(bars, features=["Return"], labelled=False)) == START + dt.timedelta(days=259)


def test_unknown_directions(spark):
    bars = make_bars(spark, "A", 330)
    names = [f"Target_{k}_{h}d" for h in (1, 21) for k in ("Return", "Direction")]
    plain = panel.feature_panel(bars, features=names)
    blank = panel.feature_panel(bars, features=names, null_unknown=True)
    assert plain.filter("Target_Direction_21d IS NULL").count() == 0
    assert blank.filter("Target_Direction_21d IS NULL").count() == 20
    legacy = panel.feature_panel(bars, features=names + ["Target_Next_Day_Return"], multi_horizon_targets=False)
    assert [c for c in legacy.columns if c.startswith("Target")] == ["Target_Next_Day_Return"]


def test_no_look_ahead(spark):
    """Changing the bars after a day leaves all features up to that day alone."""

    def later(pdf):
        for c in ("Open", "High", "Low", "Close", "Volume"):
            pdf.loc[200:, c] = pdf.loc[200:, c] * 3

    names = [n for n in panel.FEATURES if not n.startswith(("Target_", "Sector"))]
    day = START + dt.timedelta(days=199)
    one = panel.with_features(make_bars(spark, n=230), names).filter(F.col("Date") == F.lit(day)).first()
    two = panel.with_features(make_bars(spark, n=230, change=later), names).filter(F.col("Date") == F.lit(day)).first()
    assert one == two
    flags = [n for n in names if n.startswith(("CDL", "Month_", "Day_", "Gap_U", "Above", "TK_", "MACD_C", "SAR_S", "High_VIX"))]
    assert all(one[f] is not None for f in flags)


def test_full_panel_columns(spark):
    bars = make_bars(spark, "AAPL", 310)
    made = panel.feature_panel(bars)
    extra = [c for c in made.columns if c not in bars.columns + ["Sector"]]
    assert len(extra) == 268 and len(set(made.columns)) == len(made.columns) == 277
    row = made.first()
    assert row.Sector == "Technology" and row.Sector_Technology == 1 and row.Sector_Other == 0
    assert all(row[c] is None for c in FUNDAMENTALS) and row.VIX is None and row.High_VIX == 0
    assert set(panel.numeric_features(made)) >= {"MA_200", "CDLDOJI", "Volume"}
    assert not any(c.startswith("Target_") for c in panel.numeric_features(made))
    assert panel.target_column(made, 5) == "Target_Direction_5d"
    assert panel.target_column(made, 3) == "Target_Next_Day_Direction"


def test_bounds(spark, sf_dir):
    df = panel.with_features(market.type_bars(spark, sf_dir), ["RSI_14", "MFI_14", "Williams_R", "Aroon_Up", "Aroon_Down", "Aroon_Osc", "Hurst_63"])
    bad = df.filter(
        "RSI_14 NOT BETWEEN 0 AND 100 OR MFI_14 NOT BETWEEN 0 AND 100 OR Williams_R NOT BETWEEN -100 AND 0"
        " OR abs(Aroon_Osc - Aroon_Up + Aroon_Down) > 1e-9 OR Hurst_63 NOT BETWEEN 0 AND 1"
    )
    assert bad.count() == 0


def test_index_level_carries_null_rows(spark):
    bars = make_bars(spark, n=8)
    ctx = spark.createDataFrame(
        [("VIX", START, 20.0), ("VIX", START + dt.timedelta(days=2), None), ("VIX", START + dt.timedelta(days=4), 30.0),
         ("SPY", START, 10.0), ("SPY", START + dt.timedelta(days=4), 11.0)],
        "ctx_symbol string, Date date, Close double",
    )
    got = rows(context.with_context(bars, ctx), "VIX", "_market_ret")
    assert [g[0] for g in got] == [20.0, 20.0, None, None, 30.0, 30.0, 30.0, 30.0]
    assert [g[1] for g in got[:4]] == [None] * 4 and math.isclose(got[4][1], 0.1) and got[5][1] is None


def test_empty_weeks(spark):
    pdf = pd.DataFrame({"Date": [dt.date(2020, 1, 6), dt.date(2020, 1, 12), dt.date(2020, 2, 3)]})
    bars = spark.createDataFrame(pdf).selectExpr(
        "'A' AS Symbol", "Date", "1.0D AS Open", "2.0D AS High", "1.0D AS Low", "CAST(day(Date) AS DOUBLE) AS Close", "5.0D AS Volume"
    )
    weeks = timeframe.resample(bars, "week").orderBy("label").collect()
    assert [str(w.label) for w in weeks] == ["2020-01-12", "2020-01-19", "2020-01-26", "2020-02-02", "2020-02-09"]
    assert [w.Close for w in weeks] == [12.0, None, None, None, 3.0] and [w.Volume for w in weeks] == [10, 0, 0, 0, 5]
    got = rows(timeframe.with_timeframes(bars, ["W_Return"]), "Date", "W_Return")
    # the Sunday bar sees its own week, the later one the empty week before it
    assert got[1][1] is None and got[2][1] == 0.0


def test_symbol_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" aapl \n\nMSFT\naapl\n")
    assert {r.Symbol for r in universe.symbols_from_file(spark, str(tmp_path / "s.txt")).collect()} == {"AAPL", "MSFT"}
    text = universe.symbols_from_text(spark, "b, a,,B ").orderBy("pos").collect()
    assert [r.Symbol for r in text] == ["B", "A"]
    assert universe.symbols_from_list(spark).count() == len(DEFAULT_SYMBOLS) == 30
    assert universe.sector_table(spark).count() == len(SYMBOL_SECTOR)


def brute_hurst(x, max_lag):
    taus, means = [], []
    for lag in range(2, max_lag):
        values = []
        for i in range(0, len(x) - lag, lag):
            part = x[i : i + lag]
            path = np.cumsum(part - part.mean())
            if part.std() > 0:
                values.append((path.max() - path.min()) / part.std())
        if values:
            taus.append(lag)
            means.append(np.mean(values))
    if len(taus) < 2:
        return 0.5
    return float(np.clip(np.polyfit(np.log(taus), np.log(means), 1)[0], 0, 1))


def test_hurst_against_brute_force():
    x = np.random.default_rng(3).normal(size=150)
    x[40:50] = 0.0
    x[100] = np.nan
    fast = hurst.rolling_hurst(x, 63, 15)
    for t in range(len(x)):
        window = x[t - 62 : t + 1] if t >= 62 else np.array([np.nan])
        if np.isnan(window).any():
            assert np.isnan(fast[t])
        else:
            assert math.isclose(fast[t], brute_hurst(window, 15), abs_tol=1e-9)
    assert (hurst.rolling_hurst(np.zeros(80), 63, 15)[62:] == 0.5).all()


def test_short_series_have_no_recurrences():
    for n in (0, 1, 2, 13):
        h = np.arange(n, dtype=float) + 2
        out = recurrence.recurrence_columns(pd.DataFrame({"High": h, "Low": h - 1, "Close": h - 0.5, "Volume": h}))
        assert all(len(v) == n for v in out.values())
        assert np.isnan(out["EMA_20"]).all() and np.isnan(out["ADX"]).all()


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=30_000)
    x[:10_000] = 0.25  # a third of all rows share one value
    pdf = pd.DataFrame({"x": x, "y": np.where(rng.random(30_000) < 0.2, np.inf, rng.exponential(size=30_000)), "z": np.nan})
    df = spark.createDataFrame(pdf)
    got = {(r["column"], r["p"]): r["value"] for r in scaling.column_quantiles(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        assert math.isclose(got["x", p], np.quantile(x, p), abs_tol=1e-12)
        assert math.isclose(got["y", p], np.quantile(pdf.y[np.isfinite(pdf.y)], p), abs_tol=1e-12)
    assert ("z", 0.5) not in got
    fitted = scaling.fit_scaler(df, ["x", "y", "z"])
    assert fitted.stats["z"] == (None, None)
    assert fitted.transform(df).agg(F.max("z"), F.min("z")).first() == (0.0, 0.0)
    constant = df.withColumn("k", F.lit(4.0))
    assert scaling.fit_scaler(constant, ["k"], "minmax").stats["k"] == (4.0, 1.0)


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(6)
    score = np.round(rng.normal(size=4000), 1)
    score[:1500] = 0.3
    label = (rng.random(4000) < 1 / (1 + np.exp(-score))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(df, buckets=16).first()[0], want, abs_tol=1e-12)
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] == 0.0


def test_splits_are_complete_and_disjoint(spark):
    days = make_bars(spark, "A", 50).unionByName(make_bars(spark, "B", 37))
    parts = splits.split_train_test(days, 0.3)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 60, "test": 27}
    again = splits.split_train_test(days.repartition(7), 0.3, time_based=False)
    first = splits.split_train_test(days, 0.3, time_based=False)
    assert first.exceptAll(again).count() == 0 and first.filter("split = 'test'").count() == 27
    folds = splits.walk_forward_splits(days, 4, 0.2)
    per_fold = folds.groupBy("fold", "Symbol", "Date").agg(F.count("*").alias("n"))
    assert per_fold.filter("n > 1").count() == 0
    train = [folds.filter(f"fold = {k} AND role = 'train'").count() for k in (1, 2, 3, 4)]
    assert train == [87 - 4 * 17 + 17 * k for k in range(4)]
    assert splits.walk_forward_splits(days, 5, 0.2).select("fold").distinct().count() == 5
    assert splits.split_train_test(days, 0.0).filter("split = 'test'").count() == 0


def test_scaler_ignores_test_rows(spark):
    days = make_bars(spark, "A", 50)
    parts = splits.split_train_test(days, 0.2)
    moved = parts.withColumn("Close", F.when(F.col("split") == "test", F.col("Close") * 100).otherwise(F.col("Close")))
    fit = lambda df: scaling.fit_scaler(df.filter("split = 'train'"), ["Close"])
    assert fit(parts).stats == fit(moved).stats


def test_metrics_know_only_known_rows(spark):
    scored = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 0.0, 1.0), ("a", None, 3.0), (None, 1.0, 1.0), (None, 0.0, -1.0), (None, None, -2.0)],
        "fold string, label double, score double",
    )
    whole = metrics.classification_metrics(scored).first()
    assert (whole.rows, whole.accuracy) == (6, 0.75)
    per_fold = {r.fold: r.accuracy for r in metrics.classification_metrics(scored, ["fold"]).collect()}
    assert per_fold == {"a": 0.5, None: 1.0}
    assert {r.fold: r.roc_auc for r in metrics.roc_auc(scored, ["fold"]).collect()} == {"a": 1.0, None: 1.0}


def test_hull_average_skips_unknown_bars(spark):
    pdf = pd.DataFrame({"Close": [1.0, 2.0, np.nan, 3.0, 4.0]})
    got = recurrence._place(pdf, ["Close"], lambda c: [recurrence.hull(c, 20)], ["HMA_20"])["HMA_20"]
    full = recurrence.hull(np.array([1.0, 2.0, 3.0, 4.0]), 20)
    assert np.isnan(got[2]) and (got[[0, 1, 3, 4]] == full).all()


def test_symbol_file_keeps_its_order(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" msft \n\nAAPL\nmsft\n")
    listed = universe.symbols_from_file(spark, str(tmp_path / "s.txt"))
    assert [r.Symbol for r in listed.orderBy("pos").collect()] == ["MSFT", "AAPL"]
    both = universe.joined_symbols(listed, universe.symbols_from_text(spark, "ibm,aapl"))
    assert [r.Symbol for r in both.orderBy("pos").collect()] == ["MSFT", "AAPL", "IBM"]
