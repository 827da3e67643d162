"""Files, stored models, and the shape of plans."""

import os

import pytest
from pyspark.sql import functions as F

from barloom.operators import scaling, splits
from barloom.plans import panel, scoring, training
from barloom.sources import bars as B
from barloom.sources import context, files, universe
from checks import market

NAMES = ["Return", "Close_to_MA_20", "Volatility_20", "Target_Direction_1d", "Target_Direction_5d", "Target_Return_1d"]
MODEL = NAMES[:3]


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    files.write_panel(panel.feature_panel(market.type_bars(spark, sf_dir), features=NAMES), path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_csv_round_trip(spark, stored, tmp_path):
    files.write_csv(stored, str(tmp_path / "csv"))
    back = files.read_panel_csv(spark, str(tmp_path / "csv"), files.panel_schema(stored))
    assert back.count() == stored.count() and back.schema.fieldNames() == stored.schema.fieldNames()
    assert stored.exceptAll(back).count() == 0


def test_bars_round_trip_prunes(spark, sf_dir, tmp_path):
    bars = market.supplier_bars(spark, sf_dir)
    B.write_bars(bars, str(tmp_path / "bars"))
    wanted = universe.symbols_from_list(spark, ["S1", "S2", "S1"])
    back = B.read_bars(spark, str(tmp_path / "bars"), "1996-01-01", "1997-01-01", symbols=wanted, unique=True)
    want = B.between(bars.filter("Symbol IN ('S1', 'S2')"), "1996-01-01", "1997-01-01")
    assert back.exceptAll(want).count() == 0 and back.count() == want.count()
    plan = plan_of(back.select("Symbol", "Close"))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(Date" in plan and "Volume" not in plan.split("ReadSchema")[1]


def test_reuse_by_parameters(spark, sf_dir, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for options in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert files.reuse(spark, "t", options, build, [], str(tmp_path)).count() == 3
    assert len(calls) == 2


def test_reuse_sees_a_replaced_file(spark, tmp_path):
    source, made = str(tmp_path / "in.csv"), []

    def stored():
        rows = spark.read.schema("a int").csv(source)
        return files.reuse(spark, "t", {}, lambda: made.append(1) or rows, [rows], str(tmp_path / "kept"))

    for text, total, built in (("1\n2\n", 3, 1), ("1\n2\n", 3, 1), ("1\n20\n", 21, 2), ("5\n9\n", 14, 3)):
        if built > len(made):
            with open(source, "w") as f:
                f.write(text)
            os.utime(source, (1e9 + built, 1e9 + built))
            spark.catalog.refreshByPath(source)
        assert stored().agg(F.sum("a")).first()[0] == total
        assert len(made) == built
    with pytest.raises(ValueError, match="not read from files"):
        files.reuse(spark, "t", {}, lambda: spark.range(1), [spark.range(1)], str(tmp_path / "kept"))


def test_context_reader(spark, tmp_path):
    rows = [("^VIX", "2020-01-01", 20.0), ("VIX", "2020-01-01", 21.0), ("^VIX", "2020-01-02", float("nan")), ("SPY", "2020-01-02", 3.0), ("OTHER", "2020-01-02", 3.0), ("SPY", "2020-02-01", 4.0)]
    df = spark.createDataFrame(rows, "ctx_symbol string, d string, Close double").select("ctx_symbol", F.col("d").cast("date").alias("Date"), "Close")
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("header", True).csv(str(tmp_path / "c"))
    want = [("SPY", "2020-01-02", 3.0), ("VIX", "2020-01-01", 21.0), ("VIX", "2020-01-02", None)]
    for path, kind in (("p", "parquet"), ("c", "csv")):
        got = context.read_context(spark, str(tmp_path / path), "2020-01-01", "2020-02-01", ["^VIX", "SPY", "QQQ"], format=kind)
        assert sorted((r.ctx_symbol, str(r.Date), r.Close) for r in got.collect()) == want
    plan = plan_of(context.read_context(spark, str(tmp_path / "p"), "2020-01-01", "2020-02-01", ["^VIX"]))
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(Date" in pushed and "In(ctx_symbol" in pushed


def test_empty_panel_raises_when_asked(spark, stored):
    few = stored.select("Symbol", "Date", "Open", "High", "Low", "Close", "Volume").limit(20)
    with pytest.raises(ValueError, match="no symbol"):
        panel.feature_panel(few, features=["Return"], required=True)
    assert panel.feature_panel(few, features=["Return"]).isEmpty()


def test_scoring_looks_back_a_bounded_time(spark, stored):
    bars = stored.select("Symbol", "Date", "Open", "High", "Low", "Close", "Volume")
    model_rows = stored.dropna(subset=MODEL)
    scaler = scaling.fit_scaler(model_rows, MODEL)
    model = training.fit(scaler.transform(model_rows), MODEL, "Target_Direction_1d")
    today = "2000-03-01"
    got = scoring.predict_newest(bars, model, scaler, MODEL, today=today, lookback=400)
    recent = bars.filter("Date <= '2000-03-01' AND Date >= date_sub(DATE'2000-03-01', 400)")
    want = scoring.predict(panel.with_features(recent, MODEL), model, scaler, MODEL)
    assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert plan_of(got).count("GreaterThanOrEqual(Date") == 1


def test_history_and_predictions_files(spark, tmp_path):
    history = spark.createDataFrame([(1, 0.7), (2, 0.6)], "epoch int, val_loss double")
    files.write_history(history, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    assert not files.write_predictions(history.limit(0), str(tmp_path / "none"))
    assert files.write_predictions(history, str(tmp_path / "some"))


def test_wide_input_needs_all_fields(spark):
    wide = spark.sql("SELECT DATE'2020-01-01' AS Date, 1.0 AS `Open|A`, 1.0 AS `High|A`")
    with pytest.raises(ValueError, match="Low|A"):
        B.wide_to_bars(wide, ["A"])


def test_model_life_cycle(spark, stored, tmp_path):
    parts = splits.split_train_test(stored, 0.2)
    scaler = scaling.fit_scaler(parts.filter("split = 'train'"), MODEL)
    model = training.fit(scaler.transform(parts).filter("split = 'train'"), MODEL, "Target_Direction_1d")
    training.save(model, MODEL, scaler, str(tmp_path / "m"), horizon=1)
    again, features, loaded, config = training.load(str(tmp_path / "m"))
    assert features == MODEL and loaded == scaler and config == {"horizon": 1}
    one = scoring.predict(stored, model, scaler, MODEL)
    two = scoring.predict(stored, again, loaded, features)
    assert one.exceptAll(two).count() == 0 and one.count() == 6
    close = stored.groupBy("Symbol").agg(F.round(F.max_by("Close", "Date"), 2).alias("Close"))
    assert one.join(close, ["Symbol", "Close"]).count() == 6
    assert scoring.predict(stored, model, scaler, MODEL, length=10**6).count() == 0
    importance = training.feature_importance(model, 2).collect()
    assert len(importance) == 2 and importance[0].share == 1.0


def test_cut_days_are_a_pushed_filter(spark, stored):
    day = stored.agg(F.min("Date")).first()[0]
    plan = plan_of(splits.in_buckets(stored.select("Date", "Symbol"), F.col("Date"), [day]))
    assert "PushedFilters: [" in plan and "Date" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "Close" not in plan.split("ReadSchema")[1]


def test_walk_forward(spark, stored):
    folds = training.walk_forward_validate(stored, MODEL, n_splits=2).orderBy("fold").collect()
    assert [f.fold for f in folds] == [1, 2] and all(0 <= f.roc_auc <= 1 for f in folds)
    trees = training.walk_forward_validate(stored, MODEL, n_splits=1, kind="trees", maxIter=2).collect()
    assert len(trees) == 1
    with pytest.raises(ValueError, match="too few train rows"):
        training.walk_forward_validate(stored, MODEL, n_splits=5, test_size=0.2)


def test_search_and_regression(spark, stored):
    best, trials = training.search(stored, MODEL, {"regParam": [0.0, 0.5]}, n_splits=1, regression=True)
    assert set(best) == {"regParam"} and trials.count() == 2


def test_window_features_share_one_shuffle(spark, stored):
    bars = stored.select("Symbol", "Date", "Open", "High", "Low", "Close", "Volume")
    groups = panel.CATALOG.group("moving_average", "oscillator", "channel", "volume", "volatility", "statistics", "candle")
    plan = plan_of(panel.with_features(bars, groups))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_context_join_does_not_shuffle_bars(spark, sf_dir, stored):
    bars = stored.select("Symbol", "Date", "Open", "High", "Low", "Close", "Volume")
    plan = plan_of(panel.with_features(bars, ["VIX", "SPY_Corr_20"], market.context_bars(spark, sf_dir).persist()))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_splits_do_not_shuffle_the_panel(spark, stored):
    plan = plan_of(splits.walk_forward_splits(stored, 3, 0.1))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main
