"""Least squares from sums of products against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import splits
from barloom.plans import least_squares, training

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    made = []
    for s in "ABCD":
        for d in range(90):
            a, b = rng.normal(100, 1), rng.normal(0, 1e-3)
            made.append((s, int(d), a, b, 2 * a - 5e3 * b if s == "D" else rng.normal(), 0.3 * a - 40 * b + rng.normal()))
    made[7] = (*made[7][:2], None, *made[7][3:])
    made[9] = (*made[9][:5], float("nan"))
    df = spark.createDataFrame(made, "Symbol string, d int, a double, b double, c double, Target_Return_1d double")
    return df.select("Symbol", F.date_add(F.lit("2020-01-01").cast("date"), "d").alias("Date"), *X, "Target_Return_1d").persist()


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_folds_are_fits_on_their_rows(rows, ridge):
    got = {r.fold: r for r in least_squares.validate(rows, X, n_splits=3, ridges=[ridge]).collect()}
    known = rows.filter("a IS NOT NULL AND NOT isnan(Target_Return_1d)")
    folds = splits.walk_forward_splits(known, 3, 0.1)
    assert sorted(got) == [1, 2, 3]
    for k, r in got.items():
        part = folds.filter(F.col("fold") == k)
        model = training.fit(part.filter("role = 'train'"), X, "Target_Return_1d", regression=True, regParam=ridge)
        want = training.evaluate(training.apply(model, part.filter("role = 'test'")), "Target_Return_1d", True).first()
        assert r.rows == want.rows
        assert np.allclose((r.mse, r.rmse, r.r2), (want.mse, want.rmse, want.r2), rtol=1e-7)


def test_embargo_leaves_out_reaching_rows(rows):
    known = rows.filter("a IS NOT NULL AND NOT isnan(Target_Return_1d)")
    folds = splits.walk_forward_splits(known, 3, 0.1, embargo=5)
    free = {r.fold: r.mse for r in least_squares.validate(rows, X, n_splits=3).collect()}
    for r in least_squares.validate(rows, X, n_splits=3, embargo=5).collect():
        train = folds.filter((F.col("fold") == r.fold) & (F.col("role") == "train")).toPandas()
        test = folds.filter((F.col("fold") == r.fold) & (F.col("role") == "test")).toPandas()
        one = lambda f: np.column_stack([np.ones(len(f)), f[X]])
        fitted = np.linalg.lstsq(one(train), train["Target_Return_1d"], rcond=None)[0]
        assert np.isclose(r.mse, np.mean((test["Target_Return_1d"] - one(test) @ fitted) ** 2), rtol=1e-7)
        assert r.mse != free[r.fold]


def test_dependent_constant_and_unknown(rows):
    twin = rows.withColumn("b", F.col("a") * 2).withColumn("c", F.lit(3.0))
    got = least_squares.validate(twin, X, n_splits=1).first()
    alone = least_squares.validate(twin, ["a"], n_splits=1).first()
    assert np.isclose(got.mse, alone.mse, rtol=1e-9)
    flat = least_squares.validate(rows.withColumn("Target_Return_1d", F.lit(1.5)), X, n_splits=1).first()
    assert flat.mse < 1e-20 and flat.r2 is None
    with pytest.raises(ValueError, match="train rows"):
        least_squares.validate(rows.limit(0), X)
    with pytest.raises(ValueError, match="train rows"):
        least_squares.validate(rows, X, n_splits=9, test_size=0.1, min_train=200)
    best, table = least_squares.search(rows, X, [0.0, 50.0], n_splits=2)
    assert best == {"regParam": 0.0} and table.count() == 2


def test_a_fold_is_a_filter(rows):
    keyed = rows.select("Symbol", "Date", "a")
    edges = splits.fold_edges(keyed, 3, 0.1)
    whole = splits.walk_forward_splits(keyed, 3, 0.1, embargo=4)
    for k in edges:
        want = whole.filter(F.col("fold") == k + 1).select("Symbol", "Date", "role")
        got = splits.fold_rows(keyed, edges, k, embargo=4).select("Symbol", "Date", "role")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
