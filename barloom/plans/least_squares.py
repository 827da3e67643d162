"""Least squares, its walk-forward validation and its search from one aggregate.

Everything a linear fit and its error need are sums of products of columns. Rows are summed once, by the
segment between fold edges they lie in; a fold's train rows are a prefix of the segments and its test
rows the segment after, so sums of sums give every fold and every penalty without reading the panel again. What
comes to the driver is one small matrix for each segment, bounded by columns and folds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from statistics import fmean, pstdev

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import splits
from barloom.plans.panel import target_column
from barloom.schema import KEY, TIME

FOLD_METRICS = "fold int, ridge double, rows bigint, mse double, rmse double, r2 double"


def product_sums(rows: DataFrame, columns: list[str], by: list[str]) -> dict[tuple[int, ...], np.ndarray]:
    """Sums of products of [1, columns] for each combination of the integer columns ``by``; rows with unknown values are left out.

    Tasks add up their batches as matrices, and only their totals are shuffled.
    """
    width = len(columns) + 1

    def run(batches):
        totals: dict[tuple[int, ...], np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(len(b)), b[columns].to_numpy(float)])
            for group, at in b.groupby(by, sort=False).indices.items():
                group = tuple(int(g) for g in np.atleast_1d(group))
                totals[group] = totals.get(group, 0.0) + x[at].T @ x[at]
        for group, m in totals.items():
            yield pd.DataFrame({c: g for c, g in zip(by, group)} | {"place": np.arange(width * width), "value": m.ravel()})

    keys = ", ".join(f"{c} int" for c in by)
    known = rows.select(*[F.col(c).cast("int").alias(c) for c in by], *[W.finite(F.col(c).cast("double")).alias(c) for c in columns]).dropna()
    sums = known.mapInPandas(run, f"{keys}, place int, value double").groupBy(*by, "place").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, ...], np.ndarray] = {}
    for r in sums.collect():  # a matrix for each group
        m = out.setdefault(tuple(r[c] for c in by), np.zeros(width * width))
        m[r["place"]] = r["value"]
    return {k: m.reshape(width, width) for k, m in out.items()}


def solve(sums: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and coefficients; the last column of ``sums`` is the target.

    ``ridge`` penalises coefficients of standardised features and target, as ``regParam`` of
    ``pyspark.ml`` does. Of features that depend on each other the shortest solution is taken.
    """
    n = sums[0, 0]
    mean = sums[0] / n
    spread = sums / n - np.outer(mean, mean)
    size = np.sqrt(np.clip(np.diag(spread), 0.0, None))
    scale = np.where(size > 1e-12 * (1 + np.abs(mean)), size, np.inf)[1:]
    unit = spread[1:, 1:] / np.outer(scale, scale)
    if not np.isfinite(scale[-1]):
        return np.concatenate([[mean[-1]], np.zeros(len(mean) - 2)])
    left = unit[:-1, :-1] + np.diag(np.where(np.isfinite(scale[:-1]), ridge / scale[-1], 0.0))
    found = np.linalg.lstsq(left, unit[:-1, -1], rcond=1e-12)[0] * scale[-1] / scale[:-1]
    return np.concatenate([[mean[-1] - found @ mean[1:-1]], found])


def errors(sums: np.ndarray, fitted: np.ndarray) -> tuple[int, float, float, float | None]:
    """Rows, mean squared error, its root, and R2 (None for a constant target) on the rows summed up."""
    n = sums[0, 0]
    gap = np.append(-fitted, 1.0)
    mse = max(gap @ sums @ gap / n, 0.0)
    spread = sums[-1, -1] / n - (sums[0, -1] / n) ** 2
    return int(n), float(mse), float(np.sqrt(mse)), float(1 - mse / spread) if spread > 0 else None


def _fold_sums(panel, features, target, n_splits, test_size, embargo):
    """(train, test) sums of every fold, by fold from 1."""
    rows = panel.select(KEY, TIME, *features, F.col(target).alias("_target")).dropna()
    edges = splits.fold_edges(rows, n_splits, test_size)
    own = F.struct(TIME, KEY)
    passed = lambda test: sum((F.coalesce(test(e), F.lit(False)).cast("int") for e in edges.values()), F.lit(0))
    ends = F.lead(TIME, embargo).over(W.by_symbol()) if embargo else F.lit(None).cast("date")
    placed = rows.withColumn("_ends", ends)
    # Segment: edges at or before the row. Reach: edges whose day the row's label reaches.
    placed = placed.withColumn("_segment", passed(lambda e: own >= e)).withColumn("_reach", passed(lambda e: F.col("_ends") >= e[TIME]))
    sums = product_sums(placed, [*features, "_target"], ["_segment", "_reach"])
    width = len(features) + 2
    pick = lambda test: sum((m for (s, r), m in sums.items() if test(s, r)), np.zeros((width, width)))
    for place, k in enumerate(sorted(edges)):
        yield k + 1, pick(lambda s, r, j=place: s <= j and r <= j), pick(lambda s, r, j=place: s == j + 1)


def validate(
    panel: DataFrame,
    features: list[str],
    horizon: int = 1,
    n_splits: int = 5,
    test_size: float = 0.1,
    ridges: Iterable[float] = (0.0,),
    embargo: int = 0,
    min_train: int = 50,
) -> DataFrame:
    """Walk-forward errors of linear regressions on a horizon's return, one row per fold and penalty.

    Three passes over the panel, whatever the number of folds and penalties: two find the edges, one sums
    products. Scaling does not change these fits. Rows with an unknown feature or target are left out.
    Raises when the first train part is too small to mean anything.
    """
    target = target_column(panel, horizon, True)
    out = []
    for fold, train, test in _fold_sums(panel, features, target, n_splits, test_size, embargo):
        if train[0, 0] < max(min_train, 1) and not out:
            raise ValueError("the first fold has too few train rows; use fewer folds or a smaller test_size")
        if test[0, 0]:
            out += [(fold, float(ridge), *errors(test, solve(train, ridge))) for ridge in ridges]
    if not out:
        raise ValueError("no fold has train rows; use fewer folds or a smaller test_size")
    return SparkSession.active().createDataFrame(out, FOLD_METRICS)


def search(panel: DataFrame, features: list[str], ridges: Iterable[float], **options) -> tuple[dict, DataFrame]:
    """Best penalty by mean walk-forward RMSE, and (options, mean, std) of all."""
    found: dict[float, list[float]] = {}
    for r in validate(panel, features, ridges=ridges, **options).collect():  # one row per fold and penalty
        found.setdefault(r["ridge"], []).append(r["rmse"])
    trials = [(json.dumps({"regParam": ridge}), fmean(values), pstdev(values)) for ridge, values in found.items()]
    table = SparkSession.active().createDataFrame(trials, "options string, mean double, std double")
    return json.loads(min(trials, key=lambda t: t[1])[0]), table
