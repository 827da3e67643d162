"""Losses and quality figures of scored tables.

A scored table has ``label`` (0/1) and ``score`` (a logit), or ``y`` and
``score`` for regression, and any grouping columns such as ``fold``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.search import with_place
from barloom.session import spread

# Tasks that share the rows of one frequent score.
_SPREAD = 64


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(label: Column, score: Column, pos_weight: Column | float = 1.0) -> Column:
    """Cross-entropy of a logit."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return weight * label * softplus(-score) + (1 - label) * softplus(score)


def focal(label: Column, score: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    plain = bce(label, score)
    return alpha * F.pow(1 - F.exp(-plain), F.lit(gamma)) * plain


def smoothed(label: Column, amount: float = 0.1) -> Column:
    """Labels moved towards one half."""
    return label * (1 - amount) + amount / 2


def _share(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``by`` in which NULL meets NULL; the left side's keys stay."""
    right = right.withColumnsRenamed({c: f"_{c}_of_right" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_of_right")) for c in by]
    return left.join(right, same).drop(*[f"_{c}_of_right" for c in by])


def _count(condition) -> Column:
    return F.count_if(condition).cast("double")


def classification_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined) per group.

    Rows without a label or a score count in ``rows`` only.
    """
    by = by or []
    hit, real = F.col("score") > 0, F.col("label") > 0.5
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("rows"),
        _count(F.col("score").isNotNull() & F.col("label").isNotNull()).alias("known"),
        _count(hit & real).alias("tp"),
        _count(hit & ~real).alias("fp"),
        _count(~hit & real).alias("fn"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "known"))
    return counts.select(
        *by,
        "rows",
        _share(n - fp - fn, n).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(scored: DataFrame, by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Area under the ROC curve from ranks, ties counted half; 0 for one class.

    Equal scores are counted together first. The running count over scores is
    split at sketched quantiles: each bucket is summed and walked on its own,
    and the sums of the lower buckets are added.
    """
    by = by or []
    distinct = scored.groupBy(*by, "score").agg(
        _count(F.col("label") > 0.5).alias("pos"), _count(F.col("label") <= 0.5).alias("neg")
    )
    probs = [i / buckets for i in range(1, buckets)]
    # The counts are looked at so that no pruning parts this from the rows below: one shuffle serves both.
    counted = F.when(F.col("pos") + F.col("neg") > 0, F.col("score"))
    edges = distinct.groupBy(*by).agg(F.percentile_approx(counted, probs, 4 * buckets).alias("_edges"))
    if by:
        placed = null_safe_join(distinct, edges, by)
    else:
        placed = distinct.withColumn("_edges", edges.scalar())
    placed = with_place(placed, "_b", "_edges", buckets - 1, lambda e: e < F.col("score"))
    placed = placed.select(*by, "score", "pos", "neg", "_b")
    walked = placed.withColumn(
        "_below",
        F.sum("neg").over(Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("neg"),
    )
    # within a bucket: wins against lower scores of the same bucket, half of ties
    part = walked.groupBy(*by, "_b").agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("wins"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
    )
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("_lower", F.sum("neg").over(order) - F.col("neg"))
    total = part.groupBy(*by).agg(
        F.sum(F.col("wins") + F.col("pos") * F.col("_lower")).alias("wins"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
    )
    return total.select(*by, _share(F.col("wins"), F.col("pos") * F.col("neg")).alias("roc_auc"))


def roc_auc_by_number(scored: DataFrame, by: str, some: DataFrame, buckets: int = 256) -> DataFrame:
    """``roc_auc`` for a few groups with numbers from 0 in ``by``, when most scores differ.

    Equal scores are not counted first, which would move nearly all rows once more: every row is shuffled once, to its cell. Cells
    lie between sketched quantiles of ``some`` rows like these, as many of each group, which only decide how the work is cut up. What
    a cell holds is sorted and counted on its own. Scores equal to an edge, as every frequent one is, unknown ones (lowest)
    and NaN (highest) are cells that need no order and are spread over tasks.
    """
    side = F.when(F.col("label") > 0.5, 1).when(F.col("label") <= 0.5, -1).otherwise(0).cast("tinyint")
    probs = [i / buckets for i in range(1, buckets)]
    known = F.when(~F.isnan("score"), F.col("score"))
    edges = some.groupBy(by).agg(F.percentile_approx(known, probs, 4 * buckets).alias("_edges"))
    edges = edges.agg(F.map_from_entries(F.collect_list(F.struct(by, "_edges")))).scalar()
    rows = scored.select(by, F.col("score").cast("double").alias("score"), side.alias("_side"))
    rows = rows.withColumn("_edges", F.try_element_at(edges, F.col(by)))
    placed = with_place(rows, "_b", "_edges", buckets - 1, lambda e: e < F.col("score"))
    # odd cells are between edges, even ones level
    level = F.when(F.col("score").isNull(), 0).when(F.isnan("score"), 2 * buckets + 2)
    level = level.when(F.get("_edges", "_b") == F.col("score"), 2 + 2 * F.col("_b"))
    placed = placed.withColumn("_level", level).withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(_SPREAD)))
    group, cells = F.col(by).cast("bigint"), 2 * buckets + 3
    cell = F.when(F.col("_level").isNull(), group * _SPREAD * cells + 1 + 2 * F.col("_b"))
    cell = cell.otherwise((group * _SPREAD + F.col("_task")) * cells + F.col("_level")).alias("_cell")
    sent = placed.select(cell, F.when(F.col("_level").isNull(), F.col("score")).otherwise(0.0).alias("score"), "_side")
    part = spread(sent, "_cell").groupBy("_cell").applyInArrow(_pairs, "_cell bigint, wins double, pos double, neg double")
    number = F.floor(F.col("_cell") / (_SPREAD * cells)).cast(scored.schema[by].dataType)
    part = part.groupBy(number.alias(by), F.pmod("_cell", F.lit(cells)).alias("_cell"))
    part = part.agg(*[F.sum(c).alias(c) for c in ("wins", "pos", "neg")])
    part = part.withColumn("wins", F.when(F.col("_cell") % 2 == 1, F.col("wins")).otherwise(F.col("pos") * F.col("neg") / 2))
    order = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("_lower", F.sum("neg").over(order) - F.col("neg"))
    wins = F.sum(F.col("wins") + F.col("pos") * F.col("_lower"))
    return part.groupBy(by).agg(_share(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def _pairs(cell: pa.Table) -> pa.Table:
    """Positives, negatives and wins of positives over negatives, half of ties, of one cell."""
    score, side = cell["score"].to_numpy(), cell["_side"].to_numpy()
    pos, neg = np.sort(score[side > 0]), np.sort(score[side < 0])
    wins = (np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()) / 2
    values = {"wins": [float(wins)], "pos": [float(len(pos))], "neg": [float(len(neg))]}
    return pa.table({"_cell": cell["_cell"].slice(0, 1)} | values)


def regression_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean squared error, its root and R2; R2 is NULL for a constant target."""
    by = by or []
    error = (F.col("y") - F.col("score")) * (F.col("y") - F.col("score"))
    sums = scored.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(error).alias("mse"), F.var_pop("y").alias("_spread")
    )
    return sums.select(
        *by, "rows", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "_spread")).alias("r2")
    )


def positive_weight(labels: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Negatives per positive; NULL unless both classes are there."""
    pos, neg = _count(F.col(label) > 0.5), _count(F.col(label) <= 0.5)
    return labels.groupBy(*(by or [])).agg(
        F.when((pos > 0) & (neg > 0), F.try_divide(neg, pos)).alias("pos_weight")
    )


def loss(scored: DataFrame, kind: str = "bce", by: list[str] | None = None, **options) -> DataFrame:
    """Row-average loss per group: ``bce``, ``focal``, ``smoothed`` or ``mse``."""
    return scored.groupBy(*(by or [])).agg(F.avg(row_loss(kind, **options)).alias("loss"))


def row_loss(kind: str, pos_weight: Column | float = 1.0, **options) -> Column:
    label, score = F.col("label").cast("double"), F.col("score")
    if kind == "bce":
        return bce(label, score, pos_weight)
    if kind == "focal":
        return focal(label, score, **options)
    if kind == "smoothed":
        return bce(smoothed(label, **options), score, pos_weight)
    if kind == "mse":
        return (F.col("y") - score) * (F.col("y") - score)
    raise ValueError(f"unknown loss {kind!r}")


def batch_mean_loss(batched: DataFrame, kind: str = "bce", **options) -> DataFrame:
    """Mean over batches of the mean loss within each batch (``batch_id``)."""
    per_batch = batched.groupBy("batch_id").agg(F.avg(row_loss(kind, **options)).alias("loss"))
    return per_batch.agg(F.count("*").alias("batches"), F.avg("loss").alias("loss"))


def multi_horizon_loss(scored: DataFrame, horizons: list[int]) -> DataFrame:
    """Mean over horizons of the loss of ``label_h`` against ``score_h``."""
    heads = [
        F.struct(
            F.lit(f"h{h}").alias("horizon"),
            F.col(f"label_{h}").cast("double").alias("label"),
            F.col(f"score_{h}").alias("score"),
        )
        for h in horizons
    ]
    rows = scored.select(F.explode(F.array(*heads)).alias("x")).select("x.*")
    per_head = rows.groupBy("horizon").agg(F.avg(row_loss("bce")).alias("loss"))
    return per_head.agg(F.avg("loss").alias("loss"))


def fold_summary(folds: DataFrame, metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return folds.agg(
        F.count("*").alias("folds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")
    )


def best_epoch(history: DataFrame, metric: str, larger_is_better: bool = True) -> DataFrame:
    """The first epoch with the best value."""
    signed = F.col(metric) if larger_is_better else -F.col(metric)
    key = F.struct(signed, -F.col("epoch"))
    return history.agg(F.max_by("epoch", key).alias("epoch"), F.max_by(metric, key).alias(metric))


def last_epochs(history: DataFrame, n: int = 15) -> DataFrame:
    return history.orderBy(F.desc("epoch")).limit(n)
