"""Fitting, walk-forward validation, search, importance and storage of models.

Models come from ``pyspark.ml`` and train on distributed rows; the driver only
holds coefficients and one metric row per fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from statistics import fmean, pstdev

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import metrics, scaling, splits
from barloom.plans.panel import target_column
from barloom.schema import HORIZONS, KEY, TIME


def _estimator(kind: str, regression: bool, **options):
    if kind == "linear":
        made = LinearRegression if regression else LogisticRegression
        if not regression:  # as near to the optimum as doubles allow, so that runs and engines agree
            options = {"tol": 1e-9, "maxIter": 200} | options
    elif kind == "trees":
        made = GBTRegressor if regression else GBTClassifier
    else:
        raise ValueError(f"unknown model {kind!r}")
    return made(featuresCol="_features", labelCol="_target", weightCol="_weight", **options)


def fit(
    train: DataFrame, features: list[str], target: str, kind: str = "linear", regression: bool = False, **options
) -> PipelineModel:
    """Fit on the given rows.

    A classifier weights positives by negatives per positive, so both classes
    carry the same total weight.
    """
    rows = train.select(*features, F.col(target).cast("double").alias("_target")).filter("_target IS NOT NULL")
    weight = F.lit(1.0)
    if not regression:
        ratio = metrics.positive_weight(rows, "_target").first()["pos_weight"] or 1.0
        weight = F.when(F.col("_target") > 0.5, F.lit(float(ratio))).otherwise(F.lit(1.0))
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")
    ready = assembler.transform(rows.withColumn("_weight", weight))
    return PipelineModel([assembler, _estimator(kind, regression, **options).fit(ready)])


def apply(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` plus ``score`` (a logit, or the predicted value) and, for a
    classifier, ``probability`` of the positive class."""
    scored = model.transform(rows)
    if "rawPrediction" in scored.columns:
        raw = vector_to_array("rawPrediction")[1]
        chance = vector_to_array("probability")[1]
        return scored.select(*rows.columns, raw.alias("score"), chance.alias("probability"))
    return scored.select(*rows.columns, F.col("prediction").alias("score"))


def evaluate(scored: DataFrame, target: str, regression: bool = False, by: list[str] | None = None) -> DataFrame:
    """One metric row per group, loss included."""
    by = by or []
    if regression:
        return metrics.regression_metrics(scored.withColumn("y", F.col(target)), by)
    rows = scored.withColumn("label", F.col(target).cast("double"))
    table = metrics.classification_metrics(rows, by)
    for other in (metrics.roc_auc(rows, by), metrics.loss(rows, "bce", by)):
        if by:
            table = metrics.null_safe_join(table, other, by)
        else:
            table = table.withColumn(other.columns[0], other.scalar())
    return table


def _prepared_folds(panel, features, target, n_splits, test_size, scaler, embargo, min_train):
    """``(fold, train rows, test rows)``, scaled by the fold's train rows.

    A fold is the panel filtered by its edges; it is kept in memory or on disk while the caller works on it.
    """
    rows = panel.select(KEY, TIME, *features, target).filter(F.col(target).isNotNull())
    edges = splits.fold_edges(rows, n_splits, test_size)
    if not edges:
        raise ValueError("the first fold has too few train rows; use fewer folds or a smaller test_size")
    for number, fold in enumerate(sorted(edges)):
        part = splits.fold_rows(rows, edges, fold, embargo)
        if not number and part.filter("role = 'train'").count() < min_train:
            raise ValueError("the first fold has too few train rows; use fewer folds or a smaller test_size")
        fitted = scaling.fit_scaler(part.filter("role = 'train'"), features, scaler)
        ready = fitted.transform(part).persist()
        try:
            yield fold + 1, ready.filter("role = 'train'"), ready.filter("role = 'test'")
        finally:
            ready.unpersist()


def _fit_and_measure(train, test, features, target, kind, regression, options):
    """Metric table's schema and its one row."""
    model = fit(train, features, target, kind, regression, **options)
    scored = apply(model, test).select(target, "score").persist()
    try:
        table = evaluate(scored, target, regression)
        return table.schema, table.first()
    finally:
        scored.unpersist()


def walk_forward_validate(
    panel: DataFrame,
    features: list[str],
    horizon: int = 1,
    n_splits: int = 5,
    test_size: float = 0.1,
    kind: str = "linear",
    regression: bool = False,
    scaler: str = "robust",
    embargo: int = 0,
    min_train: int = 50,
    **options,
) -> DataFrame:
    """Per fold: scale by its train rows, fit, score its test rows.

    One metric row per fold. The panel is read several times, so pass a stored
    table. Raises when the first train part is too small to mean anything.
    """
    target = target_column(panel, horizon, regression)
    results, schema = [], None
    for fold, train, test in _prepared_folds(
        panel, features, target, n_splits, test_size, scaler, embargo, min_train
    ):
        schema, row = _fit_and_measure(train, test, features, target, kind, regression, options)
        results.append((fold, *row))
    fields = [T.StructField("fold", T.IntegerType()), *schema.fields]
    return panel.sparkSession.createDataFrame(results, T.StructType(fields))


def search(
    panel: DataFrame,
    features: list[str],
    grid: dict[str, list],
    horizon: int = 1,
    n_splits: int = 3,
    test_size: float = 0.1,
    kind: str = "linear",
    regression: bool = False,
    scaler: str = "robust",
    embargo: int = 0,
    min_train: int = 50,
) -> tuple[dict, DataFrame]:
    """Best options by mean walk-forward AUC (or RMSE), and all results.

    Every fold is prepared once and serves all options. Give it train rows only;
    the held-out rows are scored once, afterwards. ``least_squares.search`` does penalties of a
    linear regression without preparing folds.
    """
    builder = ParamGridBuilder()
    model = _estimator(kind, regression)
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    choices = [{p.name: v for p, v in params.items()} for params in builder.build()]
    metric = "rmse" if regression else "roc_auc"
    target = target_column(panel, horizon, regression)
    found: list[list[float]] = [[] for _ in choices]
    for _, train, test in _prepared_folds(panel, features, target, n_splits, test_size, scaler, embargo, min_train):
        for values, options in zip(found, choices):
            row = _fit_and_measure(train, test, features, target, kind, regression, options)[1]
            values.append(float(row[metric]))
    trials = [
        (json.dumps(options, sort_keys=True), fmean(values), pstdev(values))
        for options, values in zip(choices, found)
    ]
    table = panel.sparkSession.createDataFrame(trials, "options string, mean double, std double")
    best = (min if regression else max)(trials, key=lambda t: t[1])
    return json.loads(best[0]), table


def fit_horizons(train: DataFrame, features: list[str], horizons: Iterable[int] = HORIZONS, **options) -> dict:
    """One classifier per horizon."""
    return {h: fit(train, features, f"Target_Direction_{h}d", **options) for h in horizons}


def apply_horizons(models: dict, rows: DataFrame) -> DataFrame:
    """Scores of all horizons below each other, with ``horizon``."""
    out = None
    for h, model in models.items():
        scored = apply(model, rows).withColumn("horizon", F.lit(h))
        out = scored if out is None else out.unionByName(scored)
    return out


def feature_importance(model: PipelineModel, top: int = 25) -> DataFrame:
    """Largest sensitivities of the score: ``Feature, Importance, place``.

    The slope of a linear score, or the importances of a tree ensemble.
    """
    names = model.stages[0].getInputCols()
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(n, abs(float(v))) for n, v in zip(names, values.toArray())]
    spark = SparkSession.active()
    table = spark.createDataFrame(rows, "Feature string, Importance double")
    ranked = splits.top_rows(table, "Importance", top, "Feature")
    scale = table.agg(F.max("Importance")).scalar()
    return ranked.withColumn("share", F.coalesce(F.try_divide("Importance", scale), F.lit(0.0)))


def permutation_importance(
    rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], label: str, top: int = 25, seed: int = 42
) -> DataFrame:
    """How much AUC a score loses when one feature comes from another row: ``Feature, roc_auc, Importance, place``.

    Rows in order of day and symbol are paired with rows in order of a seeded hash, one permutation for all features. Each row is
    scored once as it is and once per feature with that one from its partner, in a single pass, and all areas come from one
    shuffle of the scores. ``score`` adds a column of that name. ``rows`` is read several times, so pass a stored table.
    """
    known = rows.select(KEY, TIME, *features, F.col(label).cast("double").alias("label")).filter("label IS NOT NULL")
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(KEY), F.col(TIME).cast("date").cast("string")))

    def scored(part: DataFrame) -> DataFrame:
        paired = splits.with_partner(part, drawn, ["label", *features], features, "_other")
        # numbers of the features are shorter to shuffle than their names; 0 is no feature
        taken = paired.withColumn("Feature", F.explode(F.array(*[F.lit(i) for i in range(len(features) + 1)])))
        mixed = [F.when(F.col("Feature") == i, F.col("_other")[f]).otherwise(F.col(f)).alias(f) for i, f in enumerate(features, 1)]
        return score(taken.select("Feature", "label", *mixed)).select("Feature", "label", "score")

    some = known.filter(F.pmod(F.xxhash64(KEY, TIME), F.lit(32)) == 0)
    areas = metrics.roc_auc_by_number(scored(known), "Feature", scored(some))
    areas = areas.withColumn("Feature", F.get(F.array(*[F.lit(f) for f in ["", *features]]), F.col("Feature")))
    # one row per feature
    whole = F.max(F.when(F.col("Feature") == "", F.col("roc_auc"))).over(Window.partitionBy(F.lit(0)))
    losses = areas.withColumn("Importance", whole - F.col("roc_auc")).filter("Feature <> ''")
    return splits.top_rows(losses, "Importance", top, "Feature").select("Feature", "roc_auc", "Importance", "place")


def save(model: PipelineModel, features: list[str], scaler: scaling.Scaler, path: str, **config) -> None:
    """Model, feature list, scaling statistics and options below one folder."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    scaler.save(spark, f"{path}/scaler")
    row = [(json.dumps(features), json.dumps(config))]
    spark.createDataFrame(row, "features string, config string").coalesce(1).write.mode("overwrite").json(
        f"{path}/features"
    )


def load(path: str) -> tuple[PipelineModel, list[str], scaling.Scaler, dict]:
    spark = SparkSession.active()
    row = spark.read.schema("features string, config string").json(f"{path}/features").first()
    return (
        PipelineModel.load(f"{path}/model"),
        json.loads(row.features),
        scaling.Scaler.load(spark, f"{path}/scaler"),
        json.loads(row.config),
    )
