"""Scoring the newest window of every symbol."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import cleaning, splits
from barloom.operators.scaling import Scaler
from barloom.plans import training
from barloom.plans.panel import with_features
from barloom.schema import DOWN_LABEL, KEY, TIME, UP_LABEL
from barloom.sources import bars as B

LOOKBACK_DAYS = 500
UP, LOW = 0.55, 0.45
BAR_WIDTH = 18


def latest_windows(panel: DataFrame, features: list[str], length: int = 30, spare: int = 5) -> DataFrame:
    """Per symbol the newest ``length`` feature rows, oldest first, as ``sequence``.

    Also the date and close of the newest row. Symbols with fewer than
    ``length + spare`` rows are left out.
    """
    narrow = panel.select(KEY, TIME, "Close", F.array(*[F.col(f).cast("float") for f in features]).alias("_v"))
    newest = splits.latest_rows(narrow, length, spare)
    # at most `length` rows per symbol are gathered
    found = newest.groupBy(KEY).agg(
        F.max(TIME).alias(TIME),
        F.max_by("Close", TIME).alias("Close"),
        F.array_sort(F.collect_list(F.struct(TIME, "_v"))).alias("_rows"),
    )
    return found.select(KEY, TIME, "Close", F.transform("_rows", lambda r: r["_v"]).alias("sequence"))


def prediction_columns(score) -> dict[str, F.Column]:
    """Probability, direction and confidence of a logit."""
    chance = 1 / (1 + F.exp(-score))
    return {
        "Pred_Prob": F.round(chance, 4),
        "Direction": F.when(chance > 0.5, UP_LABEL).otherwise(DOWN_LABEL),
        "Confidence": F.round(F.abs(chance - 0.5) * 2, 4),
    }


def predictions(scored: DataFrame, horizon: int = 1) -> DataFrame:
    """Scored newest rows as the prediction table."""
    made = prediction_columns(F.col("score"))
    return scored.select(
        KEY,
        F.date_format(TIME, "yyyy-MM-dd").alias(TIME),
        F.round("Close", 2).alias("Close"),
        F.lit(horizon).alias("Horizon_Days"),
        *[c.alias(n) for n, c in made.items()],
    )


def with_bands(table: DataFrame) -> DataFrame:
    """Strength band of the probability and a bar length for the confidence."""
    p = F.col("Pred_Prob")
    band = F.when(p > UP, "up").when(p < LOW, "down").otherwise("flat")
    return table.select("*", band.alias("Band"), F.floor(F.col("Confidence") * BAR_WIDTH).cast("int").alias("Bar"))


def by_probability(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("Pred_Prob"), KEY)


def predict(
    panel: DataFrame,
    model: PipelineModel,
    scaler: Scaler,
    features: list[str],
    horizon: int = 1,
    length: int = 30,
    spare: int = 5,
) -> DataFrame:
    """Newest row of every symbol with enough rows, scored by a linear or tree model.

    Features are scaled with the stored training statistics; missing columns
    count as 0 and missing values as the symbol's mean. ``Close`` and ``Date``
    are the raw ones.
    """
    close = F.col("Close").alias("_raw_close")
    aligned = scaler.transform(cleaning.align_features(panel, features, keep=[KEY, TIME, close]))
    # One aggregate with map-side combine: a row count, the newest row and the means, one row per symbol.
    known = [W.finite(F.col(f).cast("double")) for f in features]
    row = F.struct(F.col(TIME), F.col("_raw_close"), *[x.alias(f"f{i}") for i, x in enumerate(known)])
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(known)]
    newest = aligned.groupBy(KEY).agg(F.count("*").alias("_rows"), F.max_by(row, TIME).alias("_new"), *means)
    newest = newest.filter(F.col("_rows") >= length + spare)
    filled = [F.coalesce(F.col(f"_new.f{i}"), F.col(f"m{i}"), F.lit(0.0)).alias(f) for i, f in enumerate(features)]
    latest = newest.select(KEY, f"_new.{TIME}", "_new._raw_close", *filled)
    scored = training.apply(model, latest).select(KEY, TIME, F.col("_raw_close").alias("Close"), "score")
    return predictions(scored, horizon)


def predict_newest(
    bars: DataFrame,
    model: PipelineModel,
    scaler: Scaler,
    features: list[str],
    today: str | None = None,
    lookback: int = LOOKBACK_DAYS,
    horizon: int = 1,
    length: int = 30,
    spare: int = 5,
    **tables,
) -> DataFrame:
    """``predict`` on the bars of the last ``lookback`` days up to ``today``, the current day if not given.

    The bounds on the date reach the scan of the bars, and features are built on what is left, once. ``tables`` are the
    context, sector and fundamental tables of ``panel.with_features``.
    """
    start, end = B.default_range(lookback, today)
    recent = B.between(bars, start, F.date_add(end, 1))
    return predict(with_features(recent, features, **tables), model, scaler, features, horizon, length, spare)
