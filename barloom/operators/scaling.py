"""Min-max and robust scaling with statistics from chosen rows."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.schema import KEY, TIME, is_target

_FILL = {"minmax": 0.5, "robust": 0.0}


def scalable_columns(df: DataFrame, exclude: Iterable[str] | None = None) -> list[str]:
    """Numeric columns outside ``exclude`` (keys, sector and targets by default)."""
    if exclude is None:
        exclude = [KEY, TIME, "Sector"] + [c for c in df.columns if is_target(c)]
    skip = set(exclude)
    return [n for n, t in df.dtypes if n not in skip and (t in ("double", "float", "int", "bigint"))]


@dataclass(frozen=True)
class Scaler:
    """Fitted per-column centre and divisor; one pair per column."""

    kind: str
    stats: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        """A plain projection; unknown values become the neutral fill."""
        fill = F.lit(_FILL[self.kind])
        scaled = {}
        for name, (centre, divisor) in self.stats.items():
            if name not in df.columns:
                continue
            if centre is None:
                scaled[name] = fill
            else:
                value = W.finite(F.col(name).cast("double"))
                scaled[name] = F.coalesce((value - F.lit(centre)) / F.lit(divisor), fill)
        return df.select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.kind, json.dumps(self.stats))]
        spark.createDataFrame(rows, "kind string, stats string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scaler":
        row = spark.read.schema("kind string, stats string").json(path).first()
        return Scaler(row.kind, {k: tuple(v) for k, v in json.loads(row.stats).items()})


def _cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[W.finite(F.col(c).cast("double")).alias(c) for c in columns])


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 2000) -> DataFrame:
    """Exact linearly interpolated quantiles: ``(column, p, n, value)``.

    A mergeable sketch brackets every quantile; a second pass counts per task what lies
    below and above the brackets, a few numbers for each column, and hands on only the distinct values inside with
    their counts. So no task ever holds a column, no cell is copied, and the answer is still exact; a value held
    by many rows is one row.
    """
    wide = _cleaned(df, columns)
    margin = 2.0 / accuracy
    edges = [min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)]
    # one row, bounded by the schema
    sketch = wide.agg(*[F.percentile_approx(c, edges, accuracy).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    brackets = np.array([[np.nan] * len(edges) if q is None else q for q in sketch], dtype=float).reshape(len(columns), len(probs), 2)
    known = [k for k in range(len(columns)) if not np.isnan(brackets[k]).any()]

    def count(batches):
        below, above = np.zeros(brackets.shape[:2], np.int64), np.zeros(brackets.shape[:2], np.int64)
        for b in batches:
            x, inside = b.to_numpy(dtype=float), []
            for k in known:
                v = x[:, k][~np.isnan(x[:, k])]
                for q, (low, high) in enumerate(brackets[k]):
                    under, over = v < low, v > high
                    below[k, q] += under.sum()
                    above[k, q] += over.sum()
                    value, rows = np.unique(v[~(under | over)], return_counts=True)
                    inside.append(pd.DataFrame({"k": k, "i": q, "side": 0, "value": value, "rows": rows}))
            if inside:
                yield pd.concat(inside, ignore_index=True)
        for side, total in ((-1, below), (1, above)):
            k, q = np.nonzero(total)
            yield pd.DataFrame({"k": k, "i": q, "side": side, "value": np.nan, "rows": total[k, q]})

    narrow = wide.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    cells = narrow.mapInPandas(count, "k int, i int, side int, value double, rows bigint")
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("k"))
    p = F.get(F.array(*[F.lit(float(x)) for x in probs]), F.col("i"))
    counted = cells.groupBy(name.alias("column"), p.alias("p"), "i", "side", "value").agg(F.sum("rows").alias("rows"))
    order = Window.partitionBy("column", "i").orderBy("side", "value")
    running = counted.select(
        "*",
        F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("rows").over(Window.partitionBy("column", "i")).alias("n"),
    )
    at = F.col("p") * (F.col("n") - 1)
    inside = F.col("side") == 0
    found = running.groupBy("column", "p", "i", "n").agg(
        F.min(F.when(inside & (F.col("upto") > F.floor(at)), F.col("value"))).alias("lower"),
        F.min(F.when(inside & (F.col("upto") > F.ceil(at)), F.col("value"))).alias("upper"),
        F.coalesce(F.max(F.when(F.col("side") == -1, F.col("upto"))), F.lit(0)).alias("below"),
        F.coalesce(F.max(F.when(F.col("side") <= 0, F.col("upto"))), F.lit(0)).alias("covered"),
    )
    ok = (F.floor(at) >= F.col("below")) & (F.ceil(at) < F.col("covered"))
    share = at - F.floor(at)
    value = F.col("lower") + (F.col("upper") - F.col("lower")) * share
    checked = F.when(ok, value).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    return found.select("column", "p", "n", checked.alias("value"))


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "robust") -> Scaler:
    """Statistics of ``df``'s rows; only one number pair per column is collected.

    A column that does not vary gets divisor 1, an all-NULL one no statistics.
    """
    if kind == "minmax":
        low_high = _cleaned(df, columns).agg(
            *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
            *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
        )
        row = low_high.first()
        found = {c: (row[f"lo_{i}"], row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}
    elif kind == "robust":
        found = {}
        quantiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        wide = quantiles.groupBy("column").agg(
            *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.5, "m"), (0.25, "a"), (0.75, "b"))]
        )
        for r in wide.collect():  # one row per column
            found[r["column"]] = (r["m"], r["a"], r["b"])
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    stats = {}
    for c in columns:
        centre, low, high = found.get(c, (None, None, None))
        stats[c] = (None, None) if centre is None else (centre, (high - low) or 1.0)
    return Scaler(kind, stats)


def normalize_features(df: DataFrame, exclude: Iterable[str] | None = None, kind: str = "minmax") -> DataFrame:
    """Scale every numeric column by statistics of the whole table."""
    return fit_scaler(df, scalable_columns(df, exclude), kind).transform(df)


def normalize_split(df: DataFrame, columns: list[str], kind: str = "robust", by: str = "split") -> DataFrame:
    """Scale all rows by statistics of the train rows only."""
    return fit_scaler(df.filter(F.col(by) == "train"), columns, kind).transform(df)
