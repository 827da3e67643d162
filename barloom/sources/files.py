"""Reading and writing panels, predictions, importances and histories."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import KEY, TIME
from barloom.session import shared_dir


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A feature table with a header and a given schema; nothing is inferred."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features, predictions or importances as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write unless empty; says whether it wrote."""
    if predictions.isEmpty():
        return False
    write_csv(predictions, path, mode)
    return True


def write_history(history: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Run metrics as JSON lines."""
    history.write.mode(mode).json(path)


def write_panel(panel: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet sorted by key within files, so readers prune by row-group statistics."""
    panel.sortWithinPartitions(KEY, TIME).write.mode(mode).parquet(path)


def manifest(spark: SparkSession, inputs: Sequence[DataFrame]) -> DataFrame:
    """``(input, path, length, modified)`` of the files that each of ``inputs`` is read from; contents are not read.

    Raises for an input that is not read from files, as nothing tells whether it is still the same.
    """
    out = spark.createDataFrame([], "input int, path string, length bigint, modified timestamp")
    for i, df in enumerate(inputs):
        files = df.inputFiles()
        if not files:
            raise ValueError(f"input {i} is not read from files: store it first")
        listed = spark.read.format("binaryFile").load(files)
        out = out.union(listed.select(F.lit(i), "path", "length", F.col("modificationTime")))
    return out


def reuse(
    spark: SparkSession,
    name: str,
    parameters: dict,
    build: Callable[[], DataFrame],
    inputs: Sequence[DataFrame],
    root: str | None = None,
) -> DataFrame:
    """A stored table for exactly these parameters and ``inputs``, built and written on first use.

    The folder name hashes every parameter and the path, size and time of every file ``inputs`` are read from, so a changed
    option, another input or a file replaced under its old name is a new table. The manifest is written
    after the table; without it the table was left half-written and is built again.
    """
    files = manifest(spark, inputs)
    one = F.xxhash64("input", "path", "length", "modified").cast("decimal(38,0)")
    state = files.agg(F.count("*").alias("n"), F.sum(one).alias("s"), F.bit_xor(F.xxhash64("path", "modified", "length", "input")).alias("x")).first()
    key = json.dumps([parameters, [str(v) for v in state]], sort_keys=True, default=str)
    path = f"{root or shared_dir(spark)}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    try:
        spark.read.parquet(f"{path}-manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.mode("overwrite").parquet(path)
        files.write.mode("overwrite").parquet(f"{path}-manifest")
    return spark.read.parquet(path)


def panel_schema(panel: DataFrame, columns: Sequence[str] | None = None) -> T.StructType:
    fields = {f.name: f for f in panel.schema.fields}
    return T.StructType([fields[c] for c in (columns or panel.columns)])


__all__ = [
    "manifest",
    "panel_schema",
    "read_panel_csv",
    "reuse",
    "write_csv",
    "write_history",
    "write_panel",
    "write_predictions",
]
