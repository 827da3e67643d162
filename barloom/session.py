"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Above 8000 bytes of bytecode the JVM interprets a method for good; fused
    # stages of wide projections get there, split ones do not.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture costs several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("barloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cores))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediates.

    Read from the session, in local mode too.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach, or name a root")
    return path


def spread(df, *keys):
    """Hash-partition by ``keys`` into the session's shuffle partition count.

    A fixed count keeps adaptive execution from folding the compute-heavy stage
    that follows into a few tasks because its input is small in bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
