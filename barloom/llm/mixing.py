"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import WORD, small_batches, stored

WEIGHTS = (3.0, 1.0, 2.0)
FACTOR = 1.5
MOST = 2.0
SALTS = 64  # cells that a size class of a source is spread over


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``factor`` times all sizes. A target stops at ``most`` times its source's size and
    the excess goes to the others by weight: the level at which the open sources
    use up what the stopped ones leave. One row per source passes through one window.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    t = total.select("source", "source_size", w.alias("weight")).withColumn("cap", F.col("source_size") * most)
    # Sources in the order in which a rising level stops them.
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    whole = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.sum("source_size").over(everything) * factor - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    level = F.col("left") / F.col("open")
    t = t.withColumn("level", F.first(F.when(level * F.col("weight") < F.col("cap"), level), ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return t.select("source", F.col("source_size").cast("long").alias("source_size"), "weight", target.alias("target"))


def _size_class(size: Column) -> Column:
    """Eight classes for each doubling of the size, in order."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").bitwiseAND(F.lit(7).cast("long"))).cast("int")


def _unit(x: Column) -> Column:
    """A number in [0, 1) from a text, the same on every run."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and copies; rows with 0 copies stay.

    Within its source a document expects target / source_size copies. Documents
    line up by size class, a hash and size; the expected copies are summed in that order,
    one offset per source is added, and a document is emitted once per integer the
    sum crosses in it. A hot source is spread over size classes and salts: ranks are
    offsets from counts per (source, class, salt) plus a rank inside that cell. Rows with their
    texts are shuffled and sorted once: the ranks and the join with the cells have the same keys.

    A null text has size 0; a source of size 0 expects no copies; null sources are
    one source, last; equal rows take neighbouring ranks; an empty table gives
    no rows. Result columns replace columns of ``docs`` with the same names.
    """
    small_batches(docs.sparkSession)
    added = ("size", "source_size", "target", "copies")
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    rows = docs.select(given.alias("row"), F.col(id_column).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.select(
        "*",
        _size_class(F.col("size")).alias("_class"),
        F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    cells = stored(rows.groupBy("source", "_class", "_salt").agg(F.count("*").alias("_n"), F.sum("size").alias("size")))  # read twice below, words counted once
    targets = source_targets(cells.select("source", "size"))
    line = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "_class", "_salt", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    cells = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).select(cells["source"].alias("_source"), "_class", "_salt", "_before", "source_size", "target")
    # In a struct a null source equals itself, so the join takes the rows as the window has dealt and sorted them.
    inside = Window.partitionBy("_of", "_class", "_salt").orderBy("size", F.col("id").asc_nulls_last())
    ranked = rows.withColumn("_of", F.struct("source")).withColumn("_rank", F.row_number().over(inside))
    both = ranked.join(cells.withColumn("_of", F.struct(F.col("_source").alias("source"))), ["_of", "_class", "_salt"])
    rate = F.when(F.col("source_size") > 0, F.least(F.try_divide("target", "source_size"), F.lit(MOST))).otherwise(0.0)
    at = F.col("_before") + F.col("_rank")
    offset = _unit(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_source"), F.lit(""))))
    crossed = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return both.select("row.*", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """A mixed table with each row emitted ``copies`` times."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy")
