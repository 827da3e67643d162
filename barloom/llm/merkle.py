"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the roots of the groups.

Slot pivot: the rows of a group are numbered in order; node i of a level is in slot i % 8 of parent i div 8, so a
grouped aggregate with one condition for each slot puts the children of a parent into eight columns of one row. All eight
in a row, hashed, are the parent; all but the own one are the siblings a proof needs. Levels are written tables, an eighth of the
size of the one below; proofs come down again from parent to children, so no row ever meets all others.

Defined results: a null field counts as ``-``; null groups and null order values come first; rows that agree in group and
order are put in the order of their leaf digest; equal rows are leaves of their own; an empty table gives no rows.
Other columns are kept; columns named ``subroot``, ``root`` or ``path`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import partitions, stored

FANOUT = 8


def row_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each with its length in bytes before it."""

    def coded(field):
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[coded(f) for f in fields]), 256)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda seen, p: F.sha2(F.concat(p["left"], seen, p["right"]), 256))


def _numbered(nodes: DataFrame) -> DataFrame:
    """(tree, h, row) with ``pos``, the place within ``tree`` by (key, h), and ``size``, the nodes of the tree.

    Sorted by ranges, so that a tree may span many tasks; a range's first place comes from the counts of those before.
    """
    spark = nodes.sparkSession
    order = ["tree", "key", "h", "tie"]  # the tie spreads equal rows over ranges
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = stored(ranged.select("tree", "h", "row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(F.col("tree").alias("t"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = Window.partitionBy("t")  # one row for each range of a tree
    before = F.coalesce(F.sum("n").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("t", "part", "first", before.alias("before"), F.sum("n").over(ranges).alias("size"))
    both = rows.withColumn("part", part).join(counts, "part").filter(F.col("tree").eqNullSafe(F.col("t")))
    return both.select("tree", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size", "h", "row")


def _raised(nodes: DataFrame) -> DataFrame:
    """The parents of ``nodes``: one row each, children in columns c0 to c7."""
    slot = F.col("pos") % FANOUT
    children = [F.first(F.when(slot == k, F.struct("h", "row")), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)]
    up = [F.expr(f"pos div {FANOUT}").alias("pos"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size")]
    return nodes.groupBy("tree", *up).agg(*children)


def _hashed(level: DataFrame) -> DataFrame:
    whole = F.sha2(F.concat_ws("", *[F.col(f"c{k}.h") for k in range(FANOUT)]), 256)
    return level.select("tree", "pos", "size", whole.alias("h"), F.lit(None).cast("int").alias("row"))


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes``, lowest first, and (tree, h) of each tree's root."""
    size = nodes.agg(F.max("size")).first()[0] or 0
    levels, roots = [], nodes.filter("size = 1").select("tree", "h")
    while size > 1:
        levels.append(stored(_raised(nodes.filter("size > 1"))))
        nodes, size = _hashed(levels[-1]), -(-size // FANOUT)
        roots = roots.union(nodes.filter("size = 1").select("tree", "h"))
    return levels, stored(roots)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which ``tree`` may be null."""
    b = b.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in b.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return a.join(b, match).drop(*[f"r_{k}" for k in keys])


def _descended(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, h, row, path) of all ``nodes``; ``tops`` has the path of each tree's root."""
    paths = None
    for level in reversed(levels):
        known = _same(level.filter("size = 1"), tops, ["tree"])
        if paths is not None:
            known = known.unionByName(_same(level.filter("size > 1"), paths, ["tree", "pos"]))
        slots = []
        for k in range(FANOUT):
            left, right = (F.concat_ws("", *[F.col(f"c{i}.h") for i in at]) for at in (range(k), range(k + 1, FANOUT)))
            step = F.struct(left.alias("left"), right.alias("right"))
            slots.append(F.when(F.col(f"c{k}").isNotNull(), F.struct((F.col("pos") * FANOUT + k).alias("pos"), f"c{k}.h", f"c{k}.row", step.alias("step"))))
        child = known.select("tree", "path", F.explode(F.array_compact(F.array(*slots))).alias("c"))
        child = child.select("tree", "c.pos", "c.h", "c.row", F.concat(F.array("c.step"), "path").alias("path"))
        paths = child.select("tree", "pos", "path")
    alone = _same(nodes.filter("size = 1"), tops, ["tree"]).select("tree", "pos", "h", "row", "path")
    return alone if paths is None else alone.union(child)


def manifest(leaves: DataFrame, leaf: str = "leaf", tree: str = "lang", order: str = "doc_id") -> DataFrame:
    """``leaves`` with subroot (of the tree of the row's group), root (of the whole table) and path.

    ``path`` holds the siblings left and right of the way from the leaf through the subroot to the root, lowest first:
    see ``fold`` and ``proof_digest``. Roots of the groups are ordered by group, nulls first.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c not in ("subroot", "root", "path")])
    nodes = _numbered(leaves.select(F.col(tree).alias("tree"), F.col(order).alias("key"), F.col(leaf).alias("h"), row.alias("row")))
    levels, subroots = _grown(nodes)
    tops = _numbered(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "h", F.col("tree").alias("row")))
    top_levels, roots = _grown(tops)
    root = roots.first()
    start = roots.select("tree", F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path"))
    named = _descended(tops, top_levels, start).select(F.col("row").alias("tree"), F.struct("h", "path").alias("path"))
    down = _descended(nodes, levels, named.select("tree", F.col("path.path").alias("path")))
    down = _same(down, subroots.select("tree", F.col("h").alias("subroot")), ["tree"])
    return down.select("row.*", "subroot", F.lit(root.h if root else None).cast("string").alias("root"), "path")
