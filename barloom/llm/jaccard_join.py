"""Jaccard join of word n-gram sets through count vectors.

Shingles are hashed into ``GROUPS`` groups; a set is the point of its group counts. The sum
of coordinate minima bounds the overlap of two points from above, the sum of the minima of two
boxes' upper corners that of all pairs below two tree nodes. Trees are built within
buckets that no linked pair can miss: two sets that overlap enough share one of
the first shingles of each, in an order that puts frequent shingles last. Surviving
pairs are verified on the whole sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, cross_pairs, partitions, release, shared_buckets, shingle_set, small_batches, stored, with_ids

GROUPS = 512
FULL = 255  # a group count that stands for itself or more
CELLS = 1 << 18  # of the frequency sketch that orders shingles; any size gives the same result
_CHUNK = 1 << 10
LEAF = 16
TURNS = 2  # rounds against single nodes before all pairs are tried; any number gives the same result


def frequency_sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents hold a shingle of each hash cell: ``CELLS`` sums over all documents."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        parts = total.reshape(-1, _CHUNK)
        full = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"part": full, "n": [parts[i].astype("<i8").tobytes() for i in full]})

    def add(key, rows):
        total = sum(np.frombuffer(x, "<i8") for x in rows["n"])
        return pd.DataFrame({"part": [key[0]], "n": [total.tobytes()]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(count, "part int, n binary")
    out = np.zeros((CELLS // _CHUNK, _CHUNK), np.int64)
    for r in parts.groupBy("part").applyInPandas(add, "part int, n binary").collect():  # CELLS numbers, whatever the corpus
        out[r.part] = np.frombuffer(r.n, "<i8")
    return out.reshape(-1)


def _node(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, id_column: str, text: str, width: int, percent: int, row_hash: str | None = None) -> DataFrame:
    """(id, n, node, counts, keys) per document: set size, the set's hash, group counts, first shingles; with ``row_hash`` also the text's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, text, width))

    def sign(batches):
        seen = shared.value
        for batch in batches:
            rows = []
            for key, t in zip(batch["id"], batch["text"]):
                h = shingle_set(t, width)
                n = len(h)
                if not n:
                    rows.append((key, 0, None, None, None))
                    continue
                first = n - -(-percent * n // 100) + 1
                order = np.lexsort((h, seen[(h & np.uint64(CELLS - 1)).astype(np.int64)]))[:first]
                counts = np.bincount((h >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).clip(max=FULL).astype(np.uint8)
                rows.append((key, n, _node(h), counts.tobytes(), h[order].view(np.int64)))
            ids, n, nodes, counts, keys = zip(*rows) if rows else [()] * 5
            # Nullable integers: 64-bit hashes would lose digits as floats.
            out = pd.DataFrame({"id": list(ids), "n": pd.array(n, "int64"), "node": pd.array(nodes, "Int64"), "counts": list(counts), "keys": list(keys)})
            yield out.assign(**{row_hash: batch[row_hash].to_numpy()}) if row_hash else out

    own = [F.xxhash64(text).alias(row_hash)] if row_hash else []
    # Ids go through Python as text: whole numbers beside a null one would lose digits.
    made = docs.select(F.col(id_column).cast("long").cast("string").alias("id"), F.col(text).alias("text"), *own)
    made = made.mapInPandas(sign, "id string, n bigint, node bigint, counts binary, keys array<bigint>" + (f", {row_hash} bigint" if row_hash else ""))
    return made.withColumn("id", F.col("id").cast("long"))


def _matrix(x: pd.Series) -> np.ndarray:
    counts = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), GROUPS)
    if counts.max(initial=0) < FULL:
        return counts
    return np.where(counts < FULL, counts, 1 << 20).astype(np.int32)  # nothing is known above a full count


def _close(n1, n2, percent: int) -> np.ndarray:
    """Sizes that allow a link."""
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def _coarse(counts: np.ndarray) -> np.ndarray:
    """Sums of neighbouring groups: a looser bound that takes an eighth of the work."""
    return counts.reshape(len(counts), -1, 8).sum(2, dtype=np.int16 if counts.dtype == np.uint8 else np.int32)


def _allows(c1, c2, n, i, j, percent: int) -> np.ndarray:
    """Whether the overlap bound of points or boxes i and j reaches what their sizes ``n`` together need."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 32768):
        at = slice(s, s + 32768)
        overlap = np.minimum(c1[i[at]], c2[j[at]]).sum(1, dtype=np.int32).astype(np.int64)
        out[at] = overlap * (100 + percent) >= percent * n[at]
    return out


def _order(counts: np.ndarray, n: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Points by size, those of a component that fills tree nodes together."""
    _, label, members = np.unique(component, return_inverse=True, return_counts=True)
    return np.lexsort((counts[:, 0], n, np.where(members[label] > LEAF, label, -1)))


def _tree(counts: np.ndarray, n: np.ndarray, component: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from points to root: upper corners, smallest and largest size and component; a node's children are ``LEAF`` in a row."""
    levels = [(counts, n, n, component, component)]
    while len(levels[-1][1]) > LEAF:
        at = np.arange(0, len(levels[-1][1]), LEAF)
        levels.append(tuple(f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), levels[-1])))
    return levels


def _raised(tree: list[tuple[np.ndarray, ...]], height: int) -> list[tuple[np.ndarray, ...]]:
    while len(tree) < height:
        top, low, high, first, last = tree[-1]
        tree.append((top.max(0, keepdims=True), low.min(keepdims=True), high.max(keepdims=True), first.min(keepdims=True), last.max(keepdims=True)))
    return tree


def tree_pairs(c1, n1, c2, n2, percent: int, k1=None, k2=None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of points whose bound on the overlap allows a link, by descending two trees.

    ``k1`` and ``k2`` are the points' components: pairs within one are left out, and tree nodes of the same component
    are not descended together. For one set of points with itself each pair is found once.
    """
    same = c1 is c2
    k1 = np.arange(len(n1)) if k1 is None else k1
    k2 = (k1 if same else -1 - np.arange(len(n2))) if k2 is None else k2
    o1 = _order(c1, n1, k1)
    o2 = o1 if same else _order(c2, n2, k2)
    t1, t2 = _tree(c1[o1], n1[o1], k1[o1]), _tree(c2[o2], n2[o2], k2[o2])
    t1, t2 = _raised(t1, len(t2)), _raised(t2, len(t1))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(t1[-1][1])), np.arange(len(t2[-1][1])), indexing="ij"))
    for level in range(len(t1) - 1, -1, -1):
        (a, alo, ahi, afirst, alast), (b, blo, bhi, bfirst, blast) = t1[level], t2[level]
        near = (100 * ahi[i] >= percent * blo[j]) & (100 * bhi[j] >= percent * alo[i])
        near &= (afirst[i] != alast[i]) | (bfirst[j] != blast[j]) | (afirst[i] != bfirst[j])
        if same:
            near &= i <= j
        i, j = i[near], j[near]
        for x, y in ((_coarse(a), _coarse(b)), (a, b)):
            keep = _allows(x, y, alo[i] + blo[j], i, j, percent)
            i, j = i[keep], j[keep]
        if level:
            below1, below2 = len(t1[level - 1][1]), len(t2[level - 1][1])
            wide1, wide2 = (LEAF if below1 > len(a) else 1), (LEAF if below2 > len(b) else 1)
            k = np.arange(wide1 * wide2)
            i, j = (i[:, None] * wide1 + k // wide2).ravel(), (j[:, None] * wide2 + k % wide2).ravel()
            real = (i < below1) & (j < below2)
            i, j = i[real], j[real]
    return o1[i], o2[j]


def near_first(buckets: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): nodes of ``buckets`` (key, node, n) with their bucket's smallest, where the bound allows a link.

    Pairs of fitting sizes are made distinct before the ``points`` (node, n, counts) join them.
    """
    first = buckets.groupBy("key").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("n1"))
    sizes = F.least("n1", "n") * 100 >= F.greatest("n1", "n") * percent
    return bounded(buckets.join(first, "key").filter("node <> a").filter(sizes).select("a", F.col("node").alias("b")).distinct(), points, percent)


def near_other(buckets: DataFrame, found: DataFrame, points: DataFrame, percent: int, turn: int) -> DataFrame:
    """Distinct (a, b): nodes of ``buckets`` (key, node, n) with one of their bucket's, another for each ``turn``, where components of ``found`` differ and the bound allows a link.

    Buckets of two rows are left out: their pair is that of ``near_first``.
    """
    b = buckets.join(found.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    centre = F.min_by(F.struct("node", "n", "component"), F.xxhash64("node", F.lit(turn)))
    keys = b.groupBy("key").agg(centre.alias("c"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("rows")).filter("c0 <> c1 AND rows > 2")
    both = b.join(keys.select("key", "c"), "key").filter(F.col("component") != F.col("c.component"))
    both = both.filter(F.least("c.n", "n") * 100 >= F.greatest("c.n", "n") * percent)
    return bounded(both.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct(), points, percent)


def bounded(both: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose ``points`` allow a link."""
    of_b = points.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("counts").alias("c2"))
    of_a = points.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("counts").alias("c1"))
    both = both.join(of_b, "b").join(of_a, "a")

    def test(batches):
        for b in batches:
            overlap = np.minimum(_matrix(b["c1"]), _matrix(b["c2"])).sum(1, dtype=np.int64)
            yield b.loc[overlap * (100 + percent) >= percent * (b["n1"] + b["n2"]).to_numpy(), ["a", "b"]]

    return both.mapInPandas(test, "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the similarity. Each b's text goes to its a, in slices."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1024).cast("int").alias("slices"))
    cut = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    members = cut.select("a", "slice", F.col("b").alias("node"), F.lit(1).alias("kind"))
    heads = cut.select("a", "slice", F.col("a").alias("node"), F.lit(0).alias("kind")).distinct()
    wanted = members.union(heads).join(nodes.select("node", "first"), "node")
    texts = with_ids(docs.select(F.col(id_column).cast("long").alias("first"), F.col(text).alias("text")), "first", nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("first"))
    rows = wanted.join(texts, "first").select("a", "slice", "kind", "node", "text")

    def compare(batches):
        head, key = None, None
        for batch in batches:
            out = []
            for a, s, kind, node, t in zip(batch["a"], batch["slice"], batch["kind"], batch["node"], batch["text"]):
                h = shingle_set(t, width)
                if _node(h) != node:
                    continue  # another row with the id of this set's first document
                if kind == 0:
                    head, key = h, (a, s)
                elif key == (a, s):
                    both = len(head) + len(h)
                    common = len(np.intersect1d(head, h, assume_unique=True)) if _close(len(head), len(h), percent) else 0
                    if common * (100 + percent) >= percent * both:
                        out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.repartition(partitions(pairs.sparkSession), "a", "slice").sortWithinPartitions("a", "slice", "kind").mapInPandas(compare, "a bigint, b bigint").distinct()


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, row_hash: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, n_copies) per row of ``docs``; with ``row_hash`` also a column of that name, the xxhash64 of its text.

    Sets are the distinct ``width``-word shingles of the whole text (A-Z lower-cased,
    words ``WORD``); a shorter text is one shingle. Two sets link when
    100 x intersection >= ``percent`` x union. ``component_id`` is the smallest id reachable, ``n_copies``
    the number of rows with the same set. A text without words, a null text and a row without id link
    with nothing and are their own component; rows with equal sets are one node, so ties and
    repeated rows share a component; other columns are ignored; an empty table gives no rows.

    Links are looked for in rounds over the same buckets: each node against its bucket's smallest, which
    settles groups of copies in one step, up to ``TURNS`` times against another one of the bucket, then all pairs of different components the trees let through.
    """
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs, id_column, text, width, percent, row_hash))
    known = signed.filter("node IS NOT NULL AND id IS NOT NULL")
    copies = known.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"))
    nodes = stored(known.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("keys").alias("keys")))
    postings = nodes.select(F.explode("keys").alias("key"), "node", "n")
    buckets = stored(shared_buckets(postings))
    points = nodes.select("node", "n", "counts")

    def prepare(rows):
        return _matrix(rows["counts"]), rows["n"].to_numpy()

    def judge(arrays, i, j):
        c, n = arrays
        out = _close(n[i], n[j], percent)
        at = np.flatnonzero(out)
        out[at] = np.minimum(c[i[at]], c[j[at]]).sum(1, dtype=np.int64) * (100 + percent) >= percent * (n[i[at]] + n[j[at]])
        return out

    def pairs(x, y):
        cx = _matrix(x["counts"])
        cy = cx if x is y else _matrix(y["counts"])
        i, j = tree_pairs(cx, x["n"].to_numpy(), cy, y["n"].to_numpy(), percent, x["component"].to_numpy(), y["component"].to_numpy())
        return np.stack([x["node"].to_numpy()[i], y["node"].to_numpy()[j]], axis=1)

    star = stored(near_first(buckets, points, percent))
    links = stored(verified(star, nodes, docs, id_column, text, width, percent))
    found = components(links)
    release(docs.sparkSession)  # many small jobs: their plans and shuffles go before more come
    # Where nodes of one bucket link with some of its others only, each turn joins most of those left to the large component.
    for turn in range(1, TURNS + 1):
        fresh = stored(verified(stored(near_other(buckets, found, points, percent, turn)), nodes, docs, id_column, text, width, percent))
        if fresh.isEmpty():
            break
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(fresh))
        release(docs.sparkSession)
    # A bucket of two has no pair but the one with its smallest.
    rest = cross_pairs(buckets.drop("n"), found, ["n", "counts"], prepare, judge, pairs, points, least=3).join(star, ["a", "b"], "left_anti")
    more = stored(verified(stored(rest), nodes, docs, id_column, text, width, percent))
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    linked = found.withColumnRenamed("id", "node").join(copies, "node")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.join(lowest, "component").select("node", "component_id")
    groups = copies.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"), "n_copies")
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kind = docs.schema[id_column].dataType.simpleString()
    return signed.join(groups, "node", "left").select(
        F.col("id").cast(kind).alias(id_column), F.col("n").alias("n_shingles"), alone.cast(kind).alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), *([row_hash] if row_hash else [])
    )
