"""What several operators share: stored intermediates, hashing of texts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word contracts: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; local sessions without one get their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),  # 64 MB by default: copied and doubled in the JVM, then held in Python
    "spark.sql.parquet.columnarReaderBatchSize": "1024",  # 4096 by default, whatever the length of a text
}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are read and go to Python a few MB at a time from now on, unless the session was given other batches."""
    given = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them once the driver has collected their handles.

    The last job's handles are free only after another, an empty one here.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hashing -------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _inverse(n: int) -> np.ndarray:
    out = np.full(n, pow(int(_STEP), -1, 2**64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_TABLE = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int):
    if len(_TABLE[0]) < n:
        _TABLE[:] = [_powers(n), _inverse(n)]
    return _TABLE


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 bytes, in order, with their starts and ends."""
    inside = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    up, down = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z lower-cased, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    return hashed_words(_LOWER[np.frombuffer(text.encode(), np.uint8)])[0]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; a shorter text is one shingle, no words give none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return np.unique(h)


# --- connected components --------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds; a node's neighbours are only
    aggregated and joined, never gathered. Nulls and self-links are ignored; no
    edges give no rows.
    """
    e = stored(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(low, "u")
        e = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


# --- groups, streamed --------------------------------------------------------------


def whole_groups(batches, keys: list[str]) -> Iterable[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches, cut anew so that each holds whole groups of ``keys``, with the groups' bounds."""
    held = None

    def bounds(batch):
        new = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new)])

    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        starts = bounds(batch)
        held = batch.iloc[starts[-1] :]
        if len(starts) > 1:
            yield batch.iloc[: starts[-1]], starts
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def by_group(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` on each group of ``keys``; a task holds one batch and the group at its end.

    Groups must be bounded by the caller. ``work`` yields tuples of ``schema``.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches):
        for rows, bounds in whole_groups(batches, keys):
            out = [r for a, b in zip(bounds[:-1], bounds[1:]) for r in work(rows.iloc[a:b])]
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


# --- candidate pairs in buckets ------------------------------------------------------

SLOTS = 1 << 20
BLOCK = 2048


def with_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``ids`` (one column): a filter ahead of a join.

    What is broadcast is at most ``SLOTS`` hash slots, however many ids there are;
    the join that follows decides.
    """
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SLOTS)).cast("int")
    slots = ids.select(slot.alias("_slot")).distinct()
    mine = F.pmod(F.xxhash64(F.col(column)), F.lit(SLOTS)).cast("int")
    return df.withColumn("_slot", mine).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def shared_buckets(postings: DataFrame) -> DataFrame:
    """``postings`` (key, node) of keys with two nodes or more, one key for each set of nodes."""
    h = F.xxhash64("node")
    keys = postings.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"), F.min("node").alias("low"))
    keys = keys.filter("n > 1").groupBy("n", "x", "s", "low").agg(F.min("key").alias("key"))
    return postings.join(keys.select("key"), "key", "left_semi")


def star_pairs(buckets: DataFrame, payload: list[str], least: int, test: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Distinct (a, b): each node of a bucket of at least ``least`` with the bucket's smallest node, where ``test`` holds.

    ``test`` gets columns ``<p>`` and ``first_<p>`` of each payload column. No bucket meets in one task.
    """
    first = buckets.groupBy("key").agg(F.min(F.struct("node", *payload)).alias("f"), F.count("*").alias("n")).filter(F.col("n") >= least)
    first = first.select("key", F.col("f.node").alias("first"), *[F.col(f"f.{p}").alias(f"first_{p}") for p in payload])
    both = buckets.join(first, "key").filter("node <> first").drop("key")

    def run(batches):
        for b in batches:
            if len(b):
                good = b[test(b)]
                yield pd.DataFrame({"a": good["first"], "b": good["node"]}).drop_duplicates()

    return both.mapInPandas(run, "a bigint, b bigint").distinct()


SMALL = 32  # groups up to this size are paired together, array by array


def small_pairs(bounds: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within groups of at most ``SMALL`` rows, one distance after the other."""
    sizes = np.diff(bounds)
    ends = np.repeat(np.where(sizes <= SMALL, bounds[1:], bounds[:-1]), sizes)
    at = np.arange(bounds[-1])
    for s in range(1, SMALL):
        i = at[at + s < ends]
        if not len(i):
            break
        yield i, i + s


def cross_pairs(buckets: DataFrame, found: DataFrame, payload: list[str], prepare: Callable[[pd.DataFrame], object], judge: Callable, pairs: Callable, details: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Distinct (a, b) of bucket mates of different components of ``found`` (id, component) that may be, or are, links.

    Large buckets are cut into blocks of about ``BLOCK`` rows and every two blocks
    meet in a group of their own, so no pair is lost and no group is larger than two blocks.
    ``prepare`` turns rows into arrays; ``judge(arrays, i, j)`` tests the pairs of small groups, ``pairs(x, y)`` finds those of
    two frames with node, component and payload, which may be one and the same, and skips pairs of one component.
    ``details`` (node, payload), if given, has the payload, which then joins only the buckets that are left.
    Buckets of fewer than ``least`` rows are left out: 3 where the only pair of two rows is judged elsewhere.
    """
    b = buckets.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = b.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).filter((F.col("c0") != F.col("c1")) & (F.col("n") >= least))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    b = b.join(mixed.select("key", blocks.alias("blocks")), "key")
    if details is not None:
        b = b.join(details, "node")
    b = b.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "component", *payload)

    def run(batches):
        for rows, bounds in whole_groups(batches, ["key", "x", "y"]):
            out = []
            node, component = rows["node"].to_numpy(), rows["component"].to_numpy()
            block, x = rows["block"].to_numpy(), rows["x"].to_numpy()
            arrays = prepare(rows)
            cut = (x != rows["y"].to_numpy())[bounds[:-1]]
            for i, j in small_pairs(bounds):
                # Two blocks of a cut bucket meet here; those within a block meet elsewhere too.
                other = component[i] != component[j]
                i, j = i[other], j[other]
                for s in range(0, len(i), 65536):
                    p, q = i[s : s + 65536], j[s : s + 65536]
                    good = judge(arrays, p, q)
                    out.append(np.stack([node[p[good]], node[q[good]]], axis=1))
            for k in np.flatnonzero(np.diff(bounds) > SMALL):
                g = rows.iloc[bounds[k] : bounds[k + 1]]
                if cut[k]:
                    inside = (block == x)[bounds[k] : bounds[k + 1]]
                    out.append(pairs(g[inside], g[~inside]))
                else:
                    out.append(pairs(g, g))
            found_here = np.concatenate([o for o in out if len(o)]) if any(len(o) for o in out) else np.zeros((0, 2), np.int64)
            found_here = np.unique(np.sort(found_here, axis=1), axis=0)
            yield pd.DataFrame({"a": found_here[:, 0], "b": found_here[:, 1]})

    keys = ["key", "x", "y"]
    return b.repartition(partitions(b.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, "a bigint, b bigint").distinct()
