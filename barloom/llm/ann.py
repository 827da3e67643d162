"""Nearest neighbours through learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts that keep neighbours together; a
softmax classifier learns from each vector's neighbours which parts it should look in. Every
row is indexed in its most probable part; a query goes to several and is reranked exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.binary_codes import usable
from barloom.llm.common import by_group, stored

SAMPLE = 4096  # rows of the sample: those with the smallest hash of their id
NEIGHBOURS = 10
RECALL = 0.97  # aimed at on sample queries; decides how many parts a query visits
BLOCK = 4096  # candidates, and queries, in one task's group


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def neighbours(v: np.ndarray, k: int) -> np.ndarray:
    out = []
    for s in range(0, len(v), 512):
        d = squared(v[s : s + 512], v)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(v: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vertex: halved along principal directions, then vertices move to the part of most neighbours while it has room."""
    label = np.zeros(len(v), np.int64)
    for _ in range(int(math.log2(parts))):
        new = np.zeros_like(label)
        for p in np.unique(label):
            at = np.flatnonzero(label == p)
            x = v[at] - v[at].mean(0)
            axis = np.linalg.svd(x[:: max(1, len(x) // 512)], full_matrices=False)[2][0]
            order = np.argsort(x @ axis, kind="stable")
            new[at[order[: len(at) // 2]]] = 2 * p
            new[at[order[len(at) // 2 :]]] = 2 * p + 1
        label = new
    room = math.ceil(1.1 * len(v) / parts)
    source = np.repeat(np.arange(len(v)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(v), parts))
        np.add.at(votes, (source, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[source]), 1)
        gain = votes.max(1) - votes[np.arange(len(v)), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if sizes[to] < room:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A linear softmax classifier on standardised vectors."""

    def __init__(self, v: np.ndarray, target: np.ndarray, steps: int = 250):
        self.mean, self.scale = v.mean(0), v.std(0).mean() or 1.0
        x = self._features(v)
        self.w = np.zeros((x.shape[1], target.shape[1]))
        m1, m2 = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, steps + 1):
            g = x.T @ (self._soft(x @ self.w) - target) / len(x) + 1e-4 * self.w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            self.w -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)

    def _features(self, v):
        return np.hstack([(v - self.mean) / self.scale, np.ones((len(v), 1))])

    @staticmethod
    def _soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, v: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-(self._features(v) @ self.w), axis=1, kind="stable")

    def state(self) -> tuple:
        return self.mean, self.scale, self.w

    @classmethod
    def of(cls, state: tuple) -> Router:
        self = cls.__new__(cls)
        self.mean, self.scale, self.w = state
        return self


def fit(sample: np.ndarray, parts: int) -> tuple[Router, int]:
    """The router and how many parts a query visits: the fewest that reach ``RECALL`` on the sample."""
    graph = neighbours(sample, min(NEIGHBOURS, len(sample) - 1))
    label = balanced_parts(sample, graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph.ravel()]), 1.0 / (graph.shape[1] + 1))
    target[np.arange(len(sample)), label] += 1.0 / (graph.shape[1] + 1)
    router = Router(sample, target)
    order = router.order(sample)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
    home = order[:, 0]
    needed = place[np.repeat(np.arange(len(sample)), graph.shape[1]), home[graph.ravel()]]
    reached = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return router, int(np.argmax(reached >= RECALL)) + 1


def part_count(rows: int) -> int:
    """Parts grow with the square root of the table, up to what the sample can teach."""
    return 1 << max(0, min(8, round(math.log2(math.sqrt(max(rows, 1)) / 4 + 1))))


def nearest(vectors: DataFrame, queries, id_column: str = "vec_id", column: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row of ``vectors`` where ``queries`` holds.

    Euclidean distance of the original vectors in double precision, nearest first, ties to the smaller id;
    fewer rows only if the table has fewer candidates: a query whose parts hold fewer than ``k`` goes to all others too. A query id of several
    rows is one query, with the vector of the smallest components. A row is no candidate of a query with its id. Vectors that are null, zero or hold null or
    non-finite components, rows without id and vectors of another length than the query take no part. Repeated rows are
    candidates of their own; other columns are ignored; an empty table gives no rows.
    A part or a query group that many rows share is cut into blocks that meet pairwise.
    """
    rows = vectors.filter(usable(column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), queries.alias("asks"))
    dims = rows.groupBy(F.size("v").alias("dim")).count().collect()  # one row per vector length
    schema = "query bigint, id bigint, d double"
    found = []
    for dim, total in sorted(tuple(r) for r in dims):
        own = rows.filter(F.size("v") == dim)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        parts = part_count(total)
        if len(sample) > 2 * NEIGHBOURS and parts > 1:
            router, visits = fit(np.array(sample.tolist()), parts)
        else:
            router, visits = None, 1
        model = own.sparkSession.sparkContext.broadcast((router.state() if router else None, visits))

        def route(batches, model=model):
            state, visits = model.value
            router = Router.of(state) if state else None
            for b in batches:
                if not len(b):
                    continue
                if router is None:
                    order = np.zeros((len(b), 1), np.int64)
                else:
                    order = router.order(np.array(b["v"].tolist()))
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "part": order[:, 0], "asks": b["asks"], "visits": [o[:visits].tolist() if a else [] for o, a in zip(order, b["asks"])]})

        routed = stored(own.mapInPandas(route, "id bigint, v array<double>, part bigint, asks boolean, visits array<bigint>"))
        # A query id whose row is repeated asks once.
        asking = routed.filter("asks").groupBy("id").agg(F.min(F.struct("v", "visits")).alias("q")).select("id", "q.v", "q.visits")
        # Candidates are counted by part; rows with the query's own id are none.
        own_id = routed.select("id", "part").join(asking.select("id"), "id", "left_semi").groupBy("id", "part").agg(F.count("*").alias("same"))
        held = routed.groupBy("part").agg(F.count("*").alias("rows"))  # at most 256 parts
        seen = asking.select("id", F.explode("visits").alias("part")).join(F.broadcast(held), "part").join(own_id, ["id", "part"], "left")
        enough = seen.groupBy("id").agg(F.sum(F.col("rows") - F.coalesce("same", F.lit(0))).alias("n")).filter(F.col("n") >= k).select("id", F.lit(True).alias("enough"))
        whole = F.lit(list(range(parts if router else 1))).cast("array<bigint>")
        asking = asking.join(enough, "id", "left").withColumn("visits", F.when(F.col("enough"), F.col("visits")).otherwise(whole))
        asked = stored(asking.select("id", "v", F.explode("visits").alias("part")))
        blocks = routed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("cs"))
        waiting = asked.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("qs"))
        shape = blocks.join(waiting, "part")
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        c = routed.join(shape, "part").select("part", mine("cs").alias("c"), every("qs").alias("q"), "id", "v", F.lit(0).alias("kind"))
        q = asked.join(shape, "part").select("part", every("cs").alias("c"), mine("qs").alias("q"), "id", "v", F.lit(1).alias("kind"))

        def search(g):
            asks = g["kind"].to_numpy() == 1
            if not asks.any() or asks.all():
                return
            ids, qids = g["id"].to_numpy()[~asks], g["id"].to_numpy()[asks]
            v, w = np.array(g["v"][~asks].tolist()), np.array(g["v"][asks].tolist())
            for s in range(0, len(w), 256):
                d = squared(w[s : s + 256], v)
                d[qids[s : s + 256, None] == ids[None, :]] = np.inf
                edge = np.partition(d, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
                slack = 1e-9 * (1 + (w[s : s + 256] ** 2).sum(1))
                for r in range(len(d)):
                    near = np.flatnonzero((d[r] <= edge[r] + slack[r]) & (d[r] < np.inf))
                    exact = np.sqrt(((v[near] - w[s + r]) ** 2).sum(1))
                    for o in np.lexsort((ids[near], exact))[:k]:
                        yield int(qids[s + r]), int(ids[near[o]]), float(exact[o])

        found.append(by_group(c.unionByName(q), ["part", "c", "q"], search, schema))
    if not found:
        found = [vectors.sparkSession.createDataFrame([], schema)]
    near = found[0]
    for f in found[1:]:
        near = near.union(f)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))
