"""Near-duplicate vectors through randomised-rotation binary codes.

A unit vector is rotated at random and kept as signs plus one correction factor, its inner
product with its own code. Code times query over that factor estimates the inner product of the two vectors
without bias, with a known deviation; only pairs whose upper confidence bound reaches the
threshold are recomputed from the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_group, components, cross_pairs, star_pairs, stored

SIGMAS = 5.0  # of the estimate's deviation: one pair in three million at the threshold is misjudged
MISSED = 1e-4  # chance that a pair exactly at the threshold shares no bucket; closer pairs are safer
BLOCK = 1024


def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, k, 7]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(column: str):
    """Not null or zero, no null or non-finite component."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def table_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): keys long enough that unrelated vectors rarely meet, tables enough that links do."""
    bits = max(8, round(math.log2(max(rows, 2))) - 3)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


def unit_rows(x: pd.Series) -> np.ndarray:
    v = np.array(x.tolist(), np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, signs, factor) of unit vectors."""
    r = v @ rotation(v.shape[1], 0)
    s = np.where(r > 0, 1.0, -1.0)
    return r, s, (np.abs(r).sum(axis=1) / math.sqrt(v.shape[1]))


def may_reach(signs, factor, rotated, threshold: float) -> np.ndarray:
    """For codes against queries: whether the estimate plus its confidence bound reaches ``threshold``."""
    dim = signs.shape[1]
    estimate = (signs @ rotated.T) / math.sqrt(dim) / factor[:, None]
    bound = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))
    return estimate + bound[:, None] >= threshold


def exact_pairs(v1, v2, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows with cosine >= threshold: codes first, then the double-precision value."""
    _, s, f = coded(v1)
    r, _, _ = coded(v2)
    i, j = np.nonzero(may_reach(s, f, r, threshold))
    good = [np.einsum("ij,ij->i", v1[i[s : s + 65536]], v2[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Vectors of one length link when their cosine is >= ``threshold``. Equal vectors are one node with a
    count. Nodes meet in buckets of sign bits from several rotations; those found linked there form components, and the links
    of a node are counted within its component, block against block, so large groups are neither
    gathered nor written out as pairs.

    A vector that is null, zero or has null or non-finite components has no links and is its own
    component, as has a row without id (its component is null). Rows that share an id share a
    component; repeated rows are links of each other. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v")).withColumn("good", usable("v") & F.col("id").isNotNull())
    rows = rows.withColumn("h", F.when(F.col("good"), F.xxhash64("v", F.size("v"))))
    nodes = stored(rows.filter("good").groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")))
    bits, tables = table_shape(nodes.count(), threshold)

    def keys(batches):
        for b in batches:
            for dim in sorted({len(x) for x in b["v"]}):
                part = b[b["v"].map(len) == dim]
                u = unit_rows(part["v"])
                take = min(bits, dim)
                per = max(1, dim // take)
                weights = np.int64(1) << np.arange(take, dtype=np.int64)
                for t in range(tables):
                    if t % per == 0:
                        signs = (u @ rotation(dim, 1 + t // per)) > 0
                    at = t % per * take
                    code = signs[:, at : at + take].astype(np.int64) @ weights
                    # Bits, table and length side by side; a hash when they need more than 63 bits.
                    key = code + (np.int64(t) << np.int64(take)) if take < 40 else np.array([hash((int(c), t, dim)) for c in code])
                    yield pd.DataFrame({"key": key * 4096 + dim % 4096, "node": part["node"].to_numpy()})

    postings = nodes.select("node", "v").mapInPandas(keys, "key bigint, node bigint")
    crowded = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = stored(postings.join(crowded, "key").join(nodes.select("node", "v"), "node"))

    def same(b):
        out = np.zeros(len(b), bool)
        dims = b["v"].map(len).to_numpy()
        match = dims == b["first_v"].map(len).to_numpy()
        for dim in np.unique(dims[match]):
            at = np.flatnonzero(match & (dims == dim))
            v, w = unit_rows(b["v"].iloc[at]), unit_rows(b["first_v"].iloc[at])
            _, s, f = coded(v)
            r, _, _ = coded(w)
            estimate = np.einsum("ij,ij->i", s, r) / math.sqrt(dim) / f
            may = estimate + SIGMAS * np.sqrt(np.maximum(1 - f**2, 0)) / f / math.sqrt(max(dim - 1, 1)) >= threshold
            out[at[may]] = np.einsum("ij,ij->i", v[may], w[may]) >= threshold
        return out

    def prepare(rows):
        """Per vector length: the rows' places, unit vectors, and their codes."""
        dims, place = rows["v"].map(len).to_numpy(), np.empty(len(rows), np.int64)
        held = {}
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            place[at] = np.arange(len(at))
            u = unit_rows(rows["v"].iloc[at])
            held[dim] = (u, *coded(u))
        return dims, place, held

    def judge(arrays, i, j):
        dims, place, held = arrays
        out = np.zeros(len(i), bool)
        for dim, (u, r, s, f) in held.items():
            at = np.flatnonzero((dims[i] == dim) & (dims[j] == dim))
            p, q = place[i[at]], place[j[at]]
            estimate = np.einsum("ij,ij->i", s[p], r[q]) / math.sqrt(dim) / f[p]
            may = estimate + SIGMAS * np.sqrt(np.maximum(1 - f[p] ** 2, 0)) / f[p] / math.sqrt(max(dim - 1, 1)) >= threshold
            out[at[may]] = np.einsum("ij,ij->i", u[p[may]], u[q[may]]) >= threshold
        return out

    def cross(x, y):
        links = []
        for dim in sorted({len(v) for v in x["v"]}):
            p, q = x[x["v"].map(len) == dim], y[y["v"].map(len) == dim]
            if not len(q):
                continue
            u, w = unit_rows(p["v"]), unit_rows(q["v"])
            a, b, ca, cb = p["node"].to_numpy(), q["node"].to_numpy(), p["component"].to_numpy(), q["component"].to_numpy()
            for s in range(0, len(u), BLOCK):
                i, j = exact_pairs(u[s : s + BLOCK], w, threshold)
                i = i + s
                other = ca[i] != cb[j]
                i, j = i[other], j[other]
                if len(i):  # one link for two components is enough to join them
                    first = np.unique(np.stack([np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])]), axis=1, return_index=True)[1]
                    links.append(np.stack([a[i[first]], b[j[first]]], axis=1))
        return np.concatenate(links) if links else np.zeros((0, 2), np.int64)

    star = stored(star_pairs(buckets, ["v"], 64, same))
    rest = stored(cross_pairs(buckets, components(star), ["v"], prepare, judge, cross))
    found = stored(components(star.union(rest)).withColumnRenamed("id", "node"))

    # Links within components: every two blocks meet once.
    members = found.join(nodes, "node")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    m = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "copies", "v")

    def count(g):
        inside = g["block"].to_numpy() == g["x"].iat[0]
        one = g["x"].iat[0] == g["y"].iat[0]
        p, q = (g, g) if one else (g[inside], g[~inside])
        if not len(p) or not len(q) or len({len(v) for v in g["v"]}) != 1:
            return
        i, j = exact_pairs(unit_rows(p["v"]), unit_rows(q["v"]), threshold)
        if one:
            i, j = i[i != j], j[i != j]
            i, j = np.concatenate([i, j]), np.concatenate([j, i])  # an estimate may differ by direction
            both = np.unique(i * len(g) + j)
            i, j = both // len(g), both % len(g)
        left = np.bincount(i, q["copies"].to_numpy()[j], minlength=len(p))
        yield from zip(p["node"].tolist(), left.astype(int).tolist())
        if not one:
            right = np.bincount(j, p["copies"].to_numpy()[i], minlength=len(q))
            yield from zip(q["node"].tolist(), right.astype(int).tolist())

    counts = by_group(m, ["component", "x", "y"], count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("h", "node", "copies").join(found, "node", "left").join(counts, "node", "left")
    known = known.select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    return rows.select("id", "h").join(known, "h", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
