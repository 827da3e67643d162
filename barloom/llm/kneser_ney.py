"""Quality by an interpolated modified Kneser-Ney model of character n-grams of trusted text.

An n-gram is a number: ``BITS`` bits a character, so suffixes and contexts are bit operations. Counts, continuation
counts and context sums are shuffled aggregates, spread by n-gram. Documents stay where they are read: a bounded table
of frequent n-grams is broadcast with their log-probabilities, and each document's distinct other n-grams
meet the counts in joins spread by n-gram. The model itself is as large as the trusted text makes it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix, stored

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
PAD, END, FIRST = 0, 1, 2
_SPACE, _DIGIT = 32 + FIRST, 48 + FIRST
_KEPT = 2048  # code points up to here have a symbol of their own, the others share the rest
_BATCH = 200_000  # characters held as n-grams at a time
_HELD = 400_000  # distinct n-grams a task holds for a language before it hands them on
FREQUENT = 1 << 20  # n-grams looked up in memory, at most; the joins answer for all others
LEAST = 8


def _symbols() -> np.ndarray:
    cp = np.arange(_KEPT)
    s = cp + FIRST
    s[:33] = _SPACE
    s[127:161] = _SPACE
    s[48:58] = _DIGIT
    return s


_SYMBOL = _symbols()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of whole texts, one after the other, and how many each text has (its characters and an end)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    sym = np.where(cp < _KEPT, _SYMBOL[np.minimum(cp, _KEPT - 1)], _KEPT + FIRST + cp % (SYMBOLS - _KEPT - FIRST))
    slots = lengths + ORDER  # ORDER - 1 pads, the text, an end
    ends = np.cumsum(slots)
    line = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    text = np.arange(len(sym)) + np.repeat(np.arange(len(texts)) * ORDER + ORDER - 1, lengths)
    line[text] = sym
    line[ends - 1] = END
    g = np.zeros(len(line), np.int64)
    for k in range(ORDER):
        g[k:] |= line[: len(line) - k] << (BITS * k)
    real = np.ones(len(line), bool)
    for k in range(ORDER - 1):
        real[ends - slots + k] = False
    return g[real], lengths + 1


def _batches(texts):
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= _BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_language(batch: pd.DataFrame):
    """(lang, row positions, texts) with a bounded number of characters each."""
    for lang, rows in batch.reset_index(drop=True).groupby("lang", sort=False):
        texts = rows["text"].tolist()
        for at in _batches(texts):
            yield lang, rows.index[at], [texts[i] for i in at]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) of documents (lang, text): tasks add up their own before anything is shuffled."""

    def added(x, y):
        gram, c = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
        order = np.argsort(gram, kind="stable")  # two sorted runs: a merge
        gram, c = gram[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(c, first)

    def frame(lang, counted):
        return pd.DataFrame({"gram": counted[0], "c": counted[1], "lang": lang})

    def count(batches):
        held: dict[str, tuple] = {}
        for b in batches:
            for lang, _, texts in _by_language(b):
                new = np.unique(grams(texts)[0], return_counts=True)
                held[lang] = added(held[lang], new) if lang in held else new
                if len(held[lang][0]) > _HELD:  # hand on what has gathered; sums come later
                    yield frame(lang, held.pop(lang))
        for lang, counted in held.items():
            yield frame(lang, counted)

    return docs.mapInPandas(count, "gram bigint, c bigint, lang string").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def suffix(gram, k: int):
    return gram.bitwiseAND(F.lit((1 << (BITS * k)) - 1))


def context(gram, k: int):
    return F.shiftright(suffix(gram, k), BITS)


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, lang, gram, excess) and (k, lang, context, total, mass) of interpolated modified Kneser-Ney.

    p_k(w | h) = excess / total + mass / total x p_(k-1)(w | h'), with the highest order's counts, the numbers of
    different left neighbours below it, and three discounts for each language and order from its counts of counts.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("lang", suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c"))
    every = None
    for k, t in orders.items():
        t = t.select(F.lit(k).alias("k"), "lang", "gram", "c", context(F.col("gram"), k).alias("context"))
        every = t if every is None else every.unionByName(t)
    every = stored(every)
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    spread = every.groupBy("k", "lang").agg(*n)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i):
        d = i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        # Too few counts to estimate from: halves.
        return F.when((F.col("n1") > 0) & (d > 0) & (d < i), d).otherwise(i / 2).alias(f"d{i}")

    spread = spread.select("k", "lang", discount(1), discount(2), discount(3))
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    known = every.join(F.broadcast(spread), ["k", "lang"]).withColumn("d", d)  # ORDER rows for each language
    contexts = known.groupBy("k", "lang", "context").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("mass"))
    return stored(known.select("k", "lang", "gram", (F.col("c") - F.col("d")).alias("excess"))), stored(contexts)


def log_probabilities(wanted: DataFrame, known: DataFrame, contexts: DataFrame) -> DataFrame:
    """(lang, gram, lp) for (lang, gram), order by order from the uniform distribution up."""
    p = wanted.withColumn("p", F.lit(1.0 / SYMBOLS))
    for k in range(1, ORDER + 1):
        seen = known.filter(F.col("k") == k).select("lang", F.col("gram").alias("_g"), "excess")
        above = contexts.filter(F.col("k") == k).select("lang", F.col("context").alias("_c"), "total", "mass")
        p = p.withColumn("_g", suffix(F.col("gram"), k)).withColumn("_c", context(F.col("gram"), k))
        p = p.join(above, ["lang", "_c"], "left").join(seen, ["lang", "_g"], "left")
        share = (F.coalesce("excess", F.lit(0.0)) + F.col("mass") * F.col("p")) / F.col("total")
        p = p.select("lang", "gram", F.coalesce(share, "p").alias("p"))
    return p.select("lang", "gram", F.log("p").alias("lp"))


def _slots(g: np.ndarray, code, bits: int, turn: int) -> np.ndarray:
    return (mix(g.view(np.uint64) ^ (np.asarray(code + 64 * turn).astype(np.uint64) << np.uint64(40))) >> np.uint64(64 - bits)).astype(np.int64)


def frequent_grams(docs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(lang, gram, c): the at most ``most`` n-grams most frequent in documents (lang, text), ties with the last left out.

    All texts are counted. An n-gram of fewer than ``LEAST`` occurrences is cheaper to join than to broadcast. The choice
    decides which n-grams are looked up in memory, never what a document scores.
    """
    counted = stored(count_grams(docs.select("lang", "text")).filter(F.col("c") >= LEAST))
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)  # at most 8 x 64 rows
    low, room = 8 * 64, most
    for r in sizes:
        room -= r.n
        if room < 0:
            break
        low = r.level
    return counted.filter(level >= low)


class Frequent:
    """Log-probabilities of frequent n-grams in hash tables; what finds its slot taken goes to the next, smaller table."""

    def __init__(self, langs: list[str], codes: np.ndarray, keys: np.ndarray, lps: np.ndarray):
        self.codes, self.keys, self.lps = codes, keys, lps
        self.code = {x: i for i, x in enumerate(langs)}
        self.tables: list[tuple[int, int, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left):
            bits, turn = max(int(len(left) * 2).bit_length(), 8), len(self.tables)
            slots = np.zeros(1 << bits, np.int32)
            at = _slots(keys[left], codes[left], bits, turn)
            slots[at] = left
            self.tables.append((bits, turn, slots))
            left = left[slots[at] != left]

    def find(self, lang: str, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each n-gram is here, and its log-probability or 0."""
        hits, lps = np.zeros(len(g), bool), np.zeros(len(g))
        code = self.code.get(lang)
        left = np.arange(len(g) if code is not None else 0)
        for bits, turn, slots in self.tables:
            asked = g[left]
            at = slots[_slots(asked, np.int32(code or 0), bits, turn)]
            hit = (self.keys[at] == asked) & (self.codes[at] == code)
            hits[left[hit]], lps[left[hit]] = True, self.lps[at[hit]]
            left = left[~hit]
        return hits, lps


def perplexities(docs: DataFrame, known: DataFrame, contexts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(id, row_hash, lang, n, surprise): nats per character of documents (id, row_hash, lang, text); other columns are carried along.

    Two tiers: at most ``most`` frequent n-grams are broadcast with their log-probabilities, so documents do not travel; the distinct other
    n-grams of each document meet the counts in joins and come back as sums.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != "text"]
    frequent = frequent_grams(docs, most)
    answers = log_probabilities(frequent.select("lang", "gram"), known, contexts)
    got = answers.join(frequent, ["lang", "gram"]).select("lang", "gram", "c", "lp").toArrow()  # at most ``most`` rows
    lang = got["lang"].combine_chunks().dictionary_encode()
    langs, codes, keys = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int32), got["gram"].to_numpy()
    order = np.lexsort((keys, np.argsort(np.argsort(langs))[codes], got["c"].to_numpy())) if len(keys) else np.zeros(0, np.int64)
    table = spark.sparkContext.broadcast((langs, codes[order], keys[order], got["lp"].to_numpy()[order]))
    del got, lang, codes, keys, order

    def look(batches):
        here = Frequent(*table.value) if len(table.value[0]) else None
        for b in batches:
            for lang, at, texts in _by_language(b):
                g, lengths = grams(texts)
                hit, lps = here.find(lang, g) if here else (np.zeros(len(g), bool), np.zeros(len(g)))
                ends = np.cumsum(lengths)
                rows = b.iloc[at][own].assign(n=lengths, part=np.add.reduceat(lps, ends - lengths))
                left = np.flatnonzero(~hit)
                doc, g = np.searchsorted(ends, left, side="right"), g[left]
                order = np.lexsort((g, doc))
                doc, g = doc[order], g[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.int64)
                times = np.diff(first, append=len(g)).astype(np.int32)
                cuts = np.searchsorted(doc[first], np.arange(1, len(texts)))
                rows["grams"], rows["times"] = pd.Series(np.split(g[first], cuts), rows.index, object), pd.Series(np.split(times, cuts), rows.index, object)
                yield rows

    # Own columns go through Python as text: whole numbers beside a null one would lose digits.
    kinds = {c: docs.schema[c].dataType.simpleString() for c in own}
    passed = docs.select(*[F.col(c).cast("string").alias(c) for c in own], "text")
    looked = passed.mapInPandas(look, ", ".join(f"{c} string" for c in own) + ", n bigint, part double, grams array<bigint>, times array<int>")
    looked = looked.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "n", "part", "grams", "times")
    looked = stored(looked.withColumn("row", F.monotonically_increasing_id()))
    rare = looked.select("row", "lang", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "lang", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
    found = log_probabilities(rare.select("lang", "gram").distinct(), known, contexts)
    rest = rare.join(found, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("rest"))
    total = F.col("part") + F.coalesce("rest", F.lit(0.0))
    return looked.select(*own, "n", "part", "row").join(rest, "row", "left").select(*own, "n", F.round(-total / F.col("n"), 9).alias("surprise"))
