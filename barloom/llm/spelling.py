"""Spelling variants: words one edit apart, each led to the far more frequent one it may be a misspelling of.

Asymmetric q-chunks: of two words at most one edit apart the longer (either, if equal) is cut into two disjoint chunks, of
which the edit leaves one whole; the other word has that chunk among its positional grams, shifted by one position at
most. As the lengths are part of the key, the shift is known, so of all positional grams only those that can meet a
chunk are made: those aligned with its start, or with its end. Half a word is a weak key, therefore the half that holds the edit is
chunked once more in the same way, and the key is the whole chunk with the whole chunk of the other half. Keys meet in a join, all
pairs are verified by their edit distance, so none is lost and none is wrong.

Defined results: null texts have no words; a null id counts as an empty one; equal rows count as often as they occur; no words give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

NOISE = 97
# Letters of words by their Latin-1 code: A-Z lowered, a-z and U+00C0 to U+00FF as they are; all else parts words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_HELD = 1 << 24  # bytes of words a task counts before it hands them on


def _counted(ident: str | None, text: str | None) -> Counter:
    """Words of one document, with one letter dropped where the hash of document and word asks for it."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(b"%s:" % (ident or "").encode())
    for w, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % NOISE == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points that occur ``least`` times or more."""

    def count(batches):
        held, size = Counter(), 0
        for b in batches:
            for ident, t in zip(b["i"], b["t"]):
                for w, n in _counted(ident, t).items():
                    if len(w) >= shortest:
                        if w not in held:
                            size += len(w) + 64
                        held[w] += n
                if size > _HELD:
                    yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
                    held, size = Counter(), 0
        yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

    rows = docs.select(F.col(id_column).cast("string").alias("i"), F.col(text).alias("t"))
    counts = rows.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def _keys(length: Column) -> Column:
    """Keys of a word as one side of pairs whose longer word has ``length`` code points.

    The first two keys leave out a quarter of the second half, the others one of the first half.
    """
    word, own = F.col("word"), F.length("word")
    q = F.floor(length / 2)  # the first chunk; the second has the rest
    a1, b1 = F.floor(q / 2), F.floor((length - q) / 2)
    head = lambda n: F.substring(word, F.lit(1), n)
    tail = lambda n: F.substring(word, own - n + 1, n)
    empty = F.lit("")
    kept = [(head(q + b1), empty), (head(q), tail(length - q - b1)), (head(a1), tail(length - q)), (empty, tail(length - a1))]
    return F.array(*[F.xxhash64(F.lit(k), length, x, y) for k, (x, y) in enumerate(kept)])


def near_words(words: DataFrame) -> DataFrame:
    """Distinct (a, an, b, bn): words of ``words`` (word, n) exactly one code point inserted, deleted or replaced apart, a before b."""
    own = F.length("word")
    chunks = words.select(F.explode(_keys(own)).alias("key"), F.col("word").alias("s"), F.col("n").alias("sn"))
    # The partner is as long as the word in chunks, or shorter by one.
    grams = F.concat(_keys(own), _keys(own + 1))
    grams = words.select(F.explode(grams).alias("key"), F.col("word").alias("t"), F.col("n").alias("tn"))
    pairs = chunks.join(grams, "key").filter((F.length("s") > F.length("t")) | (F.col("s") < F.col("t")))
    pairs = pairs.filter(F.levenshtein("s", "t", 1) == 1)
    first = F.col("s") < F.col("t")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(pick("s", "t").alias("a"), pick("sn", "tn").alias("an"), pick("t", "s").alias("b"), pick("tn", "sn").alias("bn")).distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the end by doubling; counts grow on the way, so it ends."""
    reached = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = step.drop("moved")
        if step.filter("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root.

    ``form`` is the near word of largest n, ties to the smallest word, if it occurs ``ratio`` times as often or more; ``root`` the last of
    the forms followed from the word, the word itself if it has none.
    """
    words = stored(words.select("word", "n"))
    near = stored(near_words(words))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m"))
    both = both.union(near.select("b", "a", "an"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    leads = F.col("form_n") >= ratio * F.col("n")
    found = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n"))
    found = stored(found)
    roots = _followed(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
