"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import Encoder, tokenizer_path

FREQUENT = 32_768  # entries of the broadcast table, whatever the corpus
PER_TASK = 8_192  # most frequent pre-tokens a task reports
LONGEST = 64  # characters of a pre-token that may enter the table
_FOLD = 1_000_000  # distinct pre-tokens a task holds before it forgets those seen once


def frequent_pretokens(docs: DataFrame, text: str = "text", size: int = FREQUENT) -> DataFrame:
    """(chunk, n): the pre-tokens most frequent over all texts, at most ``size``.

    Tasks count all their texts and report their own most frequent ones, so what
    is shuffled is bounded by tasks x ``PER_TASK``, never pre-tokens.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch[text]:
                if t:
                    seen.update(Encoder.split(t))
                    if len(seen) > _FOLD:
                        seen = Counter({k: n for k, n in seen.items() if n > 1}) if any(n > 1 for n in seen.values()) else Counter()
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if n > 1 and len(k) <= LONGEST]
        yield pd.DataFrame(top, columns=["chunk", "n"]).astype({"chunk": str, "n": "int64"})

    found = docs.select(text).mapInPandas(count, "chunk string, n bigint")
    return found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text.

    A null or empty text has 0 bytes and 0 tokens; repeated rows stay repeated;
    a null id stays null; an empty table gives no rows; other columns are ignored.
    First tier: a broadcast table of at most ``FREQUENT`` pre-token lengths (a bound
    on its size, not on the result). Second tier: each worker's cache of pre-tokens
    it has encoded. Texts never leave their task.
    """
    path = path or tokenizer_path()
    encoder = Encoder.of(path)
    lengths = {r.chunk: len(encoder.chunks[r.chunk]) // 4 for r in frequent_pretokens(docs, text).collect()}  # at most FREQUENT rows
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches):
        first, second = shared.value, Encoder.of(path)
        for batch in batches:
            rows = []
            for t in batch[text]:
                t = t or ""
                misses = []
                n = 0
                for c in Encoder.split(t):
                    k = first.get(c)
                    if k is None:
                        misses.append(c)
                    else:
                        n += k
                chunks = second.chunks
                n += sum([len(chunks[c]) for c in misses]) // 4
                rows.append((len(t.encode()), n))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens"], dtype="int64")
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    kind = docs.schema[id_column].dataType.simpleString()
    counted = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias(text)).mapInPandas(count, "id string, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").cast(kind).alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
