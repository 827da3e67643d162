"""Best-fit packing of tokenized documents into sequences by run-length matching on the driver.

Spark counts the pieces of each size; documents and gaps are runs: a size and a range of
ranks. ``place_runs``, a loop on the driver, takes the longest run of documents and matches it with the gaps from
its successor upwards (the smallest gap that holds it), many documents at a time; what has no gap opens new
sequences. This replaces distributed successor sweeps with conflicts resolved by rank: a run has one successor, so there are no conflicts, and
sizes are integers up to the sequence length, so the runs are bounded by
it and not by the number of documents. Those stay distributed: they learn their place
from their rank within their length by a join with the runs.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import partitions, small_batches, stored
from barloom.llm.tokens import Encoder, tokenizer_path

LENGTH = 2048
END = 0


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): the pieces of every document, cut at ``length`` only if longer."""
    path = path or tokenizer_path()

    def cut(batches):
        encoder = Encoder.of(path)
        end = np.array([END], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            rows = []
            for key, t in zip(batch["id"], batch["text"]):
                ids = encoder.ids(t) + end
                rows += [(key, k, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_column].dataType.simpleString()
    made = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(cut, "id string, piece int, start bigint, length bigint, ids_crc32 bigint")
    return made.withColumn("id", F.col("id").cast(kind))


def place_runs(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (size, first rank, last rank + 1, first sequence, offset) for ``counts`` of pieces by size.

    Rank r of the run goes to sequence ``first sequence + r - first rank`` at ``offset``.
    """
    gaps: dict[int, deque] = {}  # gap size -> runs (first sequence, number)
    sizes: list[int] = []  # gap sizes in order
    out, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].popleft()
                taken = min(left, number)
                if taken < number:
                    gaps[gap].appendleft((first + taken, number - taken))
                elif not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first, taken = length, opened, left
                opened += left
            out.append((size, rank, rank + taken, first, length - gap))
            rank, left = rank + taken, left - taken
            if gap > size:
                if gap - size not in gaps:
                    gaps[gap - size] = deque()
                    bisect.insort(sizes, gap - size)
                gaps[gap - size].append((first, taken))
    return out


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` has length (1 to ``length``) and is read more than once.

    Equal pieces, ties and repeated rows get places of their own; an empty table gives no rows.
    A length that many pieces share is ranked in salted cells.
    """
    spark = pieces.sparkSession
    order = [c for c in pieces.columns if c not in ("length", "sequence_id", "offset", "_salt")]
    rows = pieces.drop("sequence_id", "offset").withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(partitions(spark))).cast("int"))
    cells = rows.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in cells.groupBy("length").agg(F.sum("_n")).collect()}  # at most `length` rows
    if any(size < 1 or size > length for size in counts):
        raise ValueError(f"pieces must have 1 to {length} tokens")
    runs = spark.createDataFrame(place_runs(counts, length), "_size bigint, _low bigint, _high bigint, _first bigint, offset bigint")
    line = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(cells, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_salt")
    # The runs of one size are few and bounded by the sequence length; equality on the size, then the range.
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    return placed.select(*pieces.drop("sequence_id", "offset").columns, (F.col("_first") + F.col("_rank") - F.col("_low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id. Ids are the tokenizer's without special
    tokens, then id 0. The pieces, a few numbers each, are written once, as two passes read them.
    """
    small_batches(docs.sparkSession)
    pieces = stored(token_pieces(docs, id_column, text, length, path))
    return pack(pieces, length).withColumnRenamed("id", id_column)
