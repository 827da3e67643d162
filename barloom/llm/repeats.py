"""Passages that repeat across documents, by suffix trees over groups of suffixes with a common prefix.

A window is ``LENGTH`` words. Of its 7-word grams the one of smallest hash is its anchor, so equal windows have equal anchors in equal
places, and only the suffixes that start at anchors need to be sorted: about a quarter of all.

1. Prefix counts: anchors' grams that occur in one document only start no repeat and are dropped.
2. Each other gram is the prefix of a group. Where more than ``GROUP`` suffixes share it, the prefix is lengthened to the
   whole window, each window becoming a suffix of its own.
3. A task sorts the suffixes of a group by words; runs of long common prefixes are the deep internal nodes of its suffix tree. Split by the words
   to the left they are the repeated windows; those whose document is not the smallest of the node are marked.
4. A window so frequent that even its own group is too large is dealt over several groups; what stays unmarked in them (at least the smallest
   document of each) meets in one group afterwards.

Windows are compared word by word, by 64-bit hashes of words. Marks go back to their documents by a join.
Defined results: null or empty texts have no words; a row without id keeps all its words and marks none; rows that share an id are one
document for this, so none of them removes words of another; equal rows get equal results; an empty table gives no rows. Other columns stay;
columns named n_words, n_removed or kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import hashed_words, mix, partitions, release, stored, whole_groups

LENGTH = 13
GRAM = 7
GROUP = 1 << 14  # suffixes that share a prefix, at most, before it is lengthened
_SLICE = 1 << 20  # bytes of text read at once
_SHIFT = 16  # a mark is the place of an anchor, and one bit for each window that holds it


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _chained(words: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ``width`` words in a row, at every place or at those given."""
    at = np.arange(max(len(words) - width + 1, 0)) if at is None else at
    h = np.full(len(at), width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[at + i])
    return h


def anchors(words: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams and places of the anchors of all windows, with the first and last window start each serves.

    ``doc`` tells which document a word is of, if there are several after each other; windows lie within one.
    """
    m = len(words) - LENGTH + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    grams = _chained(words, GRAM)
    least, place = grams[:m].copy(), np.arange(m)
    for i in range(1, LENGTH - GRAM + 1):
        less = grams[i : i + m] < least
        least[less] = grams[i : i + m][less]
        place[less] = np.flatnonzero(less) + i
    whole = np.arange(m) if doc is None else np.flatnonzero(doc[:m] == doc[LENGTH - 1 :])
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole][1:] != place[whole][:-1]) | (np.diff(whole) > 1)
    at = np.flatnonzero(new)
    first, last = whole[at], whole[np.append(at[1:], len(whole)) - 1] if len(at) else at
    return least[first], place[first], first, last


def _slices(texts: pd.Series):
    """(positions, bytes of their texts, a line each) of some documents at a time; a long document is one slice."""
    held, at, size = [], [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode())
        at.append(i)
        size += len(held[-1])
        if size > _SLICE:
            yield at, held
            held, at, size = [], [], 0
    if at:
        yield at, held


def _read(held: list[bytes]):
    """Hashes, starts and ends of the words of several texts, the text each is of, and all texts in one."""
    joined = b"\n".join(held)
    words, start, end = hashed_words(np.frombuffer(joined, np.uint8))
    begins = np.cumsum([0, *[len(h) + 1 for h in held[:-1]]])
    return words, start, end, np.searchsorted(begins, start, side="right") - 1, joined


def _prefixes(docs: DataFrame) -> DataFrame:
    """(gram, id, n): how often each document has each anchor."""

    def run(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            for at, held in _slices(b["text"]):
                words, _, _, doc, _ = _read(held)
                grams, place, _, _ = anchors(words, doc)
                own = doc[place] if len(place) else place
                order = np.lexsort((grams, own))
                grams, own = grams[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])])) if len(grams) else place
                yield pd.DataFrame({"gram": grams[first].view(np.int64), "id": ids[np.asarray(at)[own[first]]], "n": np.diff(first, append=len(grams))})

    return docs.select("id", "text").mapInPandas(run, "gram bigint, id bigint, n bigint")


_SUFFIX = "prefix bigint, salt int, id bigint, text_hash bigint, place bigint, left int, right int, words binary"


def _suffixes(docs: DataFrame) -> DataFrame:
    """Suffixes at anchors whose gram other documents have too: ``left`` words before the anchor, ``right`` from it on.

    ``docs`` has the document's shared grams and how often each occurs in all documents.
    """

    def run(batches):
        for b in batches:
            ids, hashes = b["id"].to_numpy(), b["text_hash"].to_numpy()
            for at, held in _slices(b["text"]):
                words, start, end, doc, joined = _read(held)
                grams, place, first, last = anchors(words, doc)
                # A gram that one document shares all documents share that have it.
                known, one = np.unique(np.concatenate([b["shared"].iloc[i] for i in at]), return_index=True)
                often = np.concatenate([b["often"].iloc[i] for i in at])[one]
                where = np.minimum(np.searchsorted(known, grams.view(np.int64)), len(known) - 1)
                found = known[where] == grams.view(np.int64)
                grams, place, first, last, often = grams[found].view(np.int64), place[found], first[found], last[found], often[where[found]]
                row = np.asarray(at)[doc[place]] if len(place) else place
                salt = np.zeros(len(grams), np.int64)
                # Frequent grams: every window is a suffix of its own, under a prefix as long as the window.
                times = np.where(often > GROUP, last - first + 1, 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                grams, place, first, last, often, row, salt = (np.repeat(x, times) for x in (grams, place, first, last, often, row, salt))
                hot = often > GROUP
                first = first + step
                last = np.where(hot, first, last)
                grams[hot] = _chained(words, LENGTH, first[hot]).view(np.int64)
                salt[hot] = 1 + (hashes[row[hot]] + place[hot]) % -(-often[hot] // GROUP)
                base = np.searchsorted(doc, doc[place]) if len(place) else place  # places count from the document's first word
                texts = [joined[x:y] for x, y in zip(start[first].tolist(), end[last + LENGTH - 1].tolist())] if len(place) else []
                yield pd.DataFrame(
                    {"prefix": grams, "salt": salt, "id": ids[row], "text_hash": hashes[row], "place": place - base, "left": place - first, "right": last + LENGTH - place, "words": pd.Series(texts, dtype=object)}
                )

    return docs.mapInPandas(run, _SUFFIX)


def later(group: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each suffix the windows, one bit for each distance of start and anchor, that a smaller id of its group has too."""
    words = hashed_words(np.frombuffer(b" ".join(texts), np.uint8))[0]
    begin = np.cumsum(left + right) - right  # the anchors
    n, last = len(ids), len(words) - 1
    ahead = np.zeros((LENGTH, n), np.uint64)
    for d in range(LENGTH):
        ahead[d] = np.where(d < right, words[np.minimum(begin + d, last)], 0)
    # Suffix array of each group and the common prefixes of neighbours in it.
    order = np.lexsort((*ahead[::-1], group))
    ahead, group, ids, left, right, begin = ahead[:, order], group[order], ids[order], left[order], right[order], begin[order]
    common = np.zeros(n, np.int64)
    alike = np.concatenate([[False], group[1:] == group[:-1]])
    for d in range(LENGTH):
        alike[1:] &= ahead[d, 1:] == ahead[d, :-1]
        common += alike
    marks = np.zeros(n, np.int64)
    before = np.zeros(n, np.uint64)
    for o in range(LENGTH - GRAM + 1):
        if o:
            before = mix(before * np.uint64(0xD6E8FEB86659FD93) + words[np.maximum(begin - o, 0)])
        node = np.cumsum(common < LENGTH - o)  # nodes at this depth, in order
        has = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(has) < 2:
            continue
        has = has[np.lexsort((ids[has], before[has], node[has]))]
        new = np.concatenate([[True], (node[has][1:] != node[has][:-1]) | (before[has][1:] != before[has][:-1])])
        least = ids[has][np.flatnonzero(new)][np.cumsum(new) - 1]
        marks[has[ids[has] > least]] |= 1 << o
    out = np.zeros(n, np.int64)
    out[order] = marks
    return out


def _trees(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """``suffixes`` with the marks of the suffix tree of their group; of those sure to be marked whole the words go."""

    def run(batches):
        for rows, bounds in whole_groups(batches, keys):
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            left, right = rows["left"].to_numpy().astype(np.int64), rows["right"].to_numpy().astype(np.int64)
            marks = later(group, rows["id"].to_numpy(), left, right, list(rows["words"]))
            done = (marks != 0) | (rows["salt"].to_numpy() == 0)
            out = rows[["prefix", "salt", "id", "text_hash", "place", "left", "right"]].copy()
            out["words"] = np.where(done, None, rows["words"].to_numpy())
            out["marks"] = marks
            yield out[(marks != 0) | ~done]

    spread = suffixes.repartition(partitions(suffixes.sparkSession), *keys).sortWithinPartitions(*keys)
    return spread.mapInPandas(run, _SUFFIX + ", marks bigint")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, text_hash, marks): for each row of ``docs`` (id, text_hash, text) with such windows, those a smaller id has too."""
    spark = docs.sparkSession
    docs = docs.filter("id IS NOT NULL AND text IS NOT NULL")
    prefixes = _prefixes(docs)
    shared = prefixes.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("often")).filter("low < high")
    lists = prefixes.select("gram", "id").join(shared.select("gram", "often"), "gram").groupBy("id").agg(F.collect_list(F.struct("gram", "often")).alias("g"))
    lists = stored(lists.select("id", F.col("g.gram").alias("shared"), F.col("g.often").alias("often")))
    release(spark)
    marked = stored(_trees(_suffixes(docs.join(lists, "id")), ["prefix", "salt"]))
    release(spark)
    rest = _trees(marked.filter("words IS NOT NULL").drop("marks").withColumn("salt", F.lit(0)), ["prefix"])
    marks = marked.filter("marks <> 0").select("id", "text_hash", "place", "marks").union(rest.select("id", "text_hash", "place", "marks"))
    packed = F.shiftleft("place", _SHIFT) + F.col("marks")
    return stored(marks.groupBy("id", "text_hash").agg(F.collect_list(packed).alias("marks")))


def covered(n: int, marks) -> np.ndarray:
    """Which of ``n`` words the marked windows cover."""
    steps = np.zeros(n + 1, np.int64)
    marks = np.asarray([] if marks is None else marks, np.int64)
    for o in range(LENGTH - GRAM + 1):
        start = (marks >> _SHIFT)[(marks >> o) & 1 == 1] - o
        np.add.at(steps, start, 1)
        np.add.at(steps, start + LENGTH, -1)
    return np.cumsum(steps[:n]) > 0


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words left, joined by one space.

    Words go that a window covers whose words also start in a document of smaller id.
    """
    docs = docs.drop("n_words", "n_removed", "kept")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for t, m in zip(texts, marks):
            raw = _bytes(t).copy()
            _, start, end = hashed_words(raw)
            gone = covered(len(start), m)
            start, end = start[~gone], end[~gone]
            edges = np.zeros(len(raw) + 1, np.int8)
            edges[start] = 1
            edges[end] = -1
            stays = np.cumsum(edges[:-1], dtype=np.int8) > 0
            raw[end[:-1]] = 0x20  # one space after each word but the last
            stays[end[:-1]] = True
            out.append((len(gone), int(gone.sum()), raw[stays].tobytes().decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(given.alias("row"), F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    marks = repeated_windows(rows.select("id", "text_hash", "text"))
    joined = rows.drop("text").join(marks, ["id", "text_hash"], "left").select("row", cut(F.col("row")[text], F.col("marks")).alias("cut"))
    return joined.select("row.*", "cut.*")
