"""Spelling variants, repeated passages and the hash tree against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import jaccard_join, merkle, repeats, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, tree string, key string, word string"
LONG = 2**53 + 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, len(t or ""), "clash", "clash", "clash", "clash", "clash") for i, t, lang in rows], DOCS)


# --- spelling variants ---------------------------------------------------------------


def words_by_hand(rows):
    n = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_spelling_variants(spark):
    rng = np.random.default_rng(5)
    stems = ["colour", "color", "colours", "straße", "strasse", "naïve", "naive", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "àéîõü", "abcde", "abcdx", "xbcde", "bcdef", "longerword", "longerwrd", "longrword", "l" * 3000, "l" * 3001]
    stems += ["".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(150)]
    rows = [(int(i), " ".join(rng.choice(stems, 60, p=(q := 1 / np.arange(1, len(stems) + 1)) / q.sum())) + ", Colour×Colour. COLOUR 日本 x", "en") for i in range(60)]
    rows += [(70 + i, "gather " * 40 + "gathar " * 10 + "gethar " * 3, "en") for i in range(3)]
    rows += [(LONG, "color color color", "en"), (None, "color color color", None), (7, None, "en"), (8, "", "en"), (9, " \t", "en"), rows[3], rows[3]]
    want = words_by_hand(rows)
    got = {r.word: r for r in spelling.variants(spelling.word_counts(frame(spark, rows))).collect()}
    assert {w: r.n for w, r in got.items()} == want
    linked = 0
    for w, r in got.items():
        others = sorted((o for o in want if near(w, o)), key=lambda o: (-want[o], o))
        assert r.n_near == len(others), w
        form = others[0] if others and want[others[0]] >= 2 * want[w] else None
        assert (r.form, r.form_n) == (form, want.get(form))
        root = w
        while got[root].form:
            root = got[root].form
        assert r.root == root
        linked += form is not None
    assert linked > 20 and any(r.root != r.form for r in got.values() if r.form)
    assert spelling.variants(spelling.word_counts(frame(spark, rows).limit(0))).count() == 0


# --- repeated passages ------------------------------------------------------------------


def cut_by_hand(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    low = {}
    for (i, *_), w in zip(rows, words):
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                low[key] = min(i, low.get(key, i))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and low[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(n)]
    shared = [word(n) for n in (12, 13, 14, 40, 200)]
    rows = []
    for i in rng.permutation(60):
        w = word(rng.integers(0, 30))
        for s in rng.integers(0, len(shared), 3):
            a = int(rng.integers(0, 4))
            w += shared[s][a:] + word(rng.integers(0, 5))
        rows.append((int(i), "  ".join(w) + "\n", "en"))
    rows += [(100, "same " * 300, "en"), (50, "same " * 40, "en"), (101, "Same " * 40, "en"), (102, "a\x1cb\x85c d " * 30, None), (103, "a\x1cb\x85c d " * 9, None)]
    rows += [(LONG, rows[0][1], "en"), (None, rows[0][1], "en"), (110, None, "en"), (111, "", "en"), (112, " \t ", "en"), rows[5], rows[5], (3, rows[9][1], "fr")]
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 40, 3])
def test_repeats_go(spark, monkeypatch, group):
    """Also with prefixes too frequent for one group, which are lengthened, and windows dealt over several groups."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = passages(group)
    got = repeats.without_repeats(frame(spark, rows).withColumn("kept", F.lit("clash")))
    got = collections.Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect())
    want = collections.Counter(cut_by_hand(rows))
    assert got == want
    assert sum(n for _, _, n, _ in want) > 1000


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(frame(spark, passages(1)).limit(0)).count() == 0
    few = repeats.without_repeats(frame(spark, [(1, None, None), (None, "a " * 50, None)])).collect()
    assert sorted(r.n_removed for r in few) == [0, 0]


def test_anchors_serve_every_window():
    words = np.random.default_rng(2).integers(0, 5, 400).astype(np.uint64)
    grams, place, first, last = repeats.anchors(words)
    assert first[0] == 0 and last[-1] == len(words) - 13 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 6)).all()
    assert len(repeats.anchors(words[:12])[0]) == 0


# --- hash tree ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves):
    """Root and the proof of every leaf."""
    proofs, at, level = ["" for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k in range(len(leaves)):
            own = at[k] // 8 * 8
            proofs[k] += "".join(h for j, h in enumerate(level[own : own + 8], own) if j != at[k])
            at[k] //= 8
        level = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], proofs


@pytest.mark.parametrize("size", [1, 8, 9, 64, 65, 530])
def test_hash_tree(spark, size):
    langs = ["en", None, "é", "z", "", "fr", "de", "es", "it", "pt"]
    rows = [(k * 7 % size, f"Text {k}", "en" if k % 3 else langs[k % 10]) for k in range(size)]
    rows += [(LONG, "x", "en"), (None, None, "en"), (LONG, "x", "en"), (4, "", "only"), (LONG, "same id", "en")]
    docs = frame(spark, rows)
    made = docs.withColumn("leaf", merkle.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])).withColumn("root", F.lit("clash"))
    got = merkle.manifest(made).select("doc_id", "lang", "leaf", "subroot", "root", F.col("size"), merkle.proof_digest(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded"))

    def coded(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    by = collections.defaultdict(list)
    for i, t, lang in rows:
        by[lang].append((i, sha(*[coded(x) for x in (i, None, lang, len(t or ""), t)])))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        trees[lang] = tree_by_hand([h for _, h in by[lang]])
    root, above = tree_by_hand([trees[x][0] for x in order])
    want = collections.Counter((i, lang, h, trees[lang][0], root, "clash", sha(p + up), root) for lang, up in zip(order, above) for (i, h), p in zip(by[lang], trees[lang][1]))
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_hash_tree_sees_a_change_and_nothing(spark):
    docs = frame(spark, [(k, f"text {k}", "en") for k in range(20)]).withColumn("leaf", merkle.row_digest([F.col("doc_id"), F.col("text")]))
    assert merkle.manifest(docs.limit(0)).count() == 0
    seen = merkle.row_digest([F.col("doc_id"), F.concat("text", F.when(F.col("doc_id") == 7, "!").otherwise(""))])
    wrong = merkle.manifest(docs.withColumn("seen", seen)).filter(merkle.fold(F.col("seen"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [7]


# --- near copies of which few pairs link -----------------------------------------------------


@pytest.mark.parametrize("turns", [0, 3])
def test_loose_groups_of_near_copies(spark, monkeypatch, turns):
    """Each document links with a part of the others only; rounds against single nodes must not change the groups."""
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for _ in range(160):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(1, 9)):
            w[k] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.permutation(base)) for _ in range(5)] + [None, "", texts[3]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            linked += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    assert 160 * 159 / 2 * 0.05 < linked < 160 * 159 / 2 * 0.7
    df = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(df, width=5, percent=80).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
