"""Each operator against a brute-force version, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, binary_codes, chat, html_mincut, jaccard_join, kneser_ney, mixing, packing, quality, token_counts, toxicity
from barloom.llm.common import components, table, word_hashes
from barloom.llm.tokens import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def taught(spark, sf_dir):
    """Documents and labels of the next larger tables: classifiers need some labels."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    return table(spark, larger, "documents"), table(spark, larger, "labels")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


ODD_TEXTS = [
    None,
    "",
    "   \t\n ",
    "one",
    "Don't STOP, it's 42 ﬁne — naïve café ½ Ⅷ 日本語 İSTANBUL ΟΔΟΣ été  x\x1cy\x85z　w <|endoftext|>a<|startoftext|>",
    "we'll we've 'tis they're i'd ___ --- ... $$$ a_b-c 3.14 ÀÉ ª º",
    "word " * 3000,
    "x" * 5000,
]


def odd(spark):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", None, None, "clash") for i, t in enumerate(ODD_TEXTS)] + [(3, "one", "en", "s", 3, "clash"), (None, "no id", "en", "s", 3, "clash")], DOCS)


# --- tokens and packing -----------------------------------------------------------


def test_token_counts_are_the_librarys(spark, docs):
    lib = library()
    for df in (docs, odd(spark)):
        got = collections.Counter(map(tuple, token_counts.count_tokens(df, limit=100).collect()))
        want = collections.Counter()
        for r in df.collect():
            n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 100)] += 1
        assert got == want
    assert token_counts.count_tokens(odd(spark).limit(0)).count() == 0


def test_packing_keeps_every_token_and_fills_sequences(spark, docs):
    lib = library()
    for df in (docs, odd(spark)):
        got = packing.pack_documents(df).collect()
        want = collections.Counter()
        for r in df.collect():
            ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                cut = ids[at : at + 2048]
                want[(r.doc_id, k, at, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        # Best fit decreasing, one document at a time.
        gaps = []
        for n in sorted((r.length for r in got), reverse=True):
            best = min((g for g in gaps if g >= n), default=None)
            if best is None:
                gaps.append(2048 - n)
            else:
                gaps[gaps.index(best)] -= n
        assert len(sequences) == len(gaps)
    assert packing.pack_documents(odd(spark).limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------


def filled(sizes, factor=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, still, out = factor * sum(sizes.values()), set(names), {}
    while still:
        total = sum(weight[s] for s in still)
        over = [s for s in still if left * weight[s] / total > most * sizes[s]]
        for s in over or still:
            out[s] = most * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        still -= set(over)
        left -= sum(out[s] for s in over)
    return out


def test_mix_takes_near_its_targets(spark, docs):
    for df in (docs, odd(spark)):
        got = mixing.mix_sources(df).collect()
        assert len(got) == df.count()
        sizes, taken = collections.Counter(), collections.Counter()
        for r in got:
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.copies <= 2
            sizes[r.source] += r.size
            taken[r.source] += r.copies * r.size
        want = filled(sizes)
        largest = collections.Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            largest[r.source] = max(largest[r.source], r.size)
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 2 * largest[s] + 0.02 * want[s]
    again = mixing.mix_sources(docs.repartition(7))
    assert rows_of(again, "doc_id", "copies") == rows_of(mixing.mix_sources(docs), "doc_id", "copies")
    mixed = mixing.mix_sources(docs)
    assert mixing.repeat_copies(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mix_shuffles_and_sorts_texts_once(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(i if i % 5 else None, "word " * (1 + i % 7), None, (None, "", "a", "b")[i % 4], 1, "") for i in range(200)]
    mixed = mixing.mix_sources(own.createDataFrame([*rows, *rows], DOCS))
    plan = mixed._jdf.queryExecution().executedPlan().toString().split("\n")
    # From the join with the cells, which are its right side, down to the rows' scan.
    at = next(i for i, x in enumerate(plan) if "Join" in x)
    below = plan[at + 1 : next(i for i, x in enumerate(plan) if i > at and "Scan" in x)]
    assert sum("Exchange" in x for x in below) == 1 and sum("Sort [" in x for x in below) == 1
    assert mixed.count() == 400 and {r.source for r in mixed.collect()} == {None, "", "a", "b"}


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield b.iloc[:1].assign(n=int(b["text"].str.len().sum()))[["n"]]

    own, given = spark.newSession(), spark.newSession()
    given.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1048576")
    for session, most in ((own, 9 << 20), (given, 2 << 20)):
        long = session.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 700).alias("text"))
        jaccard_join.jaccard_groups(long.limit(0))
        got = [r.n for r in long.mapInPandas(sizes, "n long").collect()]
        assert sum(got) == 9000 * 4200 and max(got) <= most
    for operator in (lambda d: mixing.mix_sources(d), lambda d: packing.pack_documents(d)):
        other = spark.newSession()
        operator(other.createDataFrame([], DOCS))
        assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


# --- near-duplicates ------------------------------------------------------------------


def linked(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, linked(ids, links)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, docs, width, percent):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 60, 120)]
    made = []
    for k in range(40):  # a chain of edits, so links hold only between some of the group
        base = list(base)
        for _ in range(rng.integers(0, 4)):
            base[rng.integers(0, len(base))] = f"n{rng.integers(0, 9999)}"
        made.append((1000 + k, " ".join(base)))
    made += [(2000, "a b"), (2001, "A  B\n"), (2002, "a b c"), (2003, None), (2004, ""), (2005, "é É"), (2006, "é é"), (2007, "x " * 4000), (2008, "x " * 5000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + made
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1))
    sets, want = brute_jaccard(rows, width, percent)
    got = jaccard_join.jaccard_groups(df, width=width, percent=percent).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_without_ids_words_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (9, None)], "doc_id bigint, text string")
    got = rows_of(jaccard_join.jaccard_groups(df).filter("doc_id IS NOT NULL"), "doc_id", "component_id")
    assert got == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert jaccard_join.jaccard_groups(df.limit(0)).count() == 0


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 6, (8, jaccard_join.GROUPS))
    c = np.maximum(0, base[rng.integers(0, 8, 400)] + rng.integers(-1, 2, (400, jaccard_join.GROUPS)) * (rng.random((400, 1)) < 0.7))
    n = c.sum(1)
    i, j = jaccard_join.tree_pairs(c, n, c[:250], n[:250], 80)
    bound = np.minimum(c[:, None], c[None, :250]).sum(2) * 180 >= 80 * (n[:, None] + n[None, :250])
    sizes = 100 * np.minimum(n[:, None], n[None, :250]) >= 80 * np.maximum(n[:, None], n[None, :250])
    want = bound & sizes
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))
    k = np.where(rng.random(400) < 0.6, 7, rng.integers(0, 90, 400))  # one large component, many small ones
    i, j = jaccard_join.tree_pairs(c, n, c[:250], n[:250], 80, k, k[:250])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want & (k[:, None] != k[None, :250])))))
    d, m, k = c[:250], n[:250], k[:250]
    i, j = jaccard_join.tree_pairs(d, m, d, m, 80, k, k)
    got = np.sort(np.stack([i, j], axis=1), axis=1)
    assert len(got) and len(np.unique(got, axis=0)) == len(got)
    assert set(map(tuple, got.tolist())) == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(want[:250] & (k[:, None] != k[None, :])))) if a < b}


def test_word_hashes_follow_words():
    words = ["ab", "abc", "a", "ABC", "é", "É", "b" * 300]
    text = " \t".join(words) + "\n"
    h = word_hashes(text)
    assert len(h) == len(words) and h[1] == h[3] and len(set(h.tolist())) == 6
    assert (word_hashes("q " * 50 + text)[50:] == h).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 50), (200, 201), (7, 7), (None, 3)] + [(500, 501 + i) for i in range(50)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "component"))
    assert got == {**{i: 1 for i in [*range(1, 61), 100]}, 200: 200, 201: 200, **{i: 500 for i in range(500, 551)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    v = list(rng.standard_normal((60, 24)))
    v += [v[0] + 0.05 * rng.standard_normal(24) for _ in range(200)] + [v[1] * 3, v[1], v[2] + 0.45 * rng.standard_normal(24)]
    for k in range(10):  # a path of close pairs
        v.append(v[-1] + 0.35 * rng.standard_normal(24))
    rows = [(10 * i, [float(np.float32(c)) for c in x], 1) for i, x in enumerate(v)]
    bad = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0, None]), (9005, [float("inf")] + [1.0] * 23), (9006, [])]
    df = spark.createDataFrame(rows + [(*b, None) for b in bad], "vec_id bigint, embedding array<float>, component int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = linked(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in binary_codes.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(bad)
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(1).tolist()))
    assert {i: got[i].component_id for i in ids} == want
    assert all((got[b[0]].n_links, got[b[0]].component_id, got[b[0]].kept) == (0, b[0], True) for b in bad)
    assert binary_codes.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, s, f = binary_codes.coded(x)
    error = s @ r.T / np.sqrt(48) / f[:, None] - x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.003
    assert (np.abs(error) <= binary_codes.SIGMAS * np.sqrt(1 - f**2)[:, None] / f[:, None] / np.sqrt(47) + 1e-9).all()


def test_nearest(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    e = df.toPandas()
    v, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.score.is_monotonic_increasing
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        at = {i: k for k, i in enumerate(ids)}
        assert np.allclose(mine.score, [d[at[i]] for i in mine.vec_id], rtol=1e-12)
        d[ids == q] = np.inf
        hit += len(set(mine.vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert hit >= 0.9 * total


def test_nearest_with_few_odd_and_equal_rows(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [2.0, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [1.0, float("nan")]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    got = rows_of(ann.nearest(df, F.col("vec_id") % 100 == 0, k=10), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 5, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- chat and pages ---------------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a <|end|>\n~1~ [INST] </s> ~"), (1, 1, "assistant", "<|assistant|>\n|~0 ünï 😀"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, "us|>er", "y" * 9000)]
    made = chat.format_conversations(spark.createDataFrame([(*t, 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, piece int"))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", "spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    for conv in (1, 2, None):
        want = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert [tuple(t) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for r, t in want if r == "assistant")
        for s, (_, t) in zip(got[conv].spans, [w for w in want if w[0] == "assistant"]):
            cut = got[conv].formatted[s.start : s.start + s.length]
            assert cut.replace("~3", "|").replace("~2", "[").replace("~1", "<").replace("~0", "~") == t


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 0, "delta", "user", "he"), (1, 1, 0, "delta", None, "llo"), (1, 2, 1, "delta", "assistant", "bad"), (1, 3, 1, "regenerate", None, None), (1, 4, 1, "delta", None, "go"),
        (1, 6, 1, "delta", None, "d"), (1, 5, 1, "delta", None, "o"), (1, 7, 0, "edit", None, "bye"), (1, 8, 0, None, None, "!"), (1, 9, 2, "regenerate", "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    assert rows_of(chat.fold_events(df), "turn", "role", "text") == [(0, "user", "bye!"), (1, "assistant", "good"), (2, "user", "")]
    assert chat.fold_events(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><a href=/>Site name</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please.</div><div class="ad">Buy now, it is cheap today.</div>
<article><h1>A title &amp; more</h1><p>First  paragraph,\n<b>bold</b> and <a href=x>a link</a> with enough words to count.<br>Next line.
<div class="advert">An advert inside of the article text.</div><p>Short.<p>Third &lt;paragraph&gt; of the article, which also has words&hellip;</article>
<section id="comments"><h2>Comments</h2><p>Great article, I liked all of it very much indeed.</p></section>
<aside><p>Related things that one might want to read as well.</p></aside><form><label>Name</label><input name=q></form><footer>&copy; example 2020 &am"""


def test_main_text(spark):
    want = "A title & more\nFirst paragraph, bold and a link with enough words to count. Next line.\nShort.\nThird <paragraph> of the article, which also has words…"
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, "clash"), (3, "", "", None), (None, "u", "<nav>only</nav>", "x")]
    got = html_mincut.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (None, "", 0)]
    assert html_mincut.extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


@pytest.mark.parametrize(
    "head,tail",
    [
        ("<body class='home has-sidebar'><article>", "</article>"),
        ("<body class='search'><main>", "</main>"),
        ("<body><article class='post category-legal'>", "</article>"),
        ("<body><div id='page' class='menu-open'>", "</div>"),
        ("<body><article class='post comments-open'>", "</article>"),
        ("<body><main class='widget'>", "</main>"),
        ("<body><div class='widget'><main>", "</main></div>"),
        ("<body><div class='overlay'><div class='content'>", "</div></div>"),
        ("<body><div id=page class='sidebar'><article>", "</article></div>"),
        ("<body><div id=content><div class='social'>", "</div></div>"),
    ],
)
def test_marks_of_outer_sections_leave_the_article(head, tail):
    words = " ".join(["Plain words of the article itself, more than a few of them."] * 9)
    comment = "A comment of a reader who liked it very much indeed and says so. " * 4
    low = f"<div class='cookie-notice'><p>{words}</p></div><section id=comments><article><p>{comment}</p></article></section><div class='google-ad'><p>Buy this now, it is cheap today and will not be tomorrow.</p></div><footer><p>{comment}</p></footer></body>"
    assert html_mincut.main_text(f"{head}<h1>Title</h1><p>{words}</p><p>{words}</p>{tail}{low}") == f"Title\n{words}\n{words}"


def test_long_comments_stay_marked():
    words, comment = "Plain words of the article itself, more than a few. " * 5, "A comment of a reader who liked it very much indeed. " * 30
    for a, b, c in (("<article>", "</article>", ""), ("<article>", "", "</article>"), ("<div class=content>", "</div>", "")):
        page = f"<body>{a}<p>{words}</p>{b}<section id=comments><article><p>{comment}</p></article></section>{c}</body>"
        assert html_mincut.main_text(page) == words.strip()


def test_pages_give_their_articles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").toPandas()
    for h in pages.html:
        body = h[h.find("<article>") :]
        body = body[: body.find("</article>")] if "</article>" in body else body
        blocks = re.split(r"</?(?:article|h1|p|footer)\b[^>]*>", body)
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert html_mincut.main_text(h).replace("\n", " ") == " ".join(w for w in want if w)


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gain = rng.normal(0, 2, n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(g for g, s in zip(gain, side) if g > 0 and not s) - sum(g for g, s in zip(gain, side) if g < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_mincut.source_side(gain, edges)) == pytest.approx(best)


# --- language models ----------------------------------------------------------------------


def brute_surprise(train, text):
    """Interpolated modified Kneser-Ney, straight from the definitions."""
    n = kneser_ney.ORDER

    def sym(t):
        g, _ = kneser_ney.grams([t])
        mask = kneser_ney.SYMBOLS - 1
        return [tuple(int(x >> (kneser_ney.BITS * (n - 1 - k))) & mask for k in range(n)) for x in g]

    counts = {n: collections.Counter(g for t in train for g in sym(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        of = collections.Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = []
        for i in (1, 2, 3):
            x = i - (i + 1) * y * of[i + 1] / of[i] if of[1] and of[i] else -1
            d.append(x if 0 < x < i else i / 2)
        discounts[k] = lambda v, d=d: d[min(v, 3) - 1]
    by = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            by[k][g[:-1]].append(v)

    def p(g):
        q = 1 / kneser_ney.SYMBOLS
        for k in range(1, n + 1):
            h = g[-k:]
            around = by[k].get(h[:-1])
            if around:
                v = counts[k].get(h, 0)
                q = ((v - discounts[k](v) if v else 0) + sum(map(discounts[k], around)) * q) / sum(around)
        return q

    logs = [np.log(p(g)) for g in sym(text)]
    return -sum(logs) / len(logs)


def test_perplexity_is_kneser_neys(spark):
    train = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "日本 the"]
    asked = ["the cat", "", "zzz 9", "DOG and cat", "the cat sat on the mat " * 40]
    counts = kneser_ney.count_grams(spark.createDataFrame([("en", t) for t in train], "lang string, text string"))
    known, contexts = kneser_ney.model(counts)
    docs = spark.createDataFrame([(i, i, "en", t) for i, t in enumerate(asked)] + [(9, 9, "xx", "the")], "id bigint, row_hash bigint, lang string, text string")
    got = {r.id: r for r in kneser_ney.perplexities(docs, known, contexts).collect()}
    for i, t in enumerate(asked):
        assert got[i].n == len(t) + 1 and got[i].surprise == pytest.approx(brute_surprise(train, t), rel=1e-9)
    assert got[9].surprise == pytest.approx(np.log(kneser_ney.SYMBOLS))
    # What is looked up in memory changes no result.
    for most in (0, 12):
        again = {r.id: r for r in kneser_ney.perplexities(docs, known, contexts, most).collect()}
        assert all(again[i].surprise == pytest.approx(got[i].surprise, rel=1e-9) for i in got)


def test_frequent_table_finds_what_it_holds():
    keys = np.arange(5000, dtype=np.int64) * 4099
    table = kneser_ney.Frequent(["en", "de"], (np.arange(5000) % 2).astype(np.int32), keys, keys / 7.0)
    hit, lp = table.find("de", keys)
    assert np.array_equal(hit, np.arange(5000) % 2 == 1) and np.array_equal(lp[hit], keys[hit] / 7.0) and not lp[~hit].any()
    assert not table.find("fr", keys)[0].any()


def test_quality_keeps_good_text(spark, taught):
    docs, labels = taught
    scored = quality.score_quality(docs, labels)
    seen = scored.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    share = dict(map(tuple, seen))
    assert share[1] > 0.97 and share[0] < 0.3
    mixed = odd(spark)
    kept = quality.score_quality(mixed, labels)
    assert kept.count() == mixed.count() and kept.filter("perplexity IS NULL OR keep IS NULL").count() == 0
    assert quality.keep_good(mixed, labels).columns == mixed.columns
    assert quality.score_quality(mixed.limit(0), labels.limit(0)).count() == 0
    assert quality.score_quality(mixed, labels.limit(0)).filter("NOT keep").count() == 0


def test_every_length_and_language_has_a_limit(spark):
    trusted = [(i, "the cat sat on the mat and the dog ran to the old house by the sea "[: 40 + i % 20] * 3, "en") for i in range(120)]
    junk = "zq&&% xv### "
    asked = [(1000, "zqx", "en"), (1001, junk * 3000, "en"), (1002, junk * 30, "en"), (1003, junk * 20, "xx"), (1004, junk * 20, None), (1005, trusted[0][1], "xx"), (1006, trusted[0][1], None)]
    df = spark.createDataFrame(trusted + asked, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(t[0], 1) for t in trusted], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score_quality(df, labels).collect()}
    assert len(got) == len(trusted) + len(asked) and all(r.limit is not None for r in got.values())
    assert [got[i].keep for i in range(1000, 1007)] == [False] * 5 + [True] * 2
    assert got[1003].lang == "xx" and got[1004].lang == ""
    few = quality.score_quality(df, labels.filter("doc_id = 1")).collect()  # held back or taught, not both
    assert len(few) == len(got) and all(r.limit is not None for r in few)
    limits = spark.createDataFrame([("en", 5, 1.0), ("en", 9, 2.0)], "lang string, class int, limit double")
    classes = spark.createDataFrame([(x, c) for x in ("en", "xx") for c in range(3, 12)], "lang string, class int")
    assert rows_of(quality.nearest_limits(classes, limits), "lang", "class", "limit") == [("en", c, 1.0 if c < 7 else 2.0) for c in range(3, 12)]


def test_toxicity_separates_and_restores(spark, taught):
    docs, labels = taught
    own = [(10_000 + i, f"the of and {w} in on to {i}") for i, w in enumerate(["1d10t", "i d i o t", "idiiiiot", "m0r0n", "$tupid", "the", "cl0wn!!", "i.d.i.o.t", "tr@sh"])]
    extra = spark.createDataFrame(own + [(20_000, None), (20_001, ""), (20_002, "a " * 30_000)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(extra).withColumn("predicted", F.lit("clash"))
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5
    scored = toxicity.score_toxicity(both, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in scored.collect()}
    assert [got[10_000 + i] for i in range(len(own))] == [1, 1, 1, 1, 1, 0, 1, 1, 1]
    assert got[20_000] == got[20_001] == got[20_002] == 0
    true = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([got[i] == y for i, y in true.items() if i in got]) > 0.9
    scores = toxicity.score_toxicity(docs, labels, fold != 0)
    assert scores.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scores.count() == docs.count()
    assert toxicity.score_toxicity(odd(spark).limit(0), labels, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(odd(spark), labels.limit(0), F.lit(True)).filter("predicted = 1").count() == 0


def test_disguises_reach_the_lattice(spark, docs):
    more = spark.createDataFrame([("loser idiot stupid moron fool clown trash " * 400,)], "text string")
    restorer = toxicity.Restorer(toxicity.letter_model(toxicity.trigram_counts(docs.select("text").union(more), "text")))
    few = ["1053r", "1d107", "!d!0+"]  # fewer than two letters
    runs = ["l" + 70 * "o" + "ser", "l" + 70 * "0" + "ser", "i-d-i-o-t-" * 30]
    apart = ["i--d--i--o--t", "1-d-1-0-t", "i***d***i***o***t", "you-1d10t"]
    doubled = ["idioot", "stuupid", "$tupid!"]
    for tokens, wanted in ((few, ["loser", "idiot", "idiot"]), (runs, ["loser", "loser", "idiot"]), (apart, ["idiot"] * 4), (doubled, ["idiot", "stupid", "stupid"])):
        for t, w in zip(tokens, wanted):
            assert w in restorer.words(f"the {t} of"), t
    assert restorer.token("house") == ("house",) and restorer.token("...") == ()
    assert restorer.words("x" * 5000 + " " + "7" * 5000).total() < 20


def test_nearest_asks_once_and_finds_k(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 8)) + 30 * np.repeat(np.eye(8)[:6], [595, 1, 1, 1, 1, 1], axis=0)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(0, v[0].tolist())] * 2 + [(597, v[597].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id").isin(0, 100, 597), k=10).toPandas()
    for q in (0, 100, 597):
        mine = got[got.query_id == q]
        assert len(mine) == 10 and q not in set(mine.vec_id)
        assert (mine.vec_id.value_counts() <= [3 if i == 0 else 2 if i == 597 else 1 for i in mine.vec_id.value_counts().index]).all()  # repeated rows are candidates of other queries
    # More neighbours than the visited parts hold.
    every = ann.nearest(df, F.col("vec_id") == 597, k=590).toPandas()
    assert len(every) == 590 and sorted(every["rank"]) == list(range(1, 591))


def test_one_id_on_two_texts_loses_no_group(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (9, a), (3, b), (5, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert rows_of(corpus_pipeline.keep_one_of_each(spark, df, ""), "doc_id", "text") == [(3, b), (5, a)]


def test_pages_lose_no_text_and_may_be_long():
    text = html_mincut.main_text
    assert text("<body><p>Short.</p></body>") == "Short." and text("<body>One</body>") == "One" and text("<nav>One</nav>") == ""
    assert text("<p>Let <math>x</math> be a number <svg><title>icon</title><text>y</text></svg> of some kind</p>") == "Let x be a number y of some kind"
    deep = text("<body>" + "".join(f"<div>text of level {i} and some more words" for i in range(5000)) + "</div>" * 5000)
    assert deep.count("\n") == 4999
    long = "".join(f"<p>plain words of an article that goes on {i}</p><ul><li><a href=x>link {i}</a></li></ul>" for i in range(10_000))
    start = time.time()
    assert text(f"<body>{long}</body>") == "\n".join(f"plain words of an article that goes on {i}" for i in range(10_000))
    assert time.time() - start < 30
