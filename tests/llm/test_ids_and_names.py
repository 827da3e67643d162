"""Large ids beside null ones and columns with names the operators use themselves pass through unchanged."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import html_mincut, jaccard_join, mixing, packing, quality, toxicity

BIG = 2**53 + 1
NAMES = ["_text", "_html", "_class", "_salt", "_row", "_hash", "_id", "size", "row", "id", "hash", "mine", "made", "score", "node", "at", "text_hash"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, "one two three four five six", "en", "s"), (None, "seven eight nine ten", "en", "s"), (BIG + 2, None, None, None), (BIG, "one two three four five six", "en", "s")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1)
    return made.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


IDS = sorted([BIG, BIG, BIG + 2, 0])


def ids(df):
    return sorted(r.doc_id or 0 for r in df.select("doc_id").collect())


def own_names_kept(df, but=()):
    row = df.first()
    assert all(row[c] == f"own {c}" for c in NAMES if c in df.columns and c not in but)
    assert set(NAMES) - set(but) <= set(df.columns)


def test_quality(docs, labels):
    nothing = labels.limit(0).select("doc_id", "quality")
    kept = quality.keep_good(docs, nothing)
    assert ids(kept) == IDS and kept.columns == docs.columns
    own_names_kept(kept)
    assert ids(quality.score_quality(docs, labels.select("doc_id", "quality"))) == IDS


def test_toxicity(docs, labels):
    scored = toxicity.score_toxicity(docs, labels.select("doc_id", "toxic"), F.lit(True))
    assert ids(scored) == IDS
    own_names_kept(scored, but=["score"])


def test_html(docs):
    made = html_mincut.extract(docs.withColumn("html", F.lit("<p>x</p>")))
    assert ids(made) == IDS
    own_names_kept(made)


def test_jaccard(docs):
    groups = jaccard_join.jaccard_groups(docs)
    assert ids(groups) == IDS
    assert sorted(r.component_id or 0 for r in groups.collect()) == IDS


def test_mixing(docs):
    mixed = mixing.mix_sources(docs)
    assert ids(mixed) == IDS
    own_names_kept(mixed, but=["size"])


def test_packing(docs):
    assert ids(packing.pack_documents(docs)) == IDS
