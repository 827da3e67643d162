"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import jaccard_join, mixing, packing, quality, toxicity
from barloom.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the perplexity classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not predicted toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5
    scored = toxicity.score_toxicity(docs, labels, fold != 0)
    return scored.filter("predicted = 0").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five words, similarity 0.8 or more.

    A row without doc_id or words is a group of its own; of equal rows one stays.
    """
    # An id may be on rows of different texts: a row goes by its id and its text, not by its id alone.
    groups = jaccard_join.jaccard_groups(docs, width=5, percent=80, row_hash="_hash")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), "_hash").distinct()
    mine = docs.withColumn("_text", F.xxhash64("text"))
    left = mine.join(gone, (mine["doc_id"] == gone["_gone"]) & (mine["_text"] == gone["_hash"]), "left_anti").drop("_text")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    return left.withColumn("_row", F.row_number().over(same)).filter("_row = 1 OR doc_id IS NULL OR text IS NULL").drop("_row")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_copies(mixing.mix_sources(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing", mix),
    ("best-fit packing", pack),
]

# The quality, toxicity and packing stages need models and a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
