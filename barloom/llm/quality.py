"""Quality classifier: perplexity under trusted text against quantiles of the document's language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import release, small_batches, stored, with_ids
from barloom.llm.kneser_ney import count_grams, model, perplexities

QUANTILE = 0.99
STEP = 0.005  # nats per character: quantiles are exact up to this
FOLDS = 5
_FEW = 50  # trusted documents a class needs for a quantile of its own
_ALL = "\uffff"  # stands for all languages together


def _row_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _length_class(n):
    return F.floor(F.log2(n.cast("double"))).cast("int")


def thresholds(trusted: DataFrame, quantile: float) -> DataFrame:
    """(lang, class, limit) from trusted (lang, class, surprise): the language's quantile in each length class.

    Short texts scatter more, so every doubling of the length has its own; a class of few documents
    joins the next longer ones; ``nearest_limits`` serves the classes between and beyond. Counts of rounded values stand for the documents.
    """
    bins = trusted.groupBy("lang", "class", F.ceil(F.col("surprise") / STEP).alias("bin")).agg(F.count("*").alias("c"))
    # Classes with few documents are joined downwards from the longest.
    size = bins.groupBy("lang", "class").agg(F.sum("c").alias("size"))
    longer = Window.partitionBy("lang").orderBy(F.desc("class"))
    size = size.withColumn("group", F.floor(F.sum("size").over(longer.rowsBetween(Window.unboundedPreceding, -1)) / _FEW))
    size = size.withColumn("group", F.coalesce("group", F.lit(0)))
    both = bins.join(size.select("lang", "class", "group"), ["lang", "class"]).groupBy("lang", "group", "bin").agg(F.sum("c").alias("c"))
    run = Window.partitionBy("lang", "group").orderBy("bin")
    both = both.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy("lang", "group")))
    limit = both.filter(F.col("upto") >= F.col("all") * quantile).groupBy("lang", "group").agg((F.min("bin") * STEP).alias("limit"))
    return size.join(limit, ["lang", "group"]).select("lang", "class", "limit")


def nearest_limits(asked: DataFrame, limits: DataFrame) -> DataFrame:
    """(lang, class, limit) for every (lang, class) of ``asked`` whose language has a limit: that of the nearest class.

    Longer texts than any trusted one take the longest class's limit, shorter ones the shortest's, those between two the nearer's,
    and the longer's where both are as near. Rows are classes, not documents.
    """
    every = asked.select("lang", "class").distinct().join(limits, ["lang", "class"], "full")
    at = F.when(F.col("limit").isNotNull(), F.struct("class", "limit"))
    below = F.last(at, ignorenulls=True).over(Window.partitionBy("lang").orderBy("class"))
    above = F.last(at, ignorenulls=True).over(Window.partitionBy("lang").orderBy(F.desc("class")))
    every = every.select("lang", "class", below.alias("below"), above.alias("above"))
    lower = F.col("above").isNull() | (F.col("class") - F.col("below.class") < F.col("above.class") - F.col("class"))
    return every.select("lang", "class", F.when(lower, F.col("below.limit")).otherwise(F.col("above.limit")).alias("limit")).filter("limit IS NOT NULL")


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, row_hash, lang, n, perplexity, limit, keep) for each row of ``docs``.

    Trusted text is that of documents labelled (id, quality) 1. A hash holds one in ``FOLDS`` of them back: the
    model is counted on the others and the quantiles are taken on those held back, as a model
    flatters the texts it has counted. A document stays if its perplexity per character
    is at most its language's quantile among trusted documents of its length, or of the nearest length that has them. A null or empty text is one end
    mark; a null language is a language of its own. A language without trusted documents of both kinds is judged by
    the model and the quantiles of all trusted text together; only if no text is trusted is there no limit, and all stay. If the hash
    holds none back, or all, the same documents serve for both. Ids may repeat or be null: ``row_hash``, a hash of the text, tells rows apart, and equal rows
    get equal results. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), _row_hash(text).alias("row_hash"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    good = labels.filter("quality = 1").select(F.col(id_column).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    back = F.pmod(F.xxhash64("id", F.lit("held back")), F.lit(FOLDS)) == 0
    here = stored(with_ids(rows.select("id", "lang"), "id", good).join(good, "id", "left_semi").select("id", "lang", back.alias("back")))
    kinds = here.groupBy("lang").agg(F.max("back").alias("held"), F.min("back").alias("all")).collect()  # a row per language
    whole = [r.lang for r in kinds if r.held and not r.all]
    held, taught = here.filter("back").select("id").distinct(), here.filter("NOT back").select("id").distinct()
    if not any(r.held for r in kinds):
        held = taught
    elif all(r.all for r in kinds):
        taught = held
    counts = stored(count_grams(with_ids(rows, "id", taught).join(taught, "id", "left_semi").select("lang", "text")))
    rows = rows.select("id", "row_hash", F.when(F.col("lang").isin(whole), F.col("lang")).otherwise(F.lit(_ALL)).alias("lang"), F.col("lang").alias("said"), "text")
    if rows.filter(F.col("lang") == _ALL).limit(1).count():
        counts = stored(counts.filter(F.col("lang").isin(whole)).unionByName(counts.groupBy("gram").agg(F.sum("c").alias("c")).withColumn("lang", F.lit(_ALL))))
        # Trusted rows of other languages are scored once more, for the quantiles of all languages.
        again = with_ids(rows.filter(F.col("lang") != _ALL), "id", held).join(held, "id", "left_semi")
        rows = rows.unionByName(again.select("id", "row_hash", F.lit(_ALL).alias("lang"), F.lit(None).cast("string").alias("said"), "text"))
    release(docs.sparkSession)  # many small jobs: their plans and shuffles go before more come
    known, contexts = model(counts)
    release(docs.sparkSession)
    scored = stored(perplexities(rows, known, contexts)).withColumn("class", _length_class(F.col("n")))
    limits = nearest_limits(scored, thresholds(scored.join(held, "id", "left_semi"), quantile))
    joined = scored.filter("said IS NOT NULL").join(limits, ["lang", "class"], "left")
    return joined.select(
        F.col("id").alias(id_column), "row_hash", F.col("said").alias("lang"), "n", F.exp("surprise").alias("perplexity"), F.exp("limit").alias("limit"), F.coalesce(F.col("surprise") <= F.col("limit"), F.lit(True)).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with their columns as they were."""
    scored = score_quality(docs, labels, id_column, text, lang, quantile)
    good = scored.filter("keep").select(F.col(id_column).alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).cast("long").alias("mine"), _row_hash(text).alias("hash"))
    return mine.join(good, F.col("mine").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi").select("row.*")
