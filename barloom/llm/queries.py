"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import ann, binary_codes, chat, html_mincut, jaccard_join, merkle, mixing, packing, quality, repeats, spelling, token_counts, toxicity
from barloom.llm.common import table

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", "limit", "keep")


@query
def op2_embedding_near_dedup(spark, sf_dir):
    return binary_codes.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(coalesce(low.b, e.vec_id), e.vec_id) AS component_id,
  e.vec_id = least(coalesce(low.b, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT i.a, i.b FROM inter i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 90 * (x.n + y.n - i.k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
sets AS (SELECT list_sort(s) AS s, count(*) AS c FROM s WHERE len(s) > 0 GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(coalesce(low.b, s.doc_id), s.doc_id) AS component_id, coalesce(sets.c, 1) AS n_copies
FROM s LEFT JOIN low ON low.a = s.doc_id LEFT JOIN sets ON sets.s = list_sort(s.s)
"""


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_chat_formatting(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mark = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], given.schema)
    rows = given.unionByName(own)
    # The table as a log: each row is a message that was streamed, thrown away and generated anew, went wrong in the middle and was edited there.
    # Equal rows stay messages of their own.
    row = rows.select("conv_id", F.struct("turn", "role", "text", F.monotonically_increasing_id().alias("row")).alias("turn"), "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    steps = [("delta", rest), ("delta", F.lit("a draft")), ("regenerate", F.lit(None).cast("string")), ("delta", first), ("delta", F.lit("a slip")), ("edit", first), ("delta", rest)]
    events = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for i, (kind, text) in enumerate(steps)])
    log = row.select("conv_id", "turn", "role", F.explode(events).alias("e")).select("conv_id", "turn", "role", "e.seq", "e.kind", "e.text")
    messages = chat.fold_events(log).select("conv_id", F.col("turn.turn").alias("turn"), "role", "text")
    made = chat.format_conversations(messages)
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("spans"))
    made = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op5_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^~<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^~<\[|]', '', 'g')) + 13 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op6_html_extraction(spark, sf_dir):
    return html_mincut.extract(table(spark, sf_dir, "pages"))


@query
def op7_source_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL["op7_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, first_value(CASE WHEN rest / open * weight < cap THEN rest / open END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l),
c AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class,
  ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % 64 AS salt FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS LAST) AS i FROM c),
q AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
  ('0x' || substr(md5('mix|' || coalesce(p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * size AS taken FROM q
"""


@query
def op8_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


@query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def digest(text):
        return merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    shouted = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), digest(F.when(tampered, shouted).otherwise(F.col("text"))).alias("seen"))
    made = merkle.manifest(leaves, leaf="leaf", tree="lang", order="doc_id")
    made = made.withColumn("proof_sha256", merkle.proof_digest(F.col("path"))).withColumn("folded_root", merkle.fold(F.col("seen"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE tab(b, k, v) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8),
crc(doc_id, i, c) AS (SELECT DISTINCT doc_id, 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, xor(v, c >> 8) FROM crc, tab WHERE k = 8 AND i < strlen(CAST(doc_id AS VARCHAR)) AND b = xor(c, ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1))) & 255),
bad AS (SELECT doc_id FROM crc WHERE i = strlen(CAST(doc_id AS VARCHAR)) AND xor(c, 4294967295) % 3 = 0),
t AS (SELECT d.*, CASE WHEN b.doc_id IS NULL THEN text ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS other FROM documents d LEFT JOIN bad b ON d.doc_id = b.doc_id),
f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM t),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS seen FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
up(lang, lev, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, lev + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, lev, pos // 8),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over(lev, pos, n, h) AS (SELECT 0, pos, n, h FROM subroots
  UNION ALL SELECT lev + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lev, pos // 8),
kids AS (SELECT lang, lev, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT lev, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM over WHERE n > 1 GROUP BY ALL),
go(id, lang, lev, pos, said, seen) AS (SELECT row_number() OVER (ORDER BY lang, pos), lang, 0, pos, '', seen FROM leaves
  UNION ALL SELECT id, g.lang, g.lev + 1, g.pos // 8, said || array_to_string(hs[:g.pos % 8], '') || array_to_string(hs[g.pos % 8 + 2:], ''),
    sha256(array_to_string(hs[:g.pos % 8], '') || seen || array_to_string(hs[g.pos % 8 + 2:], '')) FROM go g JOIN kids k ON k.lang IS NOT DISTINCT FROM g.lang AND k.lev = g.lev AND k.parent = g.pos // 8),
mid AS (SELECT g.id, s.pos, g.said, g.seen, s.h AS subroot FROM (SELECT * FROM go QUALIFY lev = max(lev) OVER (PARTITION BY id)) g JOIN subroots s ON s.lang IS NOT DISTINCT FROM g.lang),
rise(id, lev, pos, said, seen) AS (SELECT id, 0, pos, said, seen FROM mid
  UNION ALL SELECT id, r.lev + 1, r.pos // 8, said || array_to_string(hs[:r.pos % 8], '') || array_to_string(hs[r.pos % 8 + 2:], ''),
    sha256(array_to_string(hs[:r.pos % 8], '') || seen || array_to_string(hs[r.pos % 8 + 2:], '')) FROM rise r JOIN tops k ON k.lev = r.lev AND k.parent = r.pos // 8),
final AS (SELECT * FROM rise QUALIFY lev = max(lev) OVER (PARTITION BY id)),
named AS (SELECT *, row_number() OVER (ORDER BY lang, pos) AS id FROM leaves)
SELECT n.doc_id, n.leaf, m.subroot, o.h AS root, sha256(f.said) AS proof_sha256, f.seen AS folded_root, f.seen = o.h AS verified
FROM named n JOIN mid m ON m.id = n.id JOIN final f ON f.id = n.id JOIN over o ON o.n = 1
"""


@query
def op11_spelling_variants(spark, sf_dir):
    words = spelling.word_counts(table(spark, sf_dir, "documents"), shortest=5, least=3)
    return spelling.variants(words, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE tab(b, k, v) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE k < 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs GROUP BY doc_id, run),
ids AS (SELECT *, row_number() OVER () AS id FROM c),
crc(id, x, i, h) AS (SELECT id, x, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT id, x, i + 2, xor(v, h >> 8) FROM crc, tab WHERE k = 8 AND i < length(x) AND b = xor(h, ('0x' || substr(x, i + 1, 2))::BIGINT) & 255),
h AS (SELECT id, xor(h, 4294967295) AS h FROM crc WHERE i = length(x)),
noisy AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM ids JOIN h USING (id)),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word AS word, b.word AS other FROM del a JOIN del b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM del d JOIN w ON d.v = w.word UNION SELECT w.word, d.word FROM del d JOIN w ON d.v = w.word),
best AS (SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, o.n AS m FROM near JOIN w o ON o.word = near.other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
walk(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f l ON l.word = walk.tip WHERE l.form IS NULL
"""


@query
def op12_substring_dedup(spark, sf_dir):
    cut = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_substring_dedup"] = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT row, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
bad AS (SELECT row, list(DISTINCT i + k) AS gone FROM (SELECT row, i, unnest(range(0, 13)) AS k FROM g JOIN first USING (g) WHERE doc_id > low) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN bad USING (row)
"""
