"""The contract's queries over the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    return pii.digest(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import packing

    pieces = packing.packed(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_count

    return token_count.counted(read(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_store

    folder = token_store.new_folder(spark)
    token_store.write(read(spark, sf_dir, "documents"), folder)
    back = token_store.read(spark, folder)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import text_near

    return text_near.classes(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), training=~held_out())
    rows = toxicity.scored(docs, model, ["doc_id"]).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.select("doc_id", "held_out", F.col("_score").alias("score"), F.when(F.col("_score") >= 0.7, 1).otherwise(0).alias("predicted"))


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op7_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import vector_near

    return vector_near.near(read(spark, sf_dir, "embeddings"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import topk

    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import licenses

    return licenses.scanned(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import mixing

    return mixing.decided(read(spark, sf_dir, "documents"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import impact

    return impact.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    rows = quality.judged(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import divergence

    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), good AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN roots ON roots.x = v.vec_id LEFT JOIN counts ON counts.x = v.vec_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP11_SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, row_number() OVER () AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), terms AS (
  SELECT doc_id, doc, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_docs
), tf AS (SELECT doc_id, doc, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc, sum(tf)::BIGINT AS n FROM tf GROUP BY doc),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, doc,
    sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc), corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
tf AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM (SELECT lang, source, doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM tf GROUP BY ALL HAVING sum(df) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(tf.n) AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS count, (1 + (1000000000::HUGEINT * (coalesce(t.n, 0) + 1)) // (coalesce(o.n, 0) + s.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + s.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN tf t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE count > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_embedding_near": OP7_SQL, "op8_topk": OP8_SQL, "op11_impact_search": OP11_SQL, "op13_divergence": OP13_SQL}
