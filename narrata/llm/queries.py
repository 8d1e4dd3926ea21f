"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import decontam, embedding_forest, filter_audit, html_extract, mixing, ngram_join, passages, quality, secrets, sharding, spelling, token_files, toxicity
from narrata.llm.scratch import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"), ngram_join.Rule(size=4, num=85, den=100))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).drop("text", "found")


def op3_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.ring_shards(docs, shards=16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def tokenizer_path() -> str:
    """The public byte-level BPE; its file is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(key: str = "doc_id") -> Column:
    """Rows whose label no model may learn from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.pareto_mix(docs.withColumn("weight", mixing.shorter_first(F.col("size"))), weight="weight").select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), slip=31)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def unseen(key: str = "doc_id") -> Column:
    """Rows whose toxicity label no model may learn from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~unseen())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", unseen().alias("held_out"), "score", "predicted")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM d GROUP BY source
), w AS (
  SELECT *, CASE position % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, position),
    b AS (ORDER BY source_size / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= 2.0::DOUBLE * source_size) * weight,
      2.0::DOUBLE * source_size)) AS target
  FROM l
), r AS (
  SELECT d.*, (1000000 // (1000 + size))::DOUBLE AS weight, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, least(greatest((ratio - floor(ratio)) * weight / (sum(weight * size) OVER (PARTITION BY source) / nullif(source_size, 0)), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS chance, target - floor(ratio) * source_size AS rest FROM r
), q AS (
  SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS odds FROM p
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
)
SELECT doc_id, size, source_size, target,
  ((floor(ratio) + CASE WHEN size > 0 AND rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

# Links are pairs that share a shingle; the closure of the links gives the smallest document within reach.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda k: list_aggregate(words[k:k + 3], 'string_agg', ' ')))) AS shingle FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), r AS (
  SELECT DISTINCT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
  SELECT node, min(reached) AS component FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), g AS (
  SELECT vec_id, x FROM v WHERE len(x) > 0 AND list_bool_and(list_transform(x, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(x, lambda c: c <> 0))
), l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95
), r AS (
  SELECT DISTINCT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
  SELECT node, min(reached) AS component FROM r GROUP BY node
), d AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(component, v.vec_id) AS component_id, coalesce(component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN d ON d.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id
"""

# Every order of the five filters, against the 32 sets of filters that a text can fail.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), r AS (
  SELECT d.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, min(d.doc_id) OVER (PARTITION BY text) AS smallest FROM d LEFT JOIN m ON m.doc_id = d.doc_id
), f AS (
  SELECT part, good, toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > smallest, false)::INT AS bits
  FROM r
), g AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, bits
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS seq
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, seq FROM o
), t AS (
  SELECT filter_order, step, seq[step] AS bit, coalesce(list_sum(seq[1:step - 1]), 0)::INT AS before FROM s
), x AS (
  SELECT g.*, t.*, (bits & bit) <> 0 AS fails, (bits & before) <> 0 AS gone FROM g, t
), y AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
    sum(n) FILTER (bits = bit) AS unique_fails, sum(n_good) FILTER (fails AND NOT gone) AS good_lost, sum(n_toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM y
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_secrets": op2_secrets,
    "op3_embedding_forest": op3_embedding_forest,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_html_extraction": op9_html_extraction,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}

SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op3_embedding_forest": OP3_SQL, "op8_mixing": OP8_SQL, "op12_filter_audit": OP12_SQL}
