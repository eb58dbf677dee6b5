"""The queries opN_<name> over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, jaccard, licenses, mixing, mpegaudio, quality, tokencount, tokenfiles, toxicity, urlfilter
from tidewake.llm.tables import table
from tidewake.llm.workspace import Workspace


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows' labels are unknown here; their texts stay among the unlabelled ones that are scored, not fitted on."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    featured = Workspace(spark, "quality").save(quality.feature_table(table(spark, sf_dir, "documents"), ("doc_id",)), "features")
    labels = learned_rows(table(spark, sf_dir, "labels"), 4, 2)
    net, _ = quality.fit(featured.filter(~held), labels.filter("quality = 1"))
    scored = quality.score_table(featured, net, ("doc_id",))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column is stored and read again before its digests are made."""
    media = Workspace(spark, "media").save(mpegaudio.encode_column(table(spark, sf_dir, "documents")), "media")
    return mpegaudio.digest_column(media)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("rounds")).cast("long").alias("taken"))


OP9_SQL = """
WITH slim AS (
  SELECT doc_id AS key, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix/' || CAST(doc_id AS VARCHAR)) AS dice FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM slim GROUP BY source),
capped AS (SELECT *, CAST(r % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM sources),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_level FROM capped),
targets AS (SELECT source, source_size, least(cap, weight * (SELECT own_level FROM leveled WHERE own_level * weight <= cap ORDER BY cap / weight, r LIMIT 1)) AS target,
  CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM leveled),
placed AS (SELECT s.*, t.source_size, t.target, t.budget,
  sum(size) OVER (PARTITION BY s.source ORDER BY dice, key, size ROWS UNBOUNDED PRECEDING) AS tokens
  FROM slim s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rounds AS (SELECT p.*, (tokens + i * source_size) / target AS due, i FROM placed p, (SELECT unnest([0, 1, 2]) AS i) WHERE size > 0 AND target > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY due, source NULLS LAST, dice, key, size ROWS UNBOUNDED PRECEDING) AS used FROM rounds),
taken AS (SELECT key, source, count(*) AS n FROM summed WHERE used <= budget GROUP BY ALL)
SELECT p.key AS doc_id, p.source, p.size, p.source_size, p.target, CAST(p.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken t ON p.key = t.key AND p.source IS NOT DISTINCT FROM t.source
"""

def learned_rows(labels: DataFrame, parts: int, held: int) -> DataFrame:
    """The labels that may be learnt from: those of rows that are not held out."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != held)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, learned_rows(table(spark, sf_dir, "labels"), 3, 1))
    scored = toxicity.score_texts(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP5_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) AS t(verdict, rule, name, start)),
hits AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict FROM parts p LEFT JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict FROM hits GROUP BY page_id, host, path
"""

OP6_SQL = """
WITH templates AS (SELECT * FROM (VALUES %s) AS t(tid, license, long, grams)),
template_grams AS (SELECT tid, unnest(grams) AS gram FROM templates),
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text <> ''),
texts AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words WHERE len(w) > 1),
places AS (SELECT doc_id, unnest(range(0, len(g))) AS pos, unnest(g) AS gram FROM texts),
starts AS (SELECT doc_id, pos, tid FROM places JOIN template_grams USING (gram)),
windows AS (SELECT s.doc_id, license, pos, long, grams, len(g) AS total, list_distinct(g[pos + 1:pos + long - 1]) AS own FROM starts s JOIN texts USING (doc_id) JOIN templates USING (tid)),
scored AS (SELECT doc_id, license, pos, least(long, total + 1 - pos) AS n_words, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM windows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, pos, n_words DESC) AS r FROM scored WHERE dice >= 0.8)
SELECT doc_id, license, round(dice, 6) AS dice, CAST(pos AS BIGINT) AS first_word, CAST(n_words AS BIGINT) AS n_words FROM ranked WHERE r = 1
""" % ", ".join("(%d, '%s', %d, [%s])" % (i, name, len(licenses.template_words(text)), ", ".join(f"'{g}'" for g in licenses.template_bigrams(text))) for i, (name, text) in enumerate(licenses.TEMPLATES))

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_token_files": op7_token_files,
    "op8_media_column": op8_media_column,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {"op5_url_filter": OP5_SQL, "op6_license_scan": OP6_SQL, "op9_mix_sources": OP9_SQL}
