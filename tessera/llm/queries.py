"""The thin queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pieces, conversation, divergence, embeddings, exact_dedup, language_id, license_scan, lm_score, mixing, pieces, simhash, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(n: int) -> Column:
    """The remainder that splits documents into folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(4) == 2
    found = language_id.identify(docs, docs.filter(~held_out).select("text", "lang"))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = "crc32(cast(cast(doc_id AS string) AS binary)) % 7"
    found = lm_score.score_documents(docs, f"coalesce({crc}, 0) <> 2", f"{crc} = 6")
    held_out = F.coalesce(bucket(7) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(3) == 1
    judge = toxicity.learn(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    found = toxicity.score_documents(docs, judge)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.encode_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name.removeprefix("SQL_"): sql for name, sql in globals().items() if name.startswith("SQL_")}


SQL_op4_exact_dedup = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) = 1 AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
WINDOW same AS (PARTITION BY sha)
"""

SQL_op3_url_filter = """
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule
  FROM (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
  )
)
"""

SQL_op11_source_divergence = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.total, count(*) OVER of_group AS v, sum(coalesce(n.n, 0)) OVER of_group AS words, sum(k.total) OVER of_group AS lang_words
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  WINDOW of_group AS (PARTITION BY g.lang, g.source)
), p AS (
  SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (words + 5 * v) AS BIGINT) AS p, 1 + CAST((1000000000::HUGEINT * (total + 5)) // (lang_words + 5 * v) AS BIGINT) AS q FROM grid
), pair AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value
  FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = o.lang AND b.source = o.source AND b.term = a.term GROUP BY ALL
), every AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

# The conversations' edits one turn at a time, with whole strings: of each role retained last the least (cost, audit).
SQL_op13_conversation_repair = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM src
), dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0
), bare AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM dam),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM bare
), seen AS (
  SELECT *, role[1:1] AS c, lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS after, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed
), o AS (
  SELECT *, CASE WHEN b = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM seen
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND c || after NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id
), step AS (
  SELECT conv_id, 0::BIGINT AS i, [{'cost': 0::BIGINT, 'audit': '', 'r': 0, 'done': ''}] AS ways FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, list_filter(list_transform([0, 1, 2, 3], lambda q: list_min(list_filter(found, lambda x: x.r = q))), lambda x: x IS NOT NULL) FROM (
    SELECT conv_id, i, list_concat(
      list_transform(w, lambda x: {'cost': x.cost + 3, 'audit': x.audit || 'D', 'r': x.r, 'done': x.done}),
      list_transform(list_filter(w, lambda x: stays AND ((c = 's' AND x.r = 0) OR (c = 'u' AND x.r <> 2) OR (c = 'a' AND x.r = 2))), lambda x: {'cost': x.cost + late, 'audit': x.audit || 'K', 'r': CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'done': x.done || chr(10) || role || ':' || text}),
      list_transform(list_filter(w, lambda x: stays), lambda x: {'cost': x.cost + 2 + late, 'audit': x.audit || 'R', 'r': CASE x.r WHEN 2 THEN 3 ELSE 2 END, 'done': x.done || chr(10) || CASE x.r WHEN 2 THEN 'assistant:' ELSE 'user:' END || text})
    ) AS found FROM (
      SELECT o.conv_id, o.i, o.c, o.role, o.text, o.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN o.fault = 'truncated' THEN 1 ELSE 0 END AS late,
        list_concat(step.ways, list_transform(step.ways, lambda x: {'cost': x.cost + 2, 'audit': x.audit || 'I', 'r': CASE x.r WHEN 2 THEN 3 ELSE 2 END, 'done': x.done || chr(10) || CASE x.r WHEN 2 THEN 'assistant:' ELSE 'user:' END})) AS w
      FROM step JOIN o ON o.conv_id IS NOT DISTINCT FROM step.conv_id AND o.i = step.i + 1
    )
  )
), closed AS (
  SELECT conv_id, i, list_min(list_transform(ways, lambda x: {'cost': x.cost + CASE x.r WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': x.audit || CASE x.r WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'done': x.done || CASE x.r WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END})) AS best FROM step
)
SELECT k.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  k.best.cost AS cost, k.best.audit AS audit, sha256(substr(k.best.done, 2)) AS repaired_sha256
FROM closed k LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM k.conv_id WHERE k.i = coalesce(f.n, 0)
"""
