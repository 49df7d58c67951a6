"""Text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, sanitize_query, shown_timestamp, slug, speaker_name
from tessera.functions.vectors import truncate_renormalize
from tessera.operators import fusion, search
from tessera.operators.text_index import WrittenIndex
from tessera.operators.vector_index import VectorIndex
from tessera.stages import Stages

from .base import ASKED, GRAPH, episodes, graph_tables, register, table, text_queries, vector_queries, vectors

REGISTRY: dict = {}

_TOP = """
SELECT query_id, uuid, round(similarity, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uuid) AS rank FROM (
    SELECT 'q' || q.vec_id AS query_id, 'v' || e.vec_id AS uuid, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= {n}
"""


@register(REGISTRY, _TOP.format(n=20))
def vector_topk_cosine(spark, d):
    found = search.vector_search(vectors(spark, d), "summary_embedding", vector_queries(spark, d), 20)
    return found.select("query_id", "uuid", "similarity", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, _TOP.format(n=10))
def vector_topk_batched(spark, d):
    found = search.vector_search(vectors(spark, d), "summary_embedding", vector_queries(spark, d), 10)
    return found.select("query_id", "uuid", "similarity", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, _TOP.format(n=20))
def vector_topk_pruned(spark, d):
    """As ``vector_topk_cosine``, from a written index whose cells are compared only where their bound reaches the threshold."""
    index = VectorIndex(spark, Stages(spark, "vectors").folder, 16).create(vectors(spark, d), "summary_embedding")
    found = index.search(vector_queries(spark, d), 20)
    return found.select("query_id", "uuid", "similarity", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, """
SELECT vec_id, round(list_sum(list_transform(h, lambda x: x / n)), 6) AS component_sum, round(h[1] / n, 6) AS first_component
FROM (SELECT vec_id, h, greatest(sqrt(list_sum(list_transform(h, lambda x: x * x))), 1e-12) AS n FROM (SELECT vec_id, (embedding::DOUBLE[])[1:16] AS h FROM embeddings))
""")
def embedding_truncate_renorm(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", truncate_renormalize(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("component_sum"), F.round(F.col("v")[0], 6).alias("first_component"))


_BM25 = GRAPH.rstrip() + """, q AS (
  SELECT DISTINCT group_id, group_id || '-' || n AS query_id, text FROM (SELECT DISTINCT group_id FROM ep), (VALUES @asked) AS a(n, text)
), t AS (SELECT group_id, uuid, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_-]+')) AS token FROM ep
), p AS (SELECT group_id, uuid, token, count(*) AS tf FROM t GROUP BY ALL
), l AS (SELECT uuid, count(*) AS len FROM t GROUP BY ALL
), f AS (SELECT token, count(*) AS df FROM p GROUP BY ALL
), s AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM l
), w AS (SELECT DISTINCT query_id, group_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_-]+')) AS token FROM q
), bm AS (
  SELECT query_id, w.group_id, uuid, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS fulltext_score
  FROM w JOIN p USING (group_id, token) JOIN l USING (uuid) JOIN f USING (token), s GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fulltext_score DESC, uuid) AS rank FROM bm)
"""
BM25 = _BM25.replace("@asked", ", ".join(f"({k}, '{t}')" for k, t in enumerate(ASKED)))


def episode_index(spark, d, per_group: bool = False):
    return search.build_text_index(episodes(spark, d), F.col("content"), per_group)


@register(REGISTRY, BM25 + "SELECT query_id, uuid, fulltext_score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 10")
def fulltext_bm25_topk(spark, d):
    found = search.fulltext_search(episode_index(spark, d), text_queries(spark, d), 10)
    return found.select("query_id", "uuid", "fulltext_score", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, BM25 + "SELECT query_id, uuid, fulltext_score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 10")
def fulltext_written_index(spark, d):
    """As ``fulltext_bm25_topk``, from an index that is written in two segments and searched block by block."""
    e = episodes(spark, d)
    index = WrittenIndex(spark, Stages(spark, "index").folder, 16)
    index.create(e.filter("conv_id % 2 = 0"), F.col("content")).append(e.filter("conv_id % 2 <> 0"), F.col("content"))
    found = search.fulltext_search(index, text_queries(spark, d), 10)
    return found.select("query_id", "uuid", "fulltext_score", F.col("rank").cast("long").alias("rank"))


_FACTS = _BM25.replace("FROM ep\n), p AS", "FROM (SELECT group_id, uuid, fact AS content FROM rel)\n), p AS").replace("VALUES @asked", "SELECT 0, 'with'")


@register(REGISTRY, _FACTS + "SELECT query_id, uuid, source_uuid, target_uuid, fact, fulltext_score, round(1.0::DOUBLE / (60 + rank), 9) AS rrf_score, CAST(rank AS BIGINT) AS rank FROM ranked JOIN rel USING (group_id, uuid) WHERE rank <= 50")
def fact_search(spark, d):
    """The facts of each group that a word asks for, with both ends."""
    edges = graph_tables(spark, d)["edges"]
    groups = episodes(spark, d).select("group_id").distinct()
    asked = groups.select(F.concat("group_id", F.lit("-0")).alias("query_id"), "group_id", F.lit("with").alias("text"))
    found = search.fact_search(search.build_text_index(edges, F.col("fact")), edges, asked, 50)
    return found.select("query_id", "uuid", "source_uuid", "target_uuid", "fact", "fulltext_score", "rrf_score", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, "SELECT conv_id, turn, coalesce(nullif(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}_-]+'), ' '), ''), 'none') AS sanitized FROM conversations")
def fulltext_sanitize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sanitize_query(F.col("text")).alias("sanitized"))


@register(REGISTRY, "SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized FROM conversations")
def normalize_text_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", normalize_text(F.col("text")).alias("normalized"))


@register(REGISTRY, "SELECT event_id, strftime(ts, '%Y/%m/%d (%a) %H:%M') AS shown FROM events")
def timestamp_display(spark, d):
    return table(spark, d, "events").select("event_id", shown_timestamp(F.col("ts")).alias("shown"))


@register(REGISTRY, "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def safe_slug(spark, d):
    return table(spark, d, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@register(REGISTRY, "SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END), ''), 'user') AS speaker FROM conversations")
def forced_speaker(spark, d):
    role = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(" "))
    return table(spark, d, "conversations").select("conv_id", "turn", speaker_name(role).alias("speaker"))


# Documents with a vector: doc_id of a document is the vec_id of its vector, where there is one.
HYBRID = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS token FROM doc),
p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY ALL), s AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM l),
q AS (SELECT vec_id, embedding, CASE vec_id % 3 WHEN 0 THEN 'the and' WHEN 1 THEN 'que la' ELSE 'der und' END AS text FROM embeddings WHERE vec_id % 20 = 0),
w AS (SELECT DISTINCT vec_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_-]+')) AS token FROM q),
bm AS (SELECT vec_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS fulltext_score
  FROM w JOIN p USING (token) JOIN l USING (doc_id) JOIN f USING (token), s GROUP BY ALL),
a AS (SELECT vec_id, 'd' || doc_id AS uuid, fulltext_score, NULL::DOUBLE AS similarity, 0 AS list_no, row_number() OVER (PARTITION BY vec_id ORDER BY fulltext_score DESC, 'd' || doc_id) AS rank FROM bm QUALIFY rank <= 30),
b AS (SELECT q.vec_id, 'd' || doc_id AS uuid, NULL::DOUBLE AS fulltext_score, round(list_cosine_similarity(doc.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity, 1 AS list_no,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(doc.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, 'd' || doc_id) AS rank FROM doc, q QUALIFY rank <= 30),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
fused AS (SELECT 'q' || vec_id AS query_id, uuid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, max(fulltext_score) AS fulltext_score, max(similarity) AS similarity, min(list_no * 1000000 + rank) AS first FROM u GROUP BY ALL),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(similarity, 0) DESC, coalesce(fulltext_score, 0) DESC, first, uuid) AS rank FROM fused QUALIFY rank <= 30)
"""


def hybrid(spark, d, limit: int = 30):
    """Fused candidates of every vector whose id is divisible by 20, each with one of three texts, over documents that have a vector."""
    v = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").join(v, F.col("doc_id") == F.col("vec_id")).select(F.lit("d").alias("group_id"), F.concat(F.lit("d"), "doc_id").alias("uuid"), F.coalesce("text", F.lit("")).alias("content"), "embedding")
    asked = F.when(F.col("vec_id") % 3 == 0, "the and").when(F.col("vec_id") % 3 == 1, "que la").otherwise("der und")
    q = v.filter("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.lit("d").alias("group_id"), asked.alias("text"), F.col("embedding").alias("vector"))
    return search.hybrid_search(search.build_text_index(docs, F.col("content")), docs, "embedding", q, limit)


@register(REGISTRY, HYBRID + "SELECT query_id, uuid, rrf_score, fulltext_score, similarity, CAST(rank AS BIGINT) AS rank FROM final")
def rrf_fuse_text_vector(spark, d):
    return hybrid(spark, d).select("query_id", "uuid", "rrf_score", "fulltext_score", "similarity", F.col("rank").cast("long").alias("rank"))


_DECIDE = """SELECT query_id, coalesce(min_by(uuid, rank) FILTER (uuid = {exact}), max(uuid) FILTER (rank = 1 AND (coalesce(similarity, 0) >= {high} OR (coalesce(similarity, 0) >= {low} AND coalesce(fulltext_score, 0) > 0)))) AS match_uuid FROM final GROUP BY query_id"""


@register(REGISTRY, HYBRID + _DECIDE.format(exact="'d' || (substr(query_id, 2)::INT + 1)", high=0.92, low=0.88))
def entity_match_decision(spark, d):
    exact = F.col("uuid") == F.concat(F.lit("d"), (F.substring("query_id", 2, 9).cast("int") + 1).cast("string"))
    return search.match_decisions(hybrid(spark, d), exact, 0.92, 0.88)


@register(REGISTRY, HYBRID + _DECIDE.format(exact="'none'", high=0.94, low=0.88))
def edge_match_decision(spark, d):
    return search.match_decisions(hybrid(spark, d), F.col("uuid") == "none", 0.94, 0.88)


@register(REGISTRY, BM25 + """, seen AS (SELECT *, rank <= 10 AS a FROM ranked), other AS (SELECT query_id, uuid, row_number() OVER (PARTITION BY query_id ORDER BY uuid) AS rank FROM ranked)
SELECT query_id, uuid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score FROM (SELECT query_id, uuid, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, uuid, rank FROM other WHERE rank <= 10) GROUP BY ALL""")
def reciprocal_rank_sums(spark, d):
    scores = search.fulltext_scores(episode_index(spark, d), text_queries(spark, d)).withColumn("fulltext_score", F.round("fulltext_score", 6))
    first = search.top_per_query(scores, "fulltext_score", 10)
    other = search.top_per_query(scores.withColumn("zero", F.lit(0)), "zero", 10)
    found = fusion.reciprocal_ranks(first.select("query_id", "uuid", "rank").unionByName(other.select("query_id", "uuid", "rank")))
    return found.withColumn("rrf_score", F.round("rrf_score", 9))
