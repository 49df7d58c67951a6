"""The two retrieval routes and what follows them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import graph, search
from tessera.plans import retrieval
from tessera.providers import LetterEmbedder, LexicalReranker, LexicalSelector
from tessera.stages import Stages

from .base import GRAPH, LETTERS, TREE, graph_tables, register, tree_tables

REGISTRY: dict = {}

# --- System 2 over the region tree ------------------------------------------------


def tree_queries(spark, t):
    """Query texts from the tree's own names: an exact region; a region with one of its nations; a region with more words."""
    names = t["categories"]
    region = names.filter("layer = 2").select("uuid", "name")
    nation = names.filter("layer = 1").select(F.col("uuid").alias("n_uuid"), F.col("name").alias("n_name"))
    link = t["categorizes"].select(F.col("parent_uuid").alias("uuid"), F.col("child_uuid").alias("n_uuid")).groupBy("uuid").agg(F.min("n_uuid").alias("n_uuid"))
    rows = region.join(link, "uuid").join(nation, "n_uuid")
    text = F.when(F.col("uuid") == "r0", F.col("name")).when(F.col("uuid") == "r1", F.concat_ws(" ", "name", "n_name")).otherwise(F.concat_ws(" ", "name", F.lit("something")))
    return rows.select(F.concat(F.lit("q"), "uuid").alias("query_id"), F.lit("tpch").alias("group_id"), F.lower(text).alias("text"))


_WALK = TREE.rstrip() + """, q AS (
  SELECT 'q' || r.uuid AS query_id, lower(CASE r.uuid WHEN 'r0' THEN r.name WHEN 'r1' THEN r.name || ' ' || n.name ELSE r.name || ' something' END) AS text
  FROM node r JOIN (SELECT parent, min(child) AS child FROM link GROUP BY 1) l ON l.parent = r.uuid JOIN node n ON n.uuid = l.child WHERE r.layer = 2),
hit AS (SELECT q.query_id, n.uuid, n.layer, lower(n.name) = q.text AS every FROM q JOIN node n ON len(list_intersect(regexp_extract_all(lower(n.name), '[\\p{L}\\p{N}_-]+'), regexp_extract_all(q.text, '[\\p{L}\\p{N}_-]+'))) > 0),
p2 AS (SELECT * FROM hit WHERE layer = 2),
p1 AS (SELECT DISTINCT h.* FROM hit h JOIN link l ON l.child = h.uuid JOIN p2 ON p2.uuid = l.parent AND p2.query_id = h.query_id AND NOT p2.every WHERE h.layer = 1),
"""
_LEAVES = "SELECT t.query_id, c.child AS uuid FROM ({top}) t JOIN link n ON n.parent = t.uuid JOIN link c ON c.parent = n.child UNION SELECT t.query_id, c.child FROM ({mid}) t JOIN link c ON c.parent = t.uuid"
_FAITHFUL = _WALK + "sel AS (" + _LEAVES.format(top="SELECT * FROM p2", mid="SELECT * FROM p1") + ")"
_NARROW = _WALK + "sel AS (" + _LEAVES.format(top="SELECT * FROM p2 WHERE every OR NOT EXISTS (SELECT 1 FROM p1 JOIN link l ON l.child = p1.uuid WHERE p1.query_id = p2.query_id AND l.parent = p2.uuid)", mid="SELECT * FROM p1") + ")"
_TWIN = _WALK + """sel AS (SELECT query_id, uuid FROM p2 WHERE NOT every UNION SELECT query_id, uuid FROM p1 WHERE NOT every
  UNION SELECT p2.query_id, l.child FROM p2 JOIN link l ON l.parent = p2.uuid WHERE every UNION SELECT p2.query_id, c.child FROM p2 JOIN link l ON l.parent = p2.uuid JOIN link c ON c.parent = l.child WHERE every
  UNION SELECT p1.query_id, l.child FROM p1 JOIN link l ON l.parent = p1.uuid WHERE every)"""


def _walk(spark, d, **options):
    t = tree_tables(spark, d)
    return retrieval.layer_walk(t, tree_queries(spark, t), LexicalSelector(), 2, **options).select("query_id", "uuid")


@register(REGISTRY, _FAITHFUL + " SELECT query_id, uuid FROM sel")
def system2_walk_faithful(spark, d):
    return _walk(spark, d)


@register(REGISTRY, _NARROW + " SELECT query_id, uuid FROM sel")
def system2_walk_narrowing(spark, d):
    return _walk(spark, d, mode="narrowing")


@register(REGISTRY, _TWIN + " SELECT query_id, uuid FROM sel")
def system2_walk_twin(spark, d):
    return _walk(spark, d, leaf_resolution=False)


def _system2(spark, d, item, **options):
    t = tree_tables(spark, d)
    none = t["entities"].limit(0).select("group_id", "uuid", F.col("uuid").alias("source_uuid"), F.col("uuid").alias("target_uuid"), F.col("name").alias("fact"), F.lit(None).cast("timestamp").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    return retrieval.system2(t | {"edges": none}, tree_queries(spark, t), LexicalSelector(), 2, **options)[item]


@register(REGISTRY, _FAITHFUL + " SELECT DISTINCT query_id, 'o' || o_orderkey AS uuid FROM sel JOIN orders ON 'c' || o_custkey = sel.uuid")
def system2_retrieve_faithful(spark, d):
    return _system2(spark, d, "episodes").select("query_id", "uuid")


@register(REGISTRY, _NARROW + " SELECT DISTINCT query_id, 'o' || o_orderkey AS uuid FROM sel JOIN orders ON 'c' || o_custkey = sel.uuid")
def system2_retrieve_narrowing(spark, d):
    return _system2(spark, d, "episodes", mode="narrowing").select("query_id", "uuid")


@register(REGISTRY, _TWIN + " SELECT DISTINCT query_id, 'o' || o_orderkey AS uuid FROM sel JOIN orders ON 'c' || o_custkey = sel.uuid")
def system2_retrieve_twin(spark, d):
    return _system2(spark, d, "episodes", leaf_resolution=False).select("query_id", "uuid")


@register(REGISTRY, TREE + " SELECT 'r' || r_regionkey AS query_id, string_agg('{\"uuid\":\"n' || n_nationkey || '\",\"name\":\"' || n_name || '\"}', chr(10) ORDER BY n_name, 'n' || n_nationkey) AS payload FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def prompt_payload(spark, d):
    t = tree_tables(spark, d)
    asked = t["categories"].filter("layer = 2").select(F.col("uuid").alias("query_id"), "group_id", "uuid")
    found = graph.children(asked, t["categorizes"], graph.hierarchy_nodes(t["entities"], t["categories"]))
    return retrieval.prompt_payload(found, ("uuid", "name"))


# --- System 1 over the conversation graph ------------------------------------------

def named_queries(spark, g):
    """One query per group: its two entities with the smallest ids, by name."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("uuid"))
    first = g["entities"].select("group_id", "uuid", "name", place.alias("place")).filter("place <= 2")
    names = first.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uuid", "name"))), lambda x: x["name"]), " ").alias("text"))
    return names.select(F.concat(F.lit("q-"), "group_id").alias("query_id"), "group_id", "text")


def _bm25(name, docs, text):
    return f"""{name}t AS (SELECT group_id, uuid, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_-]+')) AS token FROM {docs}),
{name}p AS (SELECT group_id, uuid, token, count(*) AS tf FROM {name}t GROUP BY ALL), {name}l AS (SELECT uuid, count(*) AS len FROM {name}t GROUP BY ALL), {name}f AS (SELECT token, count(*) AS df FROM {name}p GROUP BY ALL),
{name}s AS (SELECT count(*) AS n_docs, avg(len) AS mean_len FROM {name}l),
{name}b AS (SELECT query_id, w.group_id, uuid, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS fulltext_score
  FROM w JOIN {name}p USING (group_id, token) JOIN {name}l USING (uuid) JOIN {name}f USING (token), {name}s GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fulltext_score DESC, uuid) AS rank, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY fulltext_score DESC, uuid)), 9) AS rrf_score FROM {name}b QUALIFY rank <= 50)"""


SYSTEM1 = GRAPH.rstrip() + """, q AS (SELECT 'q-' || group_id AS query_id, group_id, string_agg(name, ' ' ORDER BY uuid) AS text FROM (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY uuid) <= 2) GROUP BY group_id),
w AS (SELECT DISTINCT query_id, group_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS token FROM q),
""" + _bm25("se", "ent", "name || ' ' || summary") + ",\n" + _bm25("de", "ep", "content") + """,
xe AS (SELECT s.query_id, m.episode_uuid AS uuid, count(DISTINCT s.uuid) AS n, max(s.rrf_score) AS score FROM se s JOIN men m ON m.group_id = s.group_id AND m.entity_uuid = s.uuid GROUP BY ALL),
xel AS (SELECT xe.*, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ep.valid_at DESC, xe.uuid) AS place FROM xe JOIN ep ON ep.uuid = xe.uuid QUALIFY place <= 50),
und AS (SELECT group_id, uuid AS edge_uuid, valid_at, source_uuid AS seed, target_uuid AS other FROM rel UNION ALL SELECT group_id, uuid, valid_at, target_uuid, source_uuid FROM rel WHERE source_uuid <> target_uuid),
xg AS (SELECT s.query_id, u.edge_uuid, u.other, u.valid_at, count(DISTINCT s.uuid) AS n, max(s.rrf_score) AS score FROM se s JOIN und u ON u.group_id = s.group_id AND u.seed = s.uuid GROUP BY ALL),
xp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, valid_at DESC, edge_uuid, other) AS place FROM xg QUALIFY place <= 50),
pe AS (SELECT query_id, uuid, max(score) AS rrf_score, max(n) AS n, max(ft) AS ft FROM (SELECT query_id, uuid, score, n, NULL AS ft FROM xel UNION ALL SELECT query_id, uuid, rrf_score, NULL, fulltext_score FROM de) GROUP BY ALL),
pn AS (SELECT query_id, uuid, max(score) AS rrf_score, max(n) AS n, max(ft) AS ft FROM (SELECT query_id, uuid, rrf_score AS score, NULL AS n, fulltext_score AS ft FROM se
  UNION ALL SELECT query_id, other, arg_max(score, place), arg_max(n, place), NULL FROM xp GROUP BY 1, 2) GROUP BY ALL),
pg AS (SELECT query_id, edge_uuid AS uuid, arg_max(score, place) AS rrf_score, arg_max(n, place) AS n, NULL AS ft FROM xp GROUP BY 1, 2)
"""
_POOL = "SELECT query_id, uuid, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(n, 0) DESC, coalesce(ft, 0) DESC, uuid) AS BIGINT) AS place FROM {} QUALIFY place <= 50"


def _system1(spark, d, item):
    g = graph_tables(spark, d)
    return retrieval.system1(g, named_queries(spark, g), Config())[item].select("query_id", "uuid", "rrf_score", F.col("place").cast("long").alias("place"))


@register(REGISTRY, SYSTEM1 + _POOL.format("pe"))
def system1_retrieve_episodes(spark, d):
    return _system1(spark, d, "episodes")


@register(REGISTRY, SYSTEM1 + _POOL.format("pn"))
def system1_retrieve_nodes(spark, d):
    return _system1(spark, d, "nodes")


@register(REGISTRY, SYSTEM1 + _POOL.format("pg"))
def system1_retrieve_edges(spark, d):
    return _system1(spark, d, "edges")


@register(REGISTRY, GRAPH + """, picked AS (SELECT group_id AS query_id, 'episodes' AS item_type, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS place, '[' || strftime(valid_at, '%Y/%m/%d (%a) %H:%M') || '] ' || content AS line FROM ep
  UNION ALL SELECT group_id, 'nodes', row_number() OVER (PARTITION BY group_id ORDER BY uuid), name FROM ent),
sec AS (SELECT query_id, item_type, '<' || upper(item_type) || '>' || chr(10) || string_agg(line, chr(10) ORDER BY place) || chr(10) || '</' || upper(item_type) || '>' AS body FROM picked GROUP BY query_id, item_type)
SELECT query_id, string_agg(body, chr(10) ORDER BY CASE item_type WHEN 'nodes' THEN 0 ELSE 2 END) AS context FROM sec GROUP BY query_id""")
def context_render(spark, d):
    g = graph_tables(spark, d)
    e = g["episodes"].withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("seq")))
    lines = e.select(F.col("group_id").alias("query_id"), F.lit("episodes").alias("item_type"), "place", retrieval.candidate_text("episodes").alias("line"))
    n = g["entities"].withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("uuid")))
    return retrieval.render_context(lines.unionByName(n.select(F.col("group_id").alias("query_id"), F.lit("nodes").alias("item_type"), "place", F.col("name").alias("line"))))


def whole_retrieval(spark, d, item):
    """Both routes over the conversation graph, with a hierarchy by first letters; the queries name two entities and a letter."""
    from tessera.functions.text import stable_id

    stages = Stages(spark, "retrieve")
    made = graph_tables(spark, d)
    g = {name: made[name] for name in ("entities", "edges")} | stages.keep_all({name: made[name] for name in ("episodes", "mentions")})
    letter = F.substring("name", 1, 1)
    cats = g["entities"].select("group_id", letter.alias("name")).distinct().withColumn("uuid", stable_id("category", F.col("group_id"), F.lit(1), F.col("name")))
    categories = cats.select("group_id", "uuid", "name", F.array("name").alias("tag"), F.lit(1).alias("layer"))
    links = g["entities"].select("group_id", letter.alias("name"), F.col("uuid").alias("child_uuid")).join(cats.withColumnRenamed("uuid", "parent_uuid"), ["group_id", "name"])
    tables = g | {"categories": categories, "categorizes": links.select("group_id", "parent_uuid", "child_uuid")}
    queries = stages.keep("queries", named_queries(spark, g).withColumn("text", F.concat_ws(" ", "text", F.substring("text", 1, 1))))
    return retrieval.retrieve(tables, queries, LexicalSelector(), LexicalReranker(), 1, Config(), stages=stages)[item]


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_-]+'))"
_LETTERED = "string_agg(name, ' ' ORDER BY uuid) || ' ' || substr(string_agg(name, ' ' ORDER BY uuid), 1, 1) AS text"
RETRIEVED = SYSTEM1.replace("string_agg(name, ' ' ORDER BY uuid) AS text", _LETTERED).rstrip() + f""",
taken AS (SELECT q.query_id, e.group_id, e.uuid FROM q JOIN ent e ON e.group_id = q.group_id AND substr(e.name, 1, 1) = substr(q.text, 1, 1)),
two AS (SELECT DISTINCT query_id, 'episodes' AS item_type, m.episode_uuid AS uuid FROM taken JOIN men m ON m.group_id = taken.group_id AND m.entity_uuid = taken.uuid
  UNION SELECT query_id, 'edges', u.edge_uuid FROM taken JOIN und u ON u.group_id = taken.group_id AND u.seed = taken.uuid
  UNION SELECT query_id, 'nodes', u.other FROM taken JOIN und u ON u.group_id = taken.group_id AND u.seed = taken.uuid
  UNION SELECT query_id, 'nodes', uuid FROM taken),
one AS (SELECT 'episodes' AS item_type, * FROM ({_POOL.format("pe")}) UNION ALL SELECT 'nodes', * FROM ({_POOL.format("pn")}) UNION ALL SELECT 'edges', * FROM ({_POOL.format("pg")})),
line AS (SELECT 'episodes' AS item_type, uuid, '[' || strftime(valid_at, '%Y/%m/%d (%a) %H:%M') || '] ' || content AS line FROM ep
  UNION ALL SELECT 'nodes', uuid, '{{"name":"' || name || '","tag":["' || tag || '"],"summary":"' || summary || '"}}' FROM ent
  UNION ALL SELECT 'edges', uuid, '{{"fact":"' || fact || '","valid_at":"' || strftime(valid_at, '%Y/%m/%d (%a) %H:%M') || '","invalid_at":null}}' FROM rel),
pool AS (SELECT coalesce(one.query_id, two.query_id) AS query_id, coalesce(one.item_type, two.item_type) AS item_type, coalesce(one.uuid, two.uuid) AS uuid, one.uuid IS NOT NULL AS in1, two.uuid IS NOT NULL AS in2,
  coalesce(rrf_score, 0) AS rrf, CASE WHEN two.uuid IS NOT NULL THEN greatest(coalesce(rrf_score, 0), 1.0) ELSE coalesce(rrf_score, 0) END AS route_score
  FROM one FULL JOIN two ON one.query_id = two.query_id AND one.item_type = two.item_type AND one.uuid = two.uuid),
asked AS (SELECT query_id, {_TOKENS.format("text")} AS asked FROM q),
scored AS (SELECT pool.*, line, 100.0::DOUBLE * len(list_intersect({_TOKENS.format("line")}, asked)) / len(asked) AS rerank_score FROM pool JOIN line USING (item_type, uuid) JOIN asked USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_type ORDER BY rerank_score DESC, route_score DESC, rrf DESC, uuid) AS place FROM scored),
final AS (SELECT * FROM ranked WHERE place <= CASE item_type WHEN 'episodes' THEN 10 ELSE 20 END)
"""


@register(REGISTRY, RETRIEVED + "SELECT query_id, uuid, rerank_score, route_score, CAST(place AS BIGINT) AS place FROM final WHERE item_type = 'episodes'")
def retrieve_final_episodes(spark, d):
    return whole_retrieval(spark, d, "episodes").select("query_id", "uuid", "rerank_score", "route_score", F.col("place").cast("long").alias("place"))


@register(REGISTRY, RETRIEVED + """, sec AS (SELECT query_id, item_type, '<' || upper(item_type) || '>' || chr(10) || string_agg(line, chr(10) ORDER BY place) || chr(10) || '</' || upper(item_type) || '>' AS body FROM final GROUP BY query_id, item_type)
SELECT query_id, string_agg(body, chr(10) ORDER BY CASE item_type WHEN 'nodes' THEN 0 WHEN 'edges' THEN 1 ELSE 2 END) AS context FROM sec GROUP BY query_id""")
def retrieve_context(spark, d):
    return whole_retrieval(spark, d, "context")


@register(REGISTRY, RETRIEVED + """SELECT query_id, item_type, count(*) FILTER (in1) AS system1_count, count(*) FILTER (in2) AS system2_count, count(*) FILTER (in1) + count(*) FILTER (in2) AS raw_count,
  count(*) AS merged_unique_count, count(*) AS reranked_count, count(*) FILTER (place <= CASE item_type WHEN 'episodes' THEN 10 ELSE 20 END) AS final_count FROM ranked GROUP BY query_id, item_type""")
def retrieve_counts(spark, d):
    return whole_retrieval(spark, d, "counts")


# --- Searches with both branches: BM25 and letter vectors ---------------------------

_Q = GRAPH.rstrip() + """, q AS (SELECT 'q-' || group_id AS query_id, group_id, string_agg(name, ' ' ORDER BY uuid) AS text FROM (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY uuid) <= 2) GROUP BY group_id),
w AS (SELECT DISTINCT query_id, group_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS token FROM q),
"""


def _branches(docs, text, told, limit, same=""):
    """Both ranked lists over ``docs`` and their fusion; ``told`` is the text of the vector, ``same`` a condition on query and row."""
    letters = f"(SELECT *, {LETTERS.format('lower(' + told + ')')} AS v FROM {docs})"
    asked = f"(SELECT *, {LETTERS.format('lower(text)')} AS v FROM q)"
    return _bm25("h", docs, text).replace("JOIN hl USING (uuid)", f"JOIN hl USING (uuid) {same}") + f""",
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, uuid) AS rank FROM (SELECT q.query_id, d.uuid, CASE WHEN list_sum(d.v) > 0 AND list_sum(q.v) > 0 THEN round(list_cosine_similarity(d.v, q.v), 6) ELSE 0 END AS similarity
  FROM {asked} q JOIN {letters} d ON d.group_id = q.group_id {same.replace("JOIN pair USING (query_id, uuid)", "JOIN pair ON pair.query_id = q.query_id AND pair.uuid = d.uuid")}) QUALIFY rank <= {limit}),
listed AS (SELECT query_id, uuid, fulltext_score, NULL::DOUBLE AS similarity, 0 AS list_no, rank FROM h WHERE rank <= {limit} UNION ALL SELECT query_id, uuid, NULL, similarity, 1, rank FROM vec),
fused AS (SELECT query_id, uuid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, max(fulltext_score) AS fulltext_score, max(similarity) AS similarity, min(list_no * 1000000 + rank) AS first FROM listed GROUP BY ALL),
final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(similarity, 0) DESC, coalesce(fulltext_score, 0) DESC, first, uuid) AS BIGINT) AS rank FROM fused QUALIFY rank <= {limit})
SELECT query_id, uuid, rrf_score, fulltext_score, similarity, rank FROM final"""


def letter_queries(spark, g):
    return named_queries(spark, g).withColumn("vector", LetterEmbedder().embed(F.col("text")))


def _hits(found):
    return found.select("query_id", "uuid", "rrf_score", "fulltext_score", "similarity", F.col("rank").cast("long").alias("rank"))


@register(REGISTRY, _Q + _branches("ent", "name || ' ' || summary", "summary", 50))
def entity_search_both(spark, d):
    """Entities near each query, by the text of name and summary and by the summary's vector."""
    g = graph_tables(spark, d)
    rows = g["entities"].withColumn("summary_embedding", LetterEmbedder().embed(F.col("summary")))
    index = search.build_text_index(rows, F.concat_ws(" ", "name", "summary"))
    return _hits(retrieval.candidates(index, rows, "summary_embedding", letter_queries(spark, g), 50, 60))


@register(REGISTRY, _Q + _branches("ent", "name", "name", 5))
def entity_dedup_candidates(spark, d):
    """The five entities that each query's text may be a spelling of, by name and by the name's vector."""
    g = graph_tables(spark, d)
    rows = g["entities"].withColumn("name_embedding", LetterEmbedder().embed(F.col("name")))
    return _hits(search.hybrid_search(search.build_text_index(rows, F.col("name")), rows, "name_embedding", letter_queries(spark, g), Config().dedup_limit))


@register(REGISTRY, _Q + _branches("ep", "content", "content", 50))
def episode_search_both(spark, d):
    g = graph_tables(spark, d)
    rows = g["episodes"].withColumn("episode_embedding", LetterEmbedder().embed(F.col("content")))
    return _hits(retrieval.candidates(search.build_text_index(rows, F.col("content")), rows, "episode_embedding", letter_queries(spark, g), 50, 60))


@register(REGISTRY, _Q + _branches("rel", "fact", "fact", 50).replace("SELECT query_id, uuid, rrf_score, fulltext_score, similarity, rank FROM final", "SELECT query_id, uuid, source_uuid, target_uuid, fact, rrf_score, fulltext_score, similarity, rank FROM final JOIN rel USING (uuid)"))
def fact_search_both(spark, d):
    """Facts near each query, by text and by the fact's vector, with both ends."""
    g = graph_tables(spark, d)
    rows = g["edges"].withColumn("fact_embedding", LetterEmbedder().embed(F.col("fact")))
    found = search.fact_search(search.build_text_index(rows, F.col("fact")), rows, letter_queries(spark, g), 50)
    return found.select("query_id", "uuid", "source_uuid", "target_uuid", "fact", "rrf_score", "fulltext_score", "similarity", F.col("rank").cast("long").alias("rank"))


_PAIRS = GRAPH.rstrip() + """, q AS (SELECT 'q-' || uuid AS query_id, group_id, fact AS text, source_uuid, target_uuid FROM rel), pair AS (SELECT q.query_id, r.uuid FROM q JOIN rel r USING (group_id, source_uuid, target_uuid)),
w AS (SELECT DISTINCT query_id, group_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS token FROM q),
"""


@register(REGISTRY, _PAIRS + _branches("rel", "fact", "fact", 5, "JOIN pair USING (query_id, uuid)"))
def edge_dedup_candidates(spark, d):
    """For every fact the facts between its two ends, in its direction, that may be the same."""
    g = graph_tables(spark, d)
    rows = g["edges"].withColumn("fact_embedding", LetterEmbedder().embed(F.col("fact")))
    asked = rows.select(F.concat(F.lit("q-"), "uuid").alias("query_id"), "group_id", "source_uuid", "target_uuid", F.col("fact").alias("text"), F.col("fact_embedding").alias("vector"))
    return _hits(search.edge_candidates(search.build_text_index(rows, F.col("fact")), rows, asked, Config().dedup_limit))
