"""Scores, merges, ranking, evaluation and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluate, fusion, graph, hierarchy

from .base import GRAPH, TREE, graph_tables, register, table, tree_tables
from .graph import EDGES, EPISODES, parents, seeds

REGISTRY: dict = {}

# Seeds scored by the number of their id's second hex digit.
_SEED_SCORE = "(instr('0123456789abcdef', substr(uuid, 2, 1)) / 16.0::DOUBLE)"


def seed_scores(g):
    return seeds(g).select("query_id", "uuid", (F.instr(F.lit("0123456789abcdef"), F.substring("uuid", 2, 1)) / F.lit(16.0)).alias("rrf_score"))


@register(REGISTRY, EPISODES + f"SELECT xr.query_id, xr.uuid, round(max(s.score), 6) AS rrf_score FROM xr JOIN men m ON m.episode_uuid = xr.uuid JOIN (SELECT query_id, uuid, {_SEED_SCORE} AS score FROM seed) s ON s.uuid = m.entity_uuid AND s.query_id = xr.query_id WHERE xr.place <= 20 GROUP BY ALL")
def score_propagation(spark, d):
    g = graph_tables(spark, d)
    found = graph.expand_to_episodes(seeds(g), g["entities"], g["mentions"], g["episodes"], 20)
    return fusion.propagate_scores(found, seed_scores(g)).select("query_id", "uuid", F.round("rrf_score", 6).alias("rrf_score"))


# Two lists of customers: by balance and by key, with partly missing columns.
_LISTS = """
WITH items AS (
  SELECT c_nationkey AS query_id, 'c' || c_custkey AS uuid, round(c_acctbal / 10000, 4) AS rrf_score, c_mktsegment AS segment, NULL::VARCHAR AS phase, 0 AS seq FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT c_nationkey, 'c' || c_custkey, round((c_custkey % 97) / 100, 4), CASE WHEN c_custkey % 2 = 0 THEN 'late' END, 'two', 1 FROM customer WHERE c_custkey % 4 <> 0)
"""


def ranked_items(spark, d):
    c = table(spark, d, "customer")
    q, u = F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("uuid")
    one = c.filter("c_custkey % 3 <> 0").select(q, u, F.round(F.col("c_acctbal") / 10000, 4).alias("rrf_score"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("phase"), F.lit(0).alias("seq"))
    two = c.filter("c_custkey % 4 <> 0").select(q, u, F.round((F.col("c_custkey") % 97) / 100, 4).alias("rrf_score"), F.when(F.col("c_custkey") % 2 == 0, F.lit("late")).alias("segment"), F.lit("two").alias("phase"), F.lit(1).alias("seq"))
    return one, two


_LATER = "arg_max(segment, seq) FILTER (segment IS NOT NULL) AS segment, arg_max(phase, seq) FILTER (phase IS NOT NULL) AS phase FROM items GROUP BY ALL"


@register(REGISTRY, _LISTS + "SELECT query_id, uuid, max(rrf_score) AS rrf_score, " + _LATER)
def merge_items_max(spark, d):
    one, two = ranked_items(spark, d)
    return fusion.merge_by_uuid(one.unionByName(two))


@register(REGISTRY, _LISTS + "SELECT query_id, uuid, arg_max(rrf_score, seq) AS rrf_score, " + _LATER)
def merge_items_last_wins(spark, d):
    one, two = ranked_items(spark, d)
    return fusion.merge_by_uuid(one.unionByName(two), last_wins=True)


_ROUTES = _LISTS.rstrip() + """, a AS (SELECT * FROM items WHERE seq = 0), b AS (SELECT * FROM items WHERE seq = 1),
routes AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.uuid, b.uuid) AS uuid, CASE WHEN b.uuid IS NOT NULL THEN b.segment ELSE a.segment END AS segment,
  coalesce(a.rrf_score, b.rrf_score, 0) AS rrf_score, CASE WHEN b.uuid IS NOT NULL THEN greatest(coalesce(a.rrf_score, 0), 1.0) ELSE coalesce(a.rrf_score, 0) END AS route_score,
  a.uuid IS NOT NULL AS from_system1, b.uuid IS NOT NULL AS from_system2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.uuid = b.uuid)
"""


def routes(spark, d):
    one, two = ranked_items(spark, d)
    return fusion.merge_routes(one.drop("seq", "phase"), two.drop("seq", "phase"))


@register(REGISTRY, _ROUTES + "SELECT query_id, uuid, segment, rrf_score, route_score::DOUBLE AS route_score, from_system1, from_system2 FROM routes")
def route_merge(spark, d):
    return routes(spark, d)


# Rerank scores: for two thirds of the customers, from their key.
_RERANKED = _ROUTES.rstrip() + """, s AS (SELECT c_nationkey AS query_id, 'c' || c_custkey AS uuid, (c_custkey % 11)::DOUBLE AS rerank_score FROM customer WHERE c_custkey % 3 <> 1),
ranked AS (SELECT r.*, s.rerank_score, row_number() OVER (PARTITION BY r.query_id ORDER BY coalesce(s.rerank_score, -1) DESC, r.route_score DESC, r.rrf_score DESC, r.uuid) AS place FROM routes r LEFT JOIN s USING (query_id, uuid))
"""


def reranked(spark, d, limit):
    c = table(spark, d, "customer").filter("c_custkey % 3 <> 1")
    scores = c.select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("uuid"), (F.col("c_custkey") % 11).cast("double").alias("rerank_score"))
    return fusion.rerank(routes(spark, d), scores, limit)


@register(REGISTRY, _RERANKED + "SELECT query_id, uuid, rerank_score, route_score::DOUBLE AS route_score, CAST(place AS BIGINT) AS place FROM ranked WHERE place <= 20")
def rerank_topk(spark, d):
    return reranked(spark, d, 20).select("query_id", "uuid", "rerank_score", "route_score", F.col("place").cast("long").alias("place"))


@register(REGISTRY, _RERANKED + """SELECT query_id, 'nodes' AS item_type, CAST(count_if(from_system1) AS BIGINT) AS system1_count, CAST(count_if(from_system2) AS BIGINT) AS system2_count, CAST(count_if(from_system1) + count_if(from_system2) AS BIGINT) AS raw_count,
count(*) AS merged_unique_count, count(*) AS reranked_count, CAST(count_if(place <= 20) AS BIGINT) AS final_count FROM ranked GROUP BY query_id""")
def retrieval_counts(spark, d):
    one, two = ranked_items(spark, d)
    kind = F.lit("nodes").alias("item_type")
    raw = one.select("query_id", kind, "uuid", F.lit("1").alias("route")).unionByName(two.select("query_id", kind, "uuid", F.lit("2").alias("route")))
    every = reranked(spark, d, 1 << 30)
    return evaluate.counts_block(raw, routes(spark, d).select("query_id", kind, "uuid"), every.select("query_id", kind, "uuid"), every.filter("place <= 20").select("query_id", kind, "uuid"))


@register(REGISTRY, EDGES + "SELECT query_id, edge_uuid AS uuid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matched_entity_count DESC, edge_uuid) AS BIGINT) AS place FROM (SELECT query_id, edge_uuid, arg_max(matched_entity_count, place) AS matched_entity_count FROM xp GROUP BY ALL) QUALIFY place <= 10")
def candidate_pool_sort(spark, d):
    g = graph_tables(spark, d)
    return graph.edge_pool(seeds(g), g["entities"], g["edges"], 10).select("query_id", "uuid", F.col("place").cast("long").alias("place"))


# --- evaluation -----------------------------------------------------------------

_ANSWERS = """
WITH answers AS (SELECT coalesce(source, '') AS group_id, (doc_id % 10)::INT AS user_index, doc_id AS question_index, lang AS category, quality = 1 AS is_correct, CASE WHEN toxic = 1 THEN 'failed' END AS error FROM labels JOIN documents USING (doc_id))
"""
_SUMMARY = "count(*) AS question_count, CAST(count_if(is_correct) AS BIGINT) AS correct_count, CAST(count_if(coalesce(error, '') <> '') AS BIGINT) AS failed_count, round(count_if(is_correct) / count(*), 6) AS accuracy"


def answers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.coalesce("source", F.lit("")).alias("group_id"), (F.col("doc_id") % 10).cast("int").alias("user_index"), F.col("doc_id").alias("question_index"), F.col("lang").alias("category"),
        (F.col("quality") == 1).alias("is_correct"), F.when(F.col("toxic") == 1, F.lit("failed")).alias("error"),
    )


@register(REGISTRY, _ANSWERS + f"SELECT {_SUMMARY} FROM answers")
def eval_summary(spark, d):
    return evaluate.eval_summary(answers(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@register(REGISTRY, _ANSWERS + f"SELECT 'category' AS scope, category, {_SUMMARY} FROM answers GROUP BY category UNION ALL SELECT 'all', NULL, {_SUMMARY} FROM answers UNION ALL SELECT 'without_excluded', NULL, {_SUMMARY} FROM answers WHERE category <> 'es'")
def eval_by_category(spark, d):
    return evaluate.category_accuracy(answers(spark, d), "es").withColumn("accuracy", F.round("accuracy", 6)).select("scope", "category", "question_count", "correct_count", "failed_count", "accuracy")


@register(REGISTRY, _ANSWERS + """SELECT group_id, CAST(question_index AS BIGINT) AS question_index, count(*) OVER w AS seen, CAST(count_if(is_correct) OVER w AS BIGINT) AS correct, round(count_if(is_correct) OVER w / count(*) OVER w, 6) AS running_accuracy
FROM answers WINDOW w AS (PARTITION BY group_id ORDER BY user_index, question_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_accuracy(spark, d):
    return evaluate.running_accuracy(answers(spark, d)).select("group_id", "question_index", "seen", "correct", F.round("running_accuracy", 6).alias("running_accuracy"))


@register(REGISTRY, GRAPH + """SELECT g.group_id AS query_id, coalesce(h.hits, 0) AS hits, least(5, g.n) AS n_gold FROM (SELECT group_id, count(*) AS n FROM ep GROUP BY 1) g LEFT JOIN (
  SELECT group_id, count(*) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seq) AS k FROM ep) WHERE k <= 5 AND speaker = 'user' GROUP BY 1) h USING (group_id)""")
def gold_hits(spark, d):
    from .base import episodes

    e = episodes(spark, d)
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("seq"))).filter("k <= 5")
    gold = first.groupBy(F.col("group_id").alias("query_id")).agg(F.collect_list("source_id").alias("evidence"))
    found = e.filter("speaker = 'user'").select(F.col("group_id").alias("query_id"), "source_id")
    return evaluate.gold_hits(found, gold)


@register(REGISTRY, """
WITH e AS (SELECT event_id AS seq, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS operation, CASE WHEN event_id % 3 = 0 THEN 'llm_call' ELSE 'stage_runtime' END AS kind, value, CASE WHEN event_id % 3 = 0 THEN 'm' || user_id % 4 END AS model FROM events),
s AS (SELECT stage, operation, CAST(count_if(kind = 'llm_call') AS BIGINT) AS llm_calls, round(sum(CASE WHEN kind = 'llm_call' THEN value ELSE 0 END), 4) AS llm_seconds, CAST(sum(CASE WHEN kind = 'llm_call' THEN seq % 100 ELSE 0 END) AS BIGINT) AS total_tokens,
  round(sum(CASE WHEN kind = 'stage_runtime' THEN value ELSE 0 END) + arg_min(CASE WHEN kind = 'llm_call' THEN value ELSE 0 END, seq), 4) AS wall_clock_seconds FROM e GROUP BY ALL),
m AS (SELECT stage, operation, string_agg(model, '|' ORDER BY f) AS models FROM (SELECT stage, operation, model, min(seq) AS f FROM e WHERE model IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT s.stage, s.operation, llm_calls, llm_seconds, total_tokens, coalesce(models, '') AS models, wall_clock_seconds FROM s LEFT JOIN m USING (stage, operation)
""")
def stage_report(spark, d):
    call = F.col("event_id") % 3 == 0
    e = table(spark, d, "events").select(
        F.when(call, "llm_call").otherwise("stage_runtime").alias("event_type"), F.col("event_type").alias("stage"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("operation"), F.col("value").alias("runtime_seconds"),
        F.when(call, F.concat(F.lit("m"), F.col("user_id") % 4)).alias("model"), F.when(call, F.lit(0)).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.when(call, F.col("event_id") % 100).cast("long").alias("total_tokens"), F.col("event_id").alias("seq"),
    )
    r = evaluate.stage_report(e)
    return r.select("stage", "operation", "llm_calls", F.round("llm_seconds", 4).alias("llm_seconds"), "total_tokens", "models", F.round("wall_clock_seconds", 4).alias("wall_clock_seconds"))


# --- hierarchy ------------------------------------------------------------------

# Nodes: vectors by index; assignments: names from labels over strided indexes, some invalid.
_LAYER = """
WITH node AS (SELECT 'g' || (vec_id % 2) AS group_id, 'v' || vec_id AS uuid, 'node ' || (label * 3 + vec_id % 2) AS name, 'tag' || label AS tag, CAST(row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS BIGINT) AS index, label = 9 AS is_speaker, label FROM embeddings),
assigned AS (
  SELECT group_id, label AS row_no, CASE WHEN label = 3 THEN 'this and that' WHEN label = 4 THEN 'cat 5' ELSE 'cat ' || label END AS category, index FROM node WHERE label <> 8
  UNION ALL SELECT group_id, 100 + label, 'node ' || label, min(index) FROM node WHERE label < 3 GROUP BY ALL),
valid AS (SELECT a.*, n.uuid, n.name, n.tag, n.is_speaker FROM assigned a JOIN node n USING (group_id, index) WHERE NOT n.is_speaker AND trim(category) <> '' AND NOT contains(' ' || lower(category) || ' ', ' and ')),
kept AS (SELECT * FROM valid QUALIFY count(*) OVER (PARTITION BY group_id, row_no) >= 2),
covered AS (SELECT group_id, category, uuid, min(row_no * 1000000 + index) AS pos FROM kept GROUP BY ALL)
"""


def layer_nodes(spark, d):
    v = table(spark, d, "embeddings")
    index = F.row_number().over(Window.partitionBy(F.col("vec_id") % 2).orderBy("vec_id")) - 1
    return v.select(F.concat(F.lit("g"), F.col("vec_id") % 2).alias("group_id"), F.concat(F.lit("v"), "vec_id").alias("uuid"), F.concat(F.lit("node "), F.col("label") * 3 + F.col("vec_id") % 2).alias("name"), F.array(F.concat(F.lit("tag"), "label")).alias("tag"), index.alias("index"), (F.col("label") == 9).alias("is_speaker"), "label")


def layer_assignments(nodes):
    name = F.when(F.col("label") == 3, "this and that").when(F.col("label") == 4, "cat 5").otherwise(F.concat(F.lit("cat "), "label"))
    many = nodes.filter("label <> 8").groupBy("group_id", F.col("label").cast("long").alias("row_no"), name.alias("category")).agg(F.array_sort(F.collect_list("index")).alias("indexes"))
    one = nodes.filter("label < 3").groupBy("group_id", (F.col("label") + 100).cast("long").alias("row_no"), F.concat(F.lit("node "), "label").alias("category")).agg(F.array(F.min("index")).alias("indexes"))
    return many.unionByName(one)


@register(REGISTRY, _LAYER + "SELECT group_id, category, uuid FROM kept")
def category_assign_filter(spark, d):
    n = layer_nodes(spark, d)
    return hierarchy.assigned_members(layer_assignments(n), n.filter("NOT is_speaker"), 2).select("group_id", "category", "uuid")


_MATERIAL = _LAYER.rstrip() + """, open AS (SELECT n.* FROM node n WHERE NOT is_speaker AND NOT EXISTS (SELECT 1 FROM covered t WHERE t.group_id = n.group_id AND t.uuid = n.uuid)),
nth AS (SELECT o.*, row_number() OVER (PARTITION BY o.group_id, o.name ORDER BY index, uuid) - 1 + CASE WHEN EXISTS (SELECT 1 FROM covered t WHERE t.group_id = o.group_id AND t.category = o.name) THEN 1 ELSE 0 END AS k FROM open o),
promoted AS (SELECT group_id, name || CASE WHEN k = 0 THEN '' WHEN k = 1 THEN ' (Promoted)' ELSE ' (Promoted ' || k || ')' END AS category, uuid FROM nth),
members AS (SELECT group_id, category, 'natural' AS kind, uuid, pos FROM covered UNION ALL SELECT group_id, category, 'promoted', uuid, 0 FROM promoted UNION ALL SELECT group_id, 'Speaker', 'speaker', uuid, index FROM node WHERE is_speaker)
"""


@register(REGISTRY, _MATERIAL + "SELECT group_id, category, kind, uuid FROM members")
def category_materialize(spark, d):
    n = layer_nodes(spark, d)
    return hierarchy.materialize_layer(layer_assignments(n), n, 1).select("group_id", "category", "kind", "uuid")


@register(REGISTRY, _MATERIAL + "SELECT group_id, category, uuid FROM promoted")
def promotion_names(spark, d):
    n = layer_nodes(spark, d)
    return hierarchy.materialize_layer(layer_assignments(n), n, 1).filter("kind = 'promoted'").select("group_id", "category", "uuid")


@register(REGISTRY, _MATERIAL + """, size AS (SELECT group_id, category, kind, count(*) AS n FROM members GROUP BY ALL), layer AS (SELECT unnest([1, 2]) AS layer),
per AS (SELECT group_id, count(*) AS n_categories, bool_and(n >= 2 OR category = 'Speaker' OR (kind = 'promoted' AND n = 1)) AS good FROM size GROUP BY group_id), sizes AS (SELECT group_id, count(*) AS n_nodes FROM node GROUP BY group_id)
SELECT CAST(layer AS BIGINT) AS layer, group_id, n_nodes, n_categories, good AND (layer < 2 OR n_categories <= n_nodes) AS accepted FROM per JOIN sizes USING (group_id), layer""")
def cec_check(spark, d):
    n = layer_nodes(spark, d)
    made = hierarchy.layer_categories(hierarchy.materialize_layer(layer_assignments(n), n, 1), n)
    both = [hierarchy.check_layer(made, n, k).select(F.lit(k).cast("long").alias("layer"), "group_id", "n_nodes", "n_categories", "accepted") for k in (1, 2)]
    return both[0].unionByName(both[1])


@register(REGISTRY, _MATERIAL + """, seen AS (SELECT group_id, m.category, n.tag, min(m.pos) AS first FROM members m JOIN node n USING (group_id, uuid) GROUP BY group_id, m.category, n.tag), tags AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY group_id, category ORDER BY first) <= 5),
named AS (SELECT m.group_id, m.category, n.name, m.pos, m.uuid FROM members m JOIN node n USING (group_id, uuid) QUALIFY row_number() OVER (PARTITION BY m.group_id, m.category ORDER BY m.pos, m.uuid) <= 6)
SELECT t.group_id, t.category, t.tags, n.summary FROM (SELECT group_id, category, string_agg(tag, ',' ORDER BY first) AS tags FROM tags GROUP BY ALL) t
JOIN (SELECT group_id, category, category || ': ' || string_agg(name, ', ' ORDER BY pos, uuid) AS summary FROM named GROUP BY group_id, category) n USING (group_id, category)""")
def tag_merge_and_summary(spark, d):
    n = layer_nodes(spark, d)
    made = hierarchy.layer_categories(hierarchy.materialize_layer(layer_assignments(n), n, 1), n)
    return made.select("group_id", "category", F.array_join("tag", ",").alias("tags"), "summary")


_TAGS = REGISTRY["tag_merge_and_summary"][1]


@register(REGISTRY, f"""SELECT group_id, category, CASE WHEN hash_no % 3 = 0 THEN 'x,y' ELSE tags END AS tags, CASE WHEN hash_no % 3 < 2 THEN 'About ' || trim(category) ELSE summary END AS summary
FROM (SELECT *, length(category) AS hash_no FROM ({_TAGS}))""")
def category_details(spark, d):
    """Details as a model may give them: for some categories blank summaries, for some no tags, for some nothing."""
    n = layer_nodes(spark, d)
    made = hierarchy.layer_categories(hierarchy.materialize_layer(layer_assignments(n), n, 1), n)
    no = F.length("category") % 3
    summary = F.when(no < 2, F.concat(F.lit(" About "), F.trim("category"), F.lit(" "))).otherwise(F.lit("  "))
    tags = F.when(no == 0, F.array(F.lit(" x "), F.lit(""), F.lit("y"), F.lit("z")))
    told = made.select("group_id", F.concat(F.lit(" "), "category").alias("category"), summary.alias("summary"), tags.alias("tag"))
    return hierarchy.with_details(made, told).select("group_id", "category", F.array_join("tag", ",").alias("tags"), "summary")


def _speakers(mode, where):
    sql = "SELECT conv_id, turn, CAST(" + where + " AS BOOLEAN) AS reserved FROM conversations"

    def query(spark, d):
        c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.lit(" User")).otherwise(F.col("role")).alias("name"), (F.col("role") == "user").alias("is_speaker"))
        return c.select("conv_id", "turn", hierarchy.is_reserved_speaker(1, mode).alias("reserved"))

    query.__name__ = f"speaker_partition_{mode}"
    return register(REGISTRY, sql)(query)


speaker_partition_paper = _speakers("paper_v2", "role = 'user'")
speaker_partition_prompt = _speakers("appendix_prompt", "turn % 2 = 0 OR lower(trim(role)) IN ('user', 'i', 'me')")
speaker_partition_disabled = _speakers("disabled", "false")


@register(REGISTRY, TREE + " SELECT uuid, CAST((row_number() OVER (PARTITION BY layer ORDER BY name, uuid) - 1) AS BIGINT) AS index, CAST(floor((row_number() OVER (PARTITION BY layer ORDER BY name, uuid) - 1) / 96) AS BIGINT) AS batch_id FROM node")
def index_and_batches(spark, d):
    t = tree_tables(spark, d)
    nodes = graph.hierarchy_nodes(t["entities"], t["categories"]).withColumn("group_id", F.col("layer"))
    return hierarchy.batched(hierarchy.indexed(nodes), 96).select("uuid", F.col("index").cast("long").alias("index"), F.col("batch_id").cast("long").alias("batch_id"))


@register(REGISTRY, TREE + " SELECT CASE WHEN layer = 0 THEN 'entity' ELSE 'category' END AS kind, count(*) AS n FROM node GROUP BY ALL")
def entity_category_split(spark, d):
    t = tree_tables(spark, d)
    layer = F.when(F.col("layer") > 0, F.col("layer"))  # entities carry no layer
    parts = graph.split_layers(graph.hierarchy_nodes(t["entities"], t["categories"]).select(layer.alias("layer")))
    counts = [part.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, part in zip(("entity", "category"), parts)]
    return counts[0].unionByName(counts[1])
