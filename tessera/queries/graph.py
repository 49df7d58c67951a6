"""Graph reads: expansion, one hop, hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, store

from .base import GRAPH, TREE, graph_tables, register, table, tree_tables

REGISTRY: dict = {}

# Seeds: all entities; one query per group.
SEEDS = GRAPH.rstrip() + """, seed AS (SELECT group_id AS query_id, group_id, uuid, name FROM ent)"""
EPISODES = SEEDS + """, xe AS (
  SELECT s.query_id, m.episode_uuid AS uuid, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS names, count(DISTINCT s.uuid) AS matched_entity_count
  FROM seed s JOIN men m ON m.group_id = s.group_id AND m.entity_uuid = s.uuid GROUP BY ALL),
xr AS (SELECT xe.*, ep.source_id, ep.valid_at, row_number() OVER (PARTITION BY query_id ORDER BY matched_entity_count DESC, ep.valid_at DESC NULLS FIRST, xe.uuid) AS place FROM xe JOIN ep ON ep.uuid = xe.uuid)
"""
EDGES = SEEDS + """, und AS (
  SELECT group_id, uuid AS edge_uuid, fact, valid_at, source_uuid, target_uuid, source_uuid AS seed_uuid, target_uuid AS neighbour_uuid FROM rel
  UNION ALL SELECT group_id, uuid, fact, valid_at, source_uuid, target_uuid, target_uuid, source_uuid FROM rel WHERE source_uuid <> target_uuid),
xg AS (SELECT s.query_id, u.edge_uuid, u.neighbour_uuid, u.fact, u.valid_at, u.source_uuid, u.target_uuid, count(DISTINCT s.uuid) AS matched_entity_count
  FROM seed s JOIN und u ON u.group_id = s.group_id AND u.seed_uuid = s.uuid GROUP BY ALL),
xp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched_entity_count DESC, valid_at DESC NULLS FIRST, edge_uuid, neighbour_uuid) AS place FROM xg)
"""


def seeds(g):
    return g["entities"].select(F.col("group_id").alias("query_id"), "group_id", "uuid", "name")


@register(REGISTRY, EPISODES + "SELECT query_id, uuid, names, matched_entity_count, CAST(place AS BIGINT) AS place FROM xr WHERE place <= 20")
def expand_entity_episodes(spark, d):
    g = graph_tables(spark, d)
    found = graph.expand_to_episodes(seeds(g), g["entities"], g["mentions"], g["episodes"], 20)
    return found.select("query_id", "uuid", F.array_join("matched_entity_names", ",").alias("names"), "matched_entity_count", F.col("place").cast("long").alias("place"))


def edge_expansion(g, limit=40):
    return graph.expand_to_edges(seeds(g), g["entities"], g["edges"], limit)


@register(REGISTRY, EDGES + "SELECT query_id, edge_uuid, neighbour_uuid, fact, matched_entity_count, CAST(place AS BIGINT) AS place FROM xp WHERE place <= 40")
def expand_entity_edges(spark, d):
    return edge_expansion(graph_tables(spark, d)).select("query_id", "edge_uuid", "neighbour_uuid", "fact", "matched_entity_count", F.col("place").cast("long").alias("place"))


@register(REGISTRY, EDGES + "SELECT query_id, edge_uuid, arg_max(neighbour_uuid, place) AS neighbour_uuid FROM xp WHERE place <= 40 GROUP BY ALL")
def expansion_distinct_edges(spark, d):
    return graph.distinct_last(edge_expansion(graph_tables(spark, d)), "edge_uuid").select("query_id", "edge_uuid", "neighbour_uuid")


@register(REGISTRY, EDGES + "SELECT query_id, neighbour_uuid, arg_max(edge_uuid, place) AS edge_uuid FROM xp WHERE place <= 40 GROUP BY ALL")
def expansion_distinct_nodes(spark, d):
    return graph.distinct_last(edge_expansion(graph_tables(spark, d)), "neighbour_uuid").select("query_id", "neighbour_uuid", "edge_uuid")


@register(REGISTRY, SEEDS + "SELECT DISTINCT s.query_id, ep.uuid, ep.source_id FROM seed s JOIN men m ON m.entity_uuid = s.uuid AND m.group_id = s.group_id JOIN ep ON ep.uuid = m.episode_uuid")
def one_hop_episodes(spark, d):
    g = graph_tables(spark, d)
    return graph.one_hop(seeds(g), g["entities"], g["mentions"], g["episodes"], g["edges"])["episodes"].select("query_id", "uuid", "source_id")


@register(REGISTRY, SEEDS + "SELECT DISTINCT s.query_id, r.uuid, r.fact FROM seed s JOIN rel r ON r.group_id = s.group_id AND s.uuid IN (r.source_uuid, r.target_uuid)")
def one_hop_edges(spark, d):
    g = graph_tables(spark, d)
    return graph.one_hop(seeds(g), g["entities"], g["mentions"], g["episodes"], g["edges"])["edges"].select("query_id", "uuid", "fact")


@register(REGISTRY, SEEDS + """SELECT DISTINCT s.query_id, e.uuid, e.name FROM seed s JOIN rel r ON r.group_id = s.group_id AND s.uuid IN (r.source_uuid, r.target_uuid)
JOIN ent e ON e.uuid = CASE WHEN s.uuid = r.source_uuid THEN r.target_uuid ELSE r.source_uuid END""")
def one_hop_nodes(spark, d):
    g = graph_tables(spark, d)
    return graph.one_hop(seeds(g), g["entities"], g["mentions"], g["episodes"], g["edges"])["nodes"].select("query_id", "uuid", "name")


@register(REGISTRY, GRAPH + "SELECT r.uuid, s.name AS source_name, t.name AS target_name FROM rel r JOIN ent s ON s.uuid = r.source_uuid JOIN ent t ON t.uuid = r.target_uuid")
def edge_endpoints(spark, d):
    g = graph_tables(spark, d)
    return graph.with_endpoints(g["edges"], g["entities"]).select("uuid", "source_name", "target_name")


def parents(t):
    """Regions, each a query of its own, and nation 3."""
    rows = t["categories"].filter("layer = 2 OR uuid = 'n3'")
    return rows.select(F.col("uuid").alias("query_id"), "group_id", "uuid")


_PARENTS = TREE.rstrip() + ", start AS (SELECT uuid FROM node WHERE layer = 2 OR uuid = 'n3'), down AS (SELECT s.uuid AS query_id, l.child AS uuid FROM start s JOIN link l ON l.parent = s.uuid UNION ALL SELECT query_id, l.child FROM down JOIN link l ON l.parent = down.uuid)"


@register(REGISTRY, _PARENTS + " SELECT DISTINCT s.uuid AS query_id, n.uuid, n.name, CAST(n.layer AS BIGINT) AS layer FROM start s JOIN link l ON l.parent = s.uuid JOIN node n ON n.uuid = l.child")
def child_nodes(spark, d):
    t = tree_tables(spark, d)
    found = graph.children(parents(t), t["categorizes"], graph.hierarchy_nodes(t["entities"], t["categories"]))
    return found.select("query_id", "uuid", "name", F.col("layer").cast("long").alias("layer"))


@register(REGISTRY, _PARENTS + " SELECT DISTINCT query_id, n.uuid, n.name, CAST(n.layer AS BIGINT) AS layer FROM down JOIN node n USING (uuid)")
def all_descendants(spark, d):
    t = tree_tables(spark, d)
    found = graph.descendants(parents(t), t["categorizes"], graph.hierarchy_nodes(t["entities"], t["categories"]))
    return found.select("query_id", "uuid", "name", F.col("layer").cast("long").alias("layer"))


@register(REGISTRY, _PARENTS + " SELECT DISTINCT query_id, n.uuid, n.name FROM down JOIN node n USING (uuid) WHERE layer = 0")
def descendant_entities(spark, d):
    t = tree_tables(spark, d)
    return graph.descendant_entities(parents(t), t["categorizes"], graph.hierarchy_nodes(t["entities"], t["categories"])).select("query_id", "uuid", "name")


@register(REGISTRY, TREE + " SELECT 'tpch' AS group_id, CAST(coalesce(max(layer), 0) AS BIGINT) AS max_layer FROM node UNION ALL SELECT 'empty', 0")
def max_layer(spark, d):
    t = tree_tables(spark, d)
    groups = t["categories"].select("group_id").distinct().union(spark.sql("SELECT 'empty'"))
    return graph.max_layer(t["categories"], groups).select("group_id", F.col("max_layer").cast("long").alias("max_layer"))


@register(REGISTRY, TREE + " SELECT uuid, name, CAST(layer AS BIGINT) AS layer FROM node WHERE layer IN (0, 1)")
def nodes_by_layer(spark, d):
    t = tree_tables(spark, d)
    both = [store.nodes_of_layer(t["entities"], t["categories"], "tpch", k) for k in (0, 1)]
    return both[0].unionByName(both[1]).select("uuid", "name", F.col("layer").cast("long").alias("layer"))


@register(REGISTRY, GRAPH + "SELECT uuid, name, summary, is_speaker FROM ent WHERE group_id = 'g3'")
def layer_zero_nodes(spark, d):
    return store.layer_zero_nodes(graph_tables(spark, d)["entities"], "g3").select("uuid", "name", "summary", "is_speaker")


@register(REGISTRY, GRAPH + "SELECT e.group_id, e.name, e.uuid FROM ent e JOIN (SELECT DISTINCT group_id, name FROM tok) n USING (group_id, name)")
def entities_by_name(spark, d):
    from .base import episode_tokens

    wanted = episode_tokens(spark, d).select("group_id", "name")
    return store.entities_by_name(graph_tables(spark, d)["entities"], wanted).select("group_id", "name", "uuid")


@register(REGISTRY, TREE.rstrip() + """, sel AS (SELECT 'c' || c_custkey AS uuid, 'nobody' AS name FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT 'lost' AS uuid, n_name AS name FROM nation UNION ALL SELECT 'lost2', 'nobody')
SELECT sel.uuid, sel.name, coalesce(a.uuid, b.uuid) AS node_uuid FROM sel LEFT JOIN node a ON a.uuid = sel.uuid LEFT JOIN (SELECT name, max(uuid) AS uuid FROM node GROUP BY ALL) b ON b.name = sel.name""")
def resolve_selections(spark, d):
    t = tree_tables(spark, d)
    nodes = graph.hierarchy_nodes(t["entities"], t["categories"]).withColumn("seq", F.col("uuid"))
    q, g = F.lit("q").alias("query_id"), F.lit("tpch").alias("group_id")
    wanted = table(spark, d, "customer").filter("c_custkey % 20 = 0").select(q, g, F.concat(F.lit("c"), "c_custkey").alias("uuid"), F.lit("nobody").alias("name"))
    wanted = wanted.unionByName(table(spark, d, "nation").select(q, g, F.lit("lost").alias("uuid"), F.col("n_name").alias("name"))).unionByName(spark.sql("SELECT 'q' AS query_id, 'tpch' AS group_id, 'lost2' AS uuid, 'nobody' AS name"))
    return graph.resolve_selections(wanted, nodes).select("uuid", "name", "node_uuid")
