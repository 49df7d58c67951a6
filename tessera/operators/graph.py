"""Reads along the graph's links, batched over queries.

Seeds and parents are (query_id, group_id, uuid); the query side of each join
is the small one, and Spark broadcasts it when its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import packed, unpacked
from tessera.stages import Stages

from .fusion import sort_pool

#: A set of up to so many keys is broadcast.
FEW_KEYS = 20_000


def _matched() -> list:
    return [
        F.array_sort(F.collect_set("seed_uuid")).alias("matched_entity_uuids"),
        F.array_sort(F.collect_set("seed_name")).alias("matched_entity_names"),
        F.countDistinct("seed_uuid").alias("matched_entity_count"),
    ]


def _seeds(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    named = entities.select("group_id", F.col("uuid").alias("seed_uuid"), F.col("name").alias("seed_name"))
    return seeds.select("query_id", "group_id", F.col("uuid").alias("seed_uuid")).distinct().join(named, ["group_id", "seed_uuid"])


def expand_to_episodes(seeds: DataFrame, entities: DataFrame, mentions: DataFrame, episodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Episodes that mention a seed, with the seeds that matched; most matches first, then newest (null first)."""
    links = mentions.select("group_id", F.col("entity_uuid").alias("seed_uuid"), F.col("episode_uuid").alias("uuid"))
    found = _seeds(seeds, entities).join(links, ["group_id", "seed_uuid"]).groupBy("query_id", "group_id", "uuid").agg(*_matched())
    out = found.join(episodes.select("group_id", "uuid", "content", "valid_at", "source_id"), ["group_id", "uuid"])
    order = Window.partitionBy("query_id").orderBy(F.desc("matched_entity_count"), F.desc_nulls_first("valid_at"), "uuid")
    placed = out.withColumn("place", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def _undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("group_id", F.col("uuid").alias("edge_uuid"), "fact", "valid_at", "invalid_at", "source_uuid", "target_uuid")
    out = e.withColumns({"seed_uuid": F.col("source_uuid"), "neighbour_uuid": F.col("target_uuid")})
    back = e.filter("source_uuid <> target_uuid").withColumns({"seed_uuid": F.col("target_uuid"), "neighbour_uuid": F.col("source_uuid")})
    return out.unionByName(back)


def expand_to_edges(seeds: DataFrame, entities: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(edge, neighbour) rows around the seeds, whichever way the edge points; ``limit`` counts these rows."""
    around, row = _undirected(edges), ["query_id", "group_id", "edge_uuid", "neighbour_uuid"]
    order = Window.partitionBy("query_id").orderBy(F.desc("matched_entity_count"), F.desc_nulls_first("valid_at"), "edge_uuid", "neighbour_uuid")
    starts, shared = _seeds(seeds, entities), ["group_id", "seed_uuid"]
    if limit is not None:
        # Ids and times give the places; only the rows that stay get names and facts. A seed is one end, the neighbour the other.
        ids = starts.drop("seed_name").join(around.select(*shared, "edge_uuid", "neighbour_uuid", "valid_at"), shared)
        ids = ids.join(entities.select("group_id", F.col("uuid").alias("neighbour_uuid")), ["group_id", "neighbour_uuid"], "left_semi")
        ids = ids.groupBy(*row).agg(F.size(F.collect_set("seed_uuid")).alias("matched_entity_count"), F.first("valid_at").alias("valid_at"))
        best = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(*row)
        around, shared = around.join(best, row[1:]), ["query_id", *shared]
    found = starts.join(around, shared).groupBy(*row).agg(
        *_matched(), *[F.first(c).alias(c) for c in ("fact", "valid_at", "invalid_at", "source_uuid", "target_uuid")]
    )
    names = entities.select("group_id", "uuid", "name")
    for end in ("source", "target", "neighbour"):
        found = found.join(names.select("group_id", F.col("uuid").alias(f"{end}_uuid"), F.col("name").alias(f"{end}_name")), ["group_id", f"{end}_uuid"])
    placed = found.withColumn("place", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def distinct_last(expanded: DataFrame, key: str) -> DataFrame:
    """One row per query and ``key`` of an expansion: the last by place. For edge_uuid the edges, for neighbour_uuid the nodes."""
    order = Window.partitionBy("query_id", key).orderBy(F.desc("place"))
    return expanded.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def edge_pool(seeds: DataFrame, entities: DataFrame, edges: DataFrame, limit: int, stages: Stages | None = None) -> DataFrame:
    """The head of the pool of all edges around the seeds: query_id, uuid, matched_entity_count, place.

    The rows are those of ``sort_pool(distinct_last(expand_to_edges(seeds, entities, edges), "edge_uuid"), limit)``, but no query's
    edges are sorted whole. An edge row meets each of its ends once, by packed ids. If no other row has
    its uuid, it is one row of each query that has one of its ends as a seed, with one seed
    matched; only uuids of several rows are counted as the expansion does.
    """
    stages = stages or Stages(edges.sparkSession, "edge-pool")
    # Different uuids may have the same hash: then they are only counted the longer way.
    key = F.xxhash64("edge_uuid")
    twice = stages.keep("twice", edges.groupBy(F.xxhash64("uuid").alias("_key")).count().filter("count > 1").select("_key"))
    twice = F.broadcast(twice) if twice.count() <= FEW_KEYS else twice
    nodes = entities.select("group_id", packed(F.col("uuid")).alias("end"), F.lit(None).cast(dict(seeds.dtypes)["query_id"]).alias("query_id"))
    nodes = nodes.unionByName(_seeds(seeds, entities).select("group_id", packed(F.col("seed_uuid")).alias("end"), "query_id"))
    nodes = nodes.groupBy("group_id", "end").agg(F.collect_set("query_id").alias("asked"))
    rows = edges.select("group_id", F.col("uuid").alias("edge_uuid"), "valid_at", packed(F.col("source_uuid")).alias("source"), packed(F.col("target_uuid")).alias("target"))

    def met(rows: DataFrame) -> DataFrame:
        for end in ("source", "target"):
            rows = rows.join(nodes.withColumnsRenamed({"end": end, "asked": f"_{end}"}), ["group_id", end])
        return rows

    rows = rows.withColumn("_key", key)
    once = rows.join(twice, "_key", "left_anti").drop("_key", "valid_at").withColumn("edge_uuid", packed(F.col("edge_uuid")))
    once = met(once).select(F.explode(F.array_union("_source", "_target")).alias("query_id"), unpacked(F.col("edge_uuid")).alias("uuid"), F.lit(1).cast("long").alias("matched_entity_count"))
    more = met(rows.join(twice, "_key", "left_semi"))
    out = more.select("group_id", "edge_uuid", "valid_at", F.explode("_source").alias("query_id"), F.col("source").alias("seed"), F.col("target").alias("neighbour"))
    back = more.filter("source <> target").select("group_id", "edge_uuid", "valid_at", F.explode("_target").alias("query_id"), F.col("target").alias("seed"), F.col("source").alias("neighbour"))
    more = out.unionByName(back).groupBy("query_id", "group_id", "edge_uuid", "neighbour").agg(F.countDistinct("seed").alias("n"), F.first("valid_at").alias("valid_at"))
    last = Window.partitionBy("query_id", "edge_uuid").orderBy("n", F.asc_nulls_last("valid_at"), F.desc(unpacked(F.col("neighbour"))))
    more = more.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("query_id", F.col("edge_uuid").alias("uuid"), F.col("n").alias("matched_entity_count"))
    return sort_pool(once.unionByName(more), limit).select("query_id", "uuid", "matched_entity_count", "place")


def one_hop(nodes: DataFrame, entities: DataFrame, mentions: DataFrame, episodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Distinct episodes, edges and neighbour nodes next to ``nodes`` (query_id, group_id, uuid)."""
    start = nodes.select("query_id", "group_id", F.col("uuid").alias("seed_uuid")).distinct()
    near = start.join(mentions.select("group_id", F.col("entity_uuid").alias("seed_uuid"), F.col("episode_uuid").alias("uuid")), ["group_id", "seed_uuid"])
    near = near.select("query_id", "group_id", "uuid").distinct()
    around = start.join(_undirected(edges), ["group_id", "seed_uuid"])
    return {
        "episodes": near.join(episodes.select("group_id", "uuid", "content", "valid_at", "source_id"), ["group_id", "uuid"]),
        "edges": around.select("query_id", "group_id", F.col("edge_uuid").alias("uuid"), "fact", "valid_at", "invalid_at", "source_uuid", "target_uuid").distinct(),
        "nodes": around.select("query_id", "group_id", F.col("neighbour_uuid").alias("uuid")).distinct().join(entities.select("group_id", "uuid", "name", "summary", "tag"), ["group_id", "uuid"]),
    }


def hierarchy_nodes(entities: DataFrame, categories: DataFrame) -> DataFrame:
    """Entities (layer 0) and categories as one table of nodes."""
    columns = ("group_id", "uuid", "name", "tag")
    return entities.select(*columns, F.lit(0).alias("layer")).unionByName(categories.select(*columns, F.col("layer").cast("int").alias("layer")))


def children(parents: DataFrame, categorizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct children of ``parents``: query_id, group_id, uuid, name, tag, layer."""
    links = categorizes.select("group_id", F.col("parent_uuid").alias("uuid"), "child_uuid")
    found = parents.select("query_id", "group_id", "uuid").join(links, ["group_id", "uuid"]).select("query_id", "group_id", F.col("child_uuid").alias("uuid")).distinct()
    return found.join(nodes.select("group_id", "uuid", "name", "tag", "layer"), ["group_id", "uuid"])


def reachable(parents: DataFrame, categorizes: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Everything one or more links below ``parents``, however deep and in whatever shape: query_id, group_id, uuid.

    Semi-naive: a step follows only the nodes that the step before reached for
    the first time, and it ends when there are none. Each step's new nodes are
    written, so every step's plan has the same size, and cycles end.
    """
    stages = stages or Stages(parents.sparkSession, "reachable")
    links = categorizes.select("group_id", F.col("parent_uuid").alias("uuid"), "child_uuid")
    frontier, reached = parents.select("query_id", "group_id", "uuid").distinct(), None
    while True:
        below = frontier.join(links, ["group_id", "uuid"]).select("query_id", "group_id", F.col("child_uuid").alias("uuid")).distinct()
        frontier = stages.keep("frontier", below if reached is None else below.join(reached, ["query_id", "group_id", "uuid"], "left_anti"))
        if frontier.isEmpty():
            return frontier if reached is None else reached
        # Steps so far are read as one folder list, so the plan does not grow.
        reached = frontier if reached is None else parents.sparkSession.read.schema(frontier.schema).parquet(*reached.inputFiles(), *frontier.inputFiles())


def descendants(parents: DataFrame, categorizes: DataFrame, nodes: DataFrame, max_depth: int | None = None, stages: Stages | None = None) -> DataFrame:
    """Distinct nodes one or more links below ``parents``.

    A caller that knows how many layers there can be gives ``max_depth`` and
    gets one lazy plan of so many joins; else the closure is followed to its end (``reachable``).
    """
    if max_depth is None:
        reached = reachable(parents, categorizes, stages)
    else:
        links = categorizes.select("group_id", F.col("parent_uuid").alias("uuid"), "child_uuid")
        frontier, reached = parents.select("query_id", "group_id", "uuid").distinct(), None
        for _ in range(max_depth):
            frontier = frontier.join(links, ["group_id", "uuid"]).select("query_id", "group_id", F.col("child_uuid").alias("uuid")).distinct()
            reached = frontier if reached is None else reached.unionByName(frontier)
    return reached.distinct().join(nodes.select("group_id", "uuid", "name", "tag", "layer"), ["group_id", "uuid"])


def descendant_entities(parents: DataFrame, categorizes: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The leaves below ``parents``; parents that are entities themselves have none."""
    starts = parents.join(nodes.filter("layer > 0").select("group_id", "uuid"), ["group_id", "uuid"], "left_semi")
    return descendants(starts, categorizes, nodes, max_depth).filter("layer = 0")


def max_layer(categories: DataFrame, groups: DataFrame) -> DataFrame:
    """The top layer of each group, 0 without categories."""
    top = categories.groupBy("group_id").agg(F.max("layer").alias("top"))
    return groups.select("group_id").distinct().join(top, "group_id", "left").select("group_id", F.coalesce("top", F.lit(0)).cast("int").alias("max_layer"))


def matched_selections(found: DataFrame) -> DataFrame:
    """The rows of ``resolve_selections`` that have a node.

    Those without one are left out, unless none of a query's selections has
    one: that is an error, raised when the rows are computed. A query without
    selections has no rows and is none.
    """
    counts = found.groupBy("query_id").agg(F.count("node_uuid").alias("_matched"))
    message = F.concat(F.lit("no selection matches a node for query "), F.col("query_id").cast("string"))
    rows = found.join(counts, "query_id").withColumn("node_uuid", F.when(F.col("_matched") == 0, F.raise_error(message)).otherwise(F.col("node_uuid")).cast("string"))
    return rows.filter("node_uuid IS NOT NULL").drop("_matched")


def resolve_selections(selections: DataFrame, nodes: DataFrame) -> DataFrame:
    """Selections (query_id, group_id, uuid, name, ...) to nodes: by uuid, else by name (the last of equal names, by ``seq``), else null.

    The node is in node_uuid; rows where it is null are unmatched.
    """
    by_name = nodes.groupBy("group_id", F.col("name").alias("name")).agg(F.max_by("uuid", "seq").alias("_by_name"))
    by_uuid = nodes.select("group_id", "uuid", F.col("uuid").alias("_by_uuid")).distinct()
    found = selections.join(by_uuid, ["group_id", "uuid"], "left").join(by_name, ["group_id", "name"], "left")
    return found.withColumn("node_uuid", F.coalesce("_by_uuid", "_by_name")).drop("_by_uuid", "_by_name")


def with_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends; those without both in the group go."""
    names = entities.select("group_id", "uuid", "name")
    for end in ("source", "target"):
        edges = edges.join(names.select("group_id", F.col("uuid").alias(f"{end}_uuid"), F.col("name").alias(f"{end}_name")), ["group_id", f"{end}_uuid"])
    return edges


def split_layers(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities, whose layer is 0 or null, and categories."""
    layer = F.coalesce("layer", F.lit(0))
    return nodes.filter(layer == 0), nodes.filter(layer != 0)
