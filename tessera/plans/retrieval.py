"""Retrieval over many queries at once: two routes, their merge, reranking and the context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import shown_timestamp
from tessera.operators import evaluate, fusion, graph, search
from tessera.providers import LayerSelector, Reranker
from tessera.stages import Keep, Stages, as_it_is

ITEMS = ("episodes", "nodes", "edges")


def candidates(index: search.TextIndex, rows: DataFrame, vector: str | None, queries: DataFrame, limit: int, k: int) -> DataFrame:
    """Fused text and vector hits; text alone where the rows or the queries have no vectors."""
    if vector and vector in rows.columns and "vector" in queries.columns:
        return search.hybrid_search(index, rows, vector, queries, limit, k)
    hits = search.fulltext_search(index, queries, limit).withColumn("list_no", F.lit(0))
    return fusion.fuse_ranked(hits, limit, k)


def text_indexes(tables: dict[str, DataFrame]) -> dict[str, search.TextIndex]:
    """The text indexes that the first route asks: names and summaries of entities, contents of episodes."""
    text = F.concat_ws(" ", "name", F.coalesce("summary", F.lit("")))
    return {"entities": search.build_text_index(tables["entities"], text), "episodes": search.build_text_index(tables["episodes"], F.col("content"))}


def system1(tables: dict[str, DataFrame], queries: DataFrame, config: Config = Config(), last_wins: bool = False, keep: Keep = as_it_is, indexes: dict[str, search.TextIndex] | None = None) -> dict[str, DataFrame]:
    """Entities near the query, their episodes, facts and neighbours, and the episodes near the query itself.

    ``keep`` gets every step that more than one plan reads. ``indexes`` has
    the text indexes of entities and episodes, where they are there already.
    """
    indexes = indexes or text_indexes(tables)
    limit, k = config.candidate_limit, config.rrf_k
    entities, episodes = tables["entities"], tables["episodes"]
    seeds = keep("seeds", candidates(indexes["entities"], entities, "summary_embedding", queries, limit, k))
    group = queries.select("query_id", "group_id")
    start = seeds.select("query_id", "uuid").join(group, "query_id")

    near_episodes = fusion.propagate_scores(graph.expand_to_episodes(start, entities, tables["mentions"], episodes, limit), seeds)
    near_edges = keep("near-edges", graph.expand_to_edges(start, entities, tables["edges"], limit))
    edges = graph.distinct_last(near_edges, "edge_uuid").withColumnRenamed("edge_uuid", "uuid")
    nodes = graph.distinct_last(near_edges, "neighbour_uuid").select("query_id", F.col("neighbour_uuid").alias("uuid"), "matched_entity_uuids", "matched_entity_count")
    edges, nodes = fusion.propagate_scores(edges, seeds), fusion.propagate_scores(nodes, seeds)

    direct = candidates(indexes["episodes"], episodes, "episode_embedding", queries, limit, k)
    direct = direct.join(group, "query_id").join(episodes.select("group_id", "uuid", "content", "valid_at", "source_id"), ["group_id", "uuid"])
    named = entities.select("group_id", "uuid", "name", "summary", "tag")

    def pool(*lists: DataFrame) -> DataFrame:
        rows = None
        for seq, part in enumerate(lists):
            part = part.drop("place", "rank", "group_id", "matched_entity_uuids", "matched_entity_names").withColumn("seq", F.lit(seq))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return fusion.sort_pool(fusion.merge_by_uuid(rows, "seq", last_wins=last_wins), limit)

    with_names = lambda df: df.drop("group_id").join(group, "query_id").join(named, ["group_id", "uuid"])
    return {
        "episodes": pool(fusion.annotate(near_episodes, "entity_expansion"), fusion.annotate(direct, "direct_episode")),
        "nodes": pool(fusion.annotate(with_names(seeds), "entity_candidates"), fusion.annotate(with_names(nodes), "entity_expansion")),
        "edges": pool(fusion.annotate(edges, "entity_expansion")),
    }


def layer_walk(tables: dict[str, DataFrame], queries: DataFrame, selector: LayerSelector, top: int, mode: str = "faithful", leaf_resolution: bool = True, keep: Keep = as_it_is) -> DataFrame:
    """The nodes that a walk down the hierarchy selects: query_id, group_id, uuid.

    Each group is entered at its own highest layer; ``top`` is the highest of
    all, and groups above it are entered there. At each layer the selector chooses among the candidates. A choice with all
    children takes every entity below it; another is a parent of the next
    layer's candidates. At the end every chosen category stands for the
    entities below it. Modes: ``faithful`` keeps that for all chosen
    categories, however far the walk went on below them; ``narrowing`` only
    for those whose children offered nothing to choose. Without
    ``leaf_resolution`` categories stay categories.

    The loop is over layers; each adds joins to one lazy plan, or with ``keep``
    starts from the written choices of the layer above.
    """
    if mode not in ("faithful", "narrowing"):
        raise ValueError(f"unknown walk mode {mode!r}")
    nodes, links = graph.hierarchy_nodes(tables["entities"], tables["categories"]), tables["categorizes"]
    group = queries.select("query_id", "group_id")
    tops = tables["categories"].filter(F.col("layer") <= top).groupBy("group_id").agg(F.max("layer").alias("_top"))
    entries = nodes.join(tops, "group_id").filter(F.col("layer") == F.col("_top")).join(group, "group_id").select("query_id", "group_id", "uuid", "name", "tag", "layer")
    current = entries.filter(F.col("layer") == top)
    keys = ("query_id", "group_id", "uuid")
    chosen, parents = [], None
    for layer in range(top, 0, -1):
        picked = keep(f"picked-{layer}", selector.select(current, queries))
        taken = picked.filter("get_all_children")
        plain = picked.filter("NOT get_all_children")
        chosen.append(picked.filter("layer = 0").select(*keys))
        if leaf_resolution:
            chosen.append(graph.descendants(taken.filter("layer > 0"), links, nodes, top).filter("layer = 0").select(*keys))
        else:
            chosen.append(graph.descendants(taken, links, nodes, top).select(*keys))
        categories = plain.filter("layer > 0") if leaf_resolution else plain
        resolve = categories
        if mode == "narrowing" and layer > 1:
            offered = graph.children(categories, links, nodes)
            next_picked = selector.select(offered, queries).select("query_id", F.col("uuid").alias("_child"))
            drilled = categories.join(links.select("group_id", F.col("parent_uuid").alias("uuid"), F.col("child_uuid").alias("_child")), ["group_id", "uuid"]).join(next_picked, ["query_id", "_child"], "left_semi")
            resolve = categories.join(drilled.select(*keys).distinct(), list(keys), "left_anti")
        if leaf_resolution:
            chosen.append(graph.descendant_entities(resolve, links, nodes, top).select(*keys))
        else:
            chosen.append(resolve.select(*keys))
        parents = categories
        current = graph.children(parents, links, nodes).select(*entries.columns).unionByName(entries.filter(F.col("layer") == layer - 1)).distinct()
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return keep("selected", out.distinct())


def system2(tables: dict[str, DataFrame], queries: DataFrame, selector: LayerSelector, top: int, mode: str = "faithful", leaf_resolution: bool = True, keep: Keep = as_it_is) -> dict[str, DataFrame]:
    """What one hop around the walk's nodes holds, and the nodes."""
    selected = layer_walk(tables, queries, selector, top, mode, leaf_resolution, keep)
    near = graph.one_hop(selected, tables["entities"], tables["mentions"], tables["episodes"], tables["edges"])
    own = graph.hierarchy_nodes(tables["entities"], tables["categories"]).select("group_id", "uuid", "name")
    summaries = tables["entities"].select("group_id", "uuid", "summary", "tag")
    nodes = selected.unionByName(near["nodes"].select("query_id", "group_id", "uuid")).distinct().join(own, ["group_id", "uuid"]).join(summaries, ["group_id", "uuid"], "left")
    return {"episodes": near["episodes"], "edges": near["edges"], "nodes": nodes}


def candidate_text(kind: str) -> Column:
    """What a reranker reads of an item."""
    if kind == "episodes":
        return F.concat(F.lit("["), F.coalesce(shown_timestamp(F.col("valid_at")), F.lit("unknown")), F.lit("] "), F.coalesce("content", F.lit("")))
    if kind == "nodes":
        return F.to_json(F.struct("name", "tag", "summary"), {"ignoreNullFields": "false"})
    return F.to_json(F.struct("fact", shown_timestamp(F.col("valid_at")).alias("valid_at"), shown_timestamp(F.col("invalid_at")).alias("invalid_at")), {"ignoreNullFields": "false"})


def render_context(final: DataFrame) -> DataFrame:
    """The context text of each query: NODES, EDGES and EPISODES as lines in order; empty sections are left out.

    final: query_id, item_type, place, line.
    """
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    section = final.groupBy("query_id", "item_type").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    mark = F.upper("item_type")
    section = section.withColumn("body", F.concat(F.lit("<"), mark, F.lit(">\n"), "body", F.lit("\n</"), mark, F.lit(">")))
    rank = F.when(F.col("item_type") == "nodes", 0).when(F.col("item_type") == "edges", 1).otherwise(2)
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("k"), "body")))
    return section.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n").alias("context"))


def item_counts(ranked: dict[str, DataFrame], tops: dict[str, int]) -> DataFrame:
    """The rows of each query and item type at each step, told from the ranked rows alone: they say which routes found them."""
    steps: dict[str, DataFrame] = {}
    for kind, rows in ranked.items():
        rows = rows.select("query_id", F.lit(kind).alias("item_type"), "uuid", "from_system1", "from_system2", (F.col("place") <= tops[kind]).alias("final"))
        raw = rows.filter("from_system1").withColumn("route", F.lit("1")).unionByName(rows.filter("from_system2").withColumn("route", F.lit("2")))
        for step, part in (("raw", raw), ("merged", rows), ("final", rows.filter("final"))):
            steps[step] = part if step not in steps else steps[step].unionByName(part)
    return evaluate.counts_block(steps["raw"], steps["merged"], steps["merged"], steps["final"])


def retrieve(tables: dict[str, DataFrame], queries: DataFrame, selector: LayerSelector, reranker: Reranker, top: int, config: Config = Config(), mode: str = "faithful", stages: Stages | None = None) -> dict[str, DataFrame]:
    """Both routes merged, reranked and cut per item type; with the counts of each step and the context text.

    Staged: what several plans read is written once (``stages``), so no plan
    holds another's, and steps that do not need each other run together. The
    stages are the postings of both text indexes, the seeds and the facts
    around them, the walk's choices, and for each item type its merged pool
    and its ranked rows, from which all results are read. Tables and queries
    should be stored ones: they are read several times.
    """
    stages = stages or Stages(queries.sparkSession, "retrieve")
    keep = stages.keep
    postings = stages.keep_all({name: index.postings for name, index in text_indexes(tables).items()})
    indexes = {name: search.index_of(rows) for name, rows in postings.items()}
    one, two = system1(tables, queries, config, keep=keep, indexes=indexes), system2(tables, queries, selector, top, mode, keep=keep)
    tops = {"episodes": config.episode_top_k, "nodes": config.node_top_k, "edges": config.edge_top_k}
    context = None
    pools = stages.keep_all({kind: fusion.merge_routes(one[kind], two[kind]).withColumn("candidate_text", candidate_text(kind)) for kind in ITEMS})
    ranked = stages.keep_all({kind: fusion.rerank(pool, reranker.scores(pool, queries), 1 << 30) for kind, pool in pools.items()})
    out = {kind: rows.filter(F.col("place") <= tops[kind]) for kind, rows in ranked.items()}
    for kind, rows in out.items():
        lines = rows.select("query_id", F.lit(kind).alias("item_type"), "place", F.col("candidate_text").alias("line"))
        context = lines if context is None else context.unionByName(lines)
    return out | {"counts": item_counts(ranked, tops), "context": render_context(context)}


def prompt_payload(nodes: DataFrame, columns: tuple[str, ...] = ("uuid", "name", "tag")) -> DataFrame:
    """The candidates of each query as JSON lines in the order of names, with the columns that are configured."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    ordered = F.array_sort(F.collect_list(F.struct("name", "uuid", line.alias("line"))))
    return nodes.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("payload"))


def places(items: DataFrame, by: str = "query_id") -> DataFrame:
    return items.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("uuid")))
