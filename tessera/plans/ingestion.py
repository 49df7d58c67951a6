"""Ingesting turns into the graph, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import ingest, reflection, resolution, store
from tessera.operators.embedding_store import EmbeddingStore
from tessera.providers import EntityDetailer, Extractor
from tessera.stages import Stages


def in_batches(mentions: DataFrame, size: int) -> DataFrame:
    """Mentions with the batch of their turn, in first-seen order: the speaker first, if forced."""
    place = F.row_number().over(Window.partitionBy("group_id", "episode_uuid").orderBy("pos", "key"))
    return mentions.withColumn("batch_id", F.floor((place - 1) / size))


def ingest_turns(
    tables: dict[str, DataFrame], turns: DataFrame, extractor: Extractor, config: Config = Config(), details: DataFrame | None = None,
    detailer: EntityDetailer | None = None, vectors: EmbeddingStore | None = None, stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """The tables after a batch of turns: episodes, entities, mentions, edges. Turns that are complete already are left out.

    Names are extracted and, where the extractor can, reflected upon for ``config.reflection_rounds``;
    details are asked for in batches of a turn's entities, and facts only
    between entities of a batch (reflection sees them all). A turn with less
    than two entities has no facts.

    With ``vectors``, texts, names, summaries and facts get vectors, and names
    and facts mean near ones that are known or that earlier turns made, in the
    order of turns (see ``operators.resolution``). Without, only equal names
    and facts are the same.

    Repeating a batch changes nothing: ids come from natural keys. Steps that
    several plans read are written to ``stages``, and so are the results.
    """
    stages = stages or Stages(turns.sparkSession, "ingest")
    keep, rounds = stages.keep, config.reflection_rounds if hasattr(extractor, "reflect_names") else 0
    done = store.completed(tables["episodes"]).select("group_id", "source_id")
    turns = turns.join(done, ["group_id", "source_id"], "left_anti")
    if vectors is not None:
        turns = vectors.embed(turns, {"content": "episode_embedding"})
    episodes = keep("episodes", store.upsert_episodes(tables["episodes"], turns))
    # Turns keep the uuid under which they were first stored.
    turns = keep("turns", turns.drop("uuid").join(episodes.select("group_id", "source_id", "uuid"), ["group_id", "source_id"]))

    names = extractor.names(turns)
    if rounds:
        names = reflection.reflect(turns, names, extractor.reflect_names, reflection.by_name, rounds, stages)
    mentioned = keep("mentioned", ingest.entity_mentions(names, turns, config.force_speaker))
    if vectors is not None:
        resolved = resolution.resolve_in_order(mentioned, turns, tables["entities"], vectors.embedder, config.entity_match, stages)
    else:
        resolved = ingest.resolve_entities(mentioned, tables["entities"])
    resolved = keep("resolved", resolved)
    if detailer is not None:
        details = detailer.entity_details(in_batches(resolved, ingest.detail_batch_size(config.entity_detail_tokens)))
    if vectors is not None:
        new_entities = keep("new-entities", ingest.entity_rows(resolved, turns, tables["entities"], details))
        new_entities = vectors.embed(new_entities, {"name": "name_embedding", "summary": "summary_embedding"})
        entities = keep("entities", store.upsert(tables["entities"], new_entities, ["group_id", "uuid"]))
    else:
        entities = keep("entities", ingest.entity_rows(resolved, turns, tables["entities"], details, all_known=True))
    # The ends of these links exist: the entities and episodes have just been stored.
    new_links = resolved.select("group_id", F.col("uuid").alias("entity_uuid"), "episode_uuid")
    mentions = keep("mentions", tables["mentions"].unionByName(new_links).dropDuplicates(["group_id", "entity_uuid", "episode_uuid"]))

    able = resolved.withColumn("_n", F.count("*").over(Window.partitionBy("group_id", "episode_uuid"))).filter("_n >= 2").drop("_n")
    able = keep("able", able) if rounds else able
    found = extractor.edges(turns, in_batches(able, ingest.edge_batch_size(config.edge_tokens)))
    if rounds:
        asked = turns.join(able.select("group_id", F.col("episode_uuid").alias("uuid")), ["group_id", "uuid"], "left_semi")
        found = reflection.reflect(asked, found, lambda active, so_far, k: extractor.reflect_edges(active, able, so_far, k), reflection.by_fact, rounds, stages)
    found = ingest.distinct_edges(found)
    placed = ingest.placed_edges(found, resolved, entities, turns, keep)
    if vectors is not None:
        placed = resolution.fold_facts(keep("placed-edges", placed), tables["edges"], vectors.embedder, config.edge_match)
        rows = vectors.embed(keep("new-edges", ingest.latest_edges(placed)), {"fact": "fact_embedding"})
        edges = keep("edges", store.upsert_edges(tables["edges"], rows, entities))
    else:
        edges = keep("edges", ingest.latest_edges(placed, tables["edges"]))
    return {"episodes": keep("episodes-done", store.mark_ingested(episodes, turns)), "entities": entities, "mentions": mentions, "edges": edges}
