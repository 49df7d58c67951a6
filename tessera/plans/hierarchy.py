"""Building the hierarchy layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import stable_id
from tessera.operators import hierarchy
from tessera.providers import BatchCategorizer, Categorizer, Detailer, assigned_in_order


def build(entities: DataFrame, categorizer: Categorizer | BatchCategorizer, config: Config = Config(), detailer: Detailer | None = None) -> tuple[DataFrame, DataFrame]:
    """Categories and their links for all groups of ``entities``.

    The categoriser gets the nodes of a layer in batches (``batch_id``) of
    ``config.assign_batch``, one after another with the names so far where it
    assigns by batches (``BatchCategorizer``); the detailer gets the accepted categories in
    batches of ``config.detail_batch``, and those that it does not describe
    keep the fallback. A group's layer that breaks a constraint is dropped and the group stops
    there; its earlier layers stay. Lineage is cut by a checkpoint per layer,
    so a lost executor costs one layer at most.
    """
    nodes = entities.select("group_id", "uuid", "name", F.coalesce("tag", F.array().cast("array<string>")).alias("tag"), F.coalesce("is_speaker", F.lit(False)).alias("is_speaker"))
    categories = links = None
    for layer in range(1, config.max_layers + 1):
        current = hierarchy.indexed(nodes)
        asked = hierarchy.batched(current, config.assign_batch)
        assigned = assigned_in_order(asked, layer, categorizer) if hasattr(categorizer, "assign_batch") else categorizer.assign(asked, layer)
        members = hierarchy.materialize_layer(assigned, current, layer, config.min_children, config.speaker_mode)
        made = hierarchy.layer_categories(members, current)
        good = hierarchy.check_layer(made, current, layer, config.min_children).filter("accepted")
        made = made.join(good.select("group_id"), "group_id", "left_semi")
        if detailer:
            described = hierarchy.batched(made, config.detail_batch, order=("category",))
            made = hierarchy.with_details(made, detailer.details(described, layer))
        made = made.withColumn("uuid", stable_id("category", F.col("group_id"), F.lit(layer), F.col("category"))).checkpoint()
        if made.isEmpty():
            break
        rows = made.select("group_id", "uuid", F.col("category").alias("name"), "summary", "tag", F.lit(layer).alias("layer"))
        edges = made.select("group_id", F.col("uuid").alias("parent_uuid"), F.explode("children").alias("child_uuid"))
        categories = rows if categories is None else categories.unionByName(rows)
        links = edges if links is None else links.unionByName(edges)
        nodes = rows.select("group_id", "uuid", "name", "tag", F.lit(False).alias("is_speaker"))
    if categories is None:
        empty = entities.sparkSession
        return empty.createDataFrame([], "group_id string, uuid string, name string, summary string, tag array<string>, layer int"), empty.createDataFrame([], "group_id string, parent_uuid string, child_uuid string")
    return categories, links
