"""One layer of the category hierarchy: filtering assignments, promotion, the Speaker bucket, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.stages import Stages

from .ordered import numbered

SPEAKER = "Speaker"
#: Names that mean a speaker where speakers are told by name.
SPEAKER_NAMES = ("user", "i", "me")


def is_reserved_speaker(layer: int, mode: str) -> Column:
    """Nodes that only the Speaker bucket may hold; at layer 1 only. Modes: paper_v2, appendix_prompt, disabled."""
    if layer != 1 or mode == "disabled":
        return F.lit(False)
    if mode == "paper_v2":
        return F.coalesce(F.col("is_speaker"), F.lit(False))
    if mode == "appendix_prompt":
        return F.lower(F.trim("name")).isin(*SPEAKER_NAMES)
    raise ValueError(f"unknown speaker mode {mode!r}")


def speaker_note(mode: str) -> str:
    """What a categoriser is told about speakers."""
    return {
        "paper_v2": "Nodes that are speakers are kept apart; do not categorise them.",
        "appendix_prompt": "Put the user and first-person names in a category named Speaker only.",
        "disabled": "",
    }[mode]


def is_valid_name(c: Column) -> Column:
    """Not blank, and no two things joined by the word ``and``."""
    return (F.trim(c) != "") & ~F.concat(F.lit(" "), F.lower(c), F.lit(" ")).contains(" and ")


def assigned_members(assignments: DataFrame, nodes: DataFrame, min_children: int) -> DataFrame:
    """Valid assignments as (group_id, category, pos, uuid).

    assignments: group_id, row_no, category, indexes. nodes: group_id, index,
    uuid. Unknown indexes are ignored, repeated ones count once in their first
    place, and a row with fewer than ``min_children`` nodes is dropped, before
    rows of the same name are joined.
    """
    rows = assignments.filter(is_valid_name(F.col("category"))).select("group_id", "row_no", F.trim("category").alias("category"), F.posexplode("indexes").alias("at", "index"))
    rows = rows.join(nodes.select("group_id", "index", "uuid"), ["group_id", "index"])
    rows = rows.groupBy("group_id", "row_no", "category", "uuid").agg(F.min("at").alias("at"))
    size = F.count("*").over(Window.partitionBy("group_id", "row_no"))
    rows = rows.withColumn("_size", size).filter(F.col("_size") >= min_children)
    return rows.select("group_id", "category", F.struct("row_no", "at").alias("pos"), "uuid")


def promoted_names(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """Names for uncovered ``nodes`` (group_id, index, uuid, name): their own, else with a mark.

    A name is free if no category in ``taken`` (group_id, category) and no
    earlier node has it; then "(Promoted)", "(Promoted 2)" and so on follow.
    """
    names = taken.select("group_id", "category").unionByName(nodes.select("group_id", F.col("name").alias("category"))).distinct()
    marked = r"^(.*) \(Promoted(?: (\d+))?\)$"
    number = F.when(F.regexp_extract("category", marked, 2) == "", 1).otherwise(F.regexp_extract("category", marked, 2).cast("int"))
    used = names.filter(F.col("category").rlike(marked)).select("group_id", F.regexp_extract("category", marked, 1).alias("name"), number.alias("k"))
    used = used.unionByName(taken.select("group_id", F.col("category").alias("name"), F.lit(0).alias("k"))).groupBy("group_id", "name").agg(F.collect_set("k").alias("_used"))
    order = Window.partitionBy("group_id", "name").orderBy("index", "uuid")
    rows = nodes.join(used, ["group_id", "name"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    # The n-th node of a name gets the n-th number that is free.
    rows = rows.withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_nth", F.expr("element_at(filter(sequence(0, _n + size(_used)), x -> NOT array_contains(_used, x)), _n)"))
    mark = F.when(F.col("_nth") == 0, F.lit("")).when(F.col("_nth") == 1, F.lit(" (Promoted)")).otherwise(F.concat(F.lit(" (Promoted "), F.col("_nth").cast("string"), F.lit(")")))
    return rows.withColumn("category", F.concat("name", mark)).drop("_used", "_nth", "_n")


def materialize_layer(assignments: DataFrame, nodes: DataFrame, layer: int, min_children: int = 2, speaker_mode: str = "paper_v2") -> DataFrame:
    """The categories of a layer and their members: group_id, category, kind, pos, uuid, name.

    kind is natural, promoted (an uncovered node alone) or speaker (the bucket of reserved nodes).
    """
    reserved = nodes.withColumn("_reserved", is_reserved_speaker(layer, speaker_mode))
    free = reserved.filter("NOT _reserved").drop("_reserved")
    natural = assigned_members(assignments, free, min_children).groupBy("group_id", "category", "uuid").agg(F.min("pos").alias("pos"))
    natural = natural.join(free.select("group_id", "uuid", "name"), ["group_id", "uuid"]).withColumn("kind", F.lit("natural"))
    uncovered = free.join(natural.select("group_id", "uuid"), ["group_id", "uuid"], "left_anti")
    own_place = F.struct(F.lit(0).cast("long").alias("row_no"), F.col("index").cast("int").alias("at"))
    promoted = promoted_names(uncovered, natural).withColumn("kind", F.lit("promoted")).withColumn("pos", own_place)
    speakers = reserved.filter("_reserved").withColumns({"category": F.lit(SPEAKER), "kind": F.lit("speaker"), "pos": own_place})
    columns = ("group_id", "category", "kind", "pos", "uuid", "name")
    natural = natural.withColumn("pos", F.struct(F.col("pos.row_no").cast("long").alias("row_no"), F.col("pos.at").cast("int").alias("at")))
    return natural.select(*columns).unionByName(promoted.select(*columns)).unionByName(speakers.select(*columns))


def layer_categories(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per category: members in order, merged tags (first seen, at most 5) and a fallback summary."""
    tags = nodes.select("group_id", "uuid", "tag")
    rows = members.join(tags, ["group_id", "uuid"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "uuid", "name", "tag")))
    out = rows.groupBy("group_id", "category", "kind").agg(ordered.alias("_m"))
    return out.select(
        "group_id", "category", "kind",
        F.expr("transform(_m, m -> m.uuid)").alias("children"),
        merged_tags(F.expr("transform(_m, m -> coalesce(m.tag, array()))")).alias("tag"),
        fallback_summary(F.col("category"), F.expr("transform(_m, m -> m.name)")).alias("summary"),
    )


def with_details(categories: DataFrame, details: DataFrame, most_tags: int = 2) -> DataFrame:
    """``categories`` with the summaries and tags of ``details`` (group_id, category, summary, tag) where it has some.

    Names meet trimmed. A summary is trimmed and a blank one does not count;
    of the tags that are not blank the first ``most_tags`` stay. A category
    without details keeps what it has. Of several details of one name the
    smallest counts.
    """
    summary = F.when(F.trim("summary") != "", F.trim("summary"))
    tags = F.slice(F.array_distinct(F.filter(F.transform("tag", lambda t: F.trim(t)), lambda t: t != "")), 1, most_tags)
    told = details.select("group_id", F.trim("category").alias("_name"), summary.alias("_summary"), F.when(F.size(tags) > 0, tags).alias("_tag"))
    told = told.groupBy("group_id", "_name").agg(F.min("_summary").alias("_summary"), F.min("_tag").alias("_tag"))
    rows = categories.withColumn("_name", F.trim("category")).join(told, ["group_id", "_name"], "left")
    rows = rows.withColumns({"summary": F.coalesce("_summary", "summary"), "tag": F.coalesce("_tag", "tag")})
    return rows.select(*categories.columns)


def merged_tags(lists: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.flatten(lists)), 1, most)


def fallback_summary(name: Column, members: Column) -> Column:
    """The name and the first six members."""
    return F.concat(name, F.lit(": "), F.array_join(F.slice(members, 1, 6), ", "))


def check_layer(categories: DataFrame, nodes: DataFrame, layer: int, min_children: int = 2) -> DataFrame:
    """Whether each group's layer keeps the constraints: group_id, n_nodes, n_categories, accepted.

    Every category has ``min_children`` members, but for Speaker and promoted
    nodes alone; from layer 2 on there are no more categories than nodes.
    """
    n = F.size("children")
    good = (n >= min_children) | (F.col("category") == SPEAKER) | ((F.col("kind") == "promoted") & (n == 1))
    found = categories.groupBy("group_id").agg(F.count("*").alias("n_categories"), F.bool_and(good).alias("_good"))
    counts = nodes.groupBy("group_id").agg(F.count("*").alias("n_nodes"))
    fewer = F.lit(True) if layer < 2 else F.col("n_categories") <= F.col("n_nodes")
    return counts.join(found, "group_id").select("group_id", "n_nodes", "n_categories", (F.col("_good") & fewer).alias("accepted"))


def indexed(nodes: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Nodes with their index from 0 in the order of names."""
    placed = numbered(nodes, ["group_id"], ["name", "uuid"], stages)
    return placed.withColumn("index", (F.col("place") - 1).cast("int")).drop("place")


def batched(rows: DataFrame, size: int, partition: tuple[str, ...] = ("group_id",), order: tuple[str, ...] = ("index",), stages: Stages | None = None) -> DataFrame:
    """Adds batch_id: consecutive runs of ``size`` rows."""
    if order == ("index",) and partition == ("group_id",):  # rows of a layer have their place already
        return rows.withColumn("batch_id", F.floor(F.col("index") / size))
    placed = numbered(rows, partition, order, stages)
    return placed.withColumn("batch_id", F.floor((F.col("place") - 1) / size)).drop("place")
