"""Scans, upserts and deletes. A table's new state is a DataFrame; it is written to a new path and swapped in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import looking_back, numbered

# --- scans ------------------------------------------------------------------


def layer_zero_nodes(entities: DataFrame, group_id: str) -> DataFrame:
    return entities.filter(F.col("group_id") == group_id).select("uuid", "name", "summary", "tag", "is_speaker").orderBy("name", "uuid")


def nodes_of_layer(entities: DataFrame, categories: DataFrame, group_id: str, layer: int) -> DataFrame:
    """Nodes of a layer by name: entities at 0, categories above."""
    source = entities.withColumn("layer", F.lit(0)) if layer == 0 else categories.filter(F.col("layer") == layer)
    return source.filter(F.col("group_id") == group_id).select("uuid", "name", "tag", F.col("layer").cast("int").alias("layer")).orderBy("name", "uuid")


def entities_by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities whose name is in ``names`` (group_id, name), exact case; of equal names in a group the last by ``seq``."""
    found = entities.join(names.select("group_id", "name").distinct(), ["group_id", "name"], "left_semi")
    order = Window.partitionBy("group_id", "name").orderBy(F.desc("seq"), F.desc("uuid"))
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def recent_episodes(episodes: DataFrame, limit: int, before: DataFrame | None = None, exclude_source_id: str | None = None) -> DataFrame:
    """The newest ``limit`` episodes of every group, by (valid_at, seq); with ``before`` (group_id, valid_at, seq) strictly before that turn."""
    if before is not None:
        b = before.select("group_id", F.col("valid_at").alias("_t"), F.col("seq").alias("_s"))
        episodes = episodes.join(b, "group_id").filter((F.col("valid_at") < F.col("_t")) | ((F.col("valid_at") == F.col("_t")) & (F.col("seq") < F.col("_s")))).drop("_t", "_s")
    if exclude_source_id is not None:
        episodes = episodes.filter(F.col("source_id") != exclude_source_id)
    order = Window.partitionBy("group_id").orderBy(F.desc("valid_at"), F.desc("seq"), F.desc("source_id"))
    return episodes.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= limit)


def turn_contexts(episodes: DataFrame, limit: int) -> DataFrame:
    """Every turn with the contents of the ``limit`` turns before it, oldest first: the set form of a sequential read."""
    placed = numbered(episodes, ["group_id"], ["valid_at", "seq", "source_id"])
    return looking_back(placed, ["group_id"], F.concat_ws(": ", "speaker", "content"), limit, "recent").drop("place")


def completed(episodes: DataFrame) -> DataFrame:
    return episodes.filter("coalesce(ingestion_complete, false)")


def completed_sources(episodes: DataFrame) -> DataFrame:
    """Source ids of completed turns with their place in the group's order."""
    return numbered(completed(episodes).select("group_id", "source_id", "valid_at"), ["group_id"], ["valid_at", "source_id"])


def resume_positions(episodes: DataFrame, completed: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Where each group goes on: the number of its first turns that are all complete.

    ``logged`` (group_id, source_id) has the last turn that a log names: it
    counts as complete, and if the run of complete turns is empty the group
    goes on after it. Returns group_id, n_turns, start_index.
    """
    done = completed.select("group_id", "source_id")
    if logged is not None:
        done = done.union(logged.select("group_id", "source_id"))
    done = done.distinct().withColumn("done", F.lit(True))
    turns = numbered(episodes.select("group_id", "source_id", "seq"), ["group_id"], ["seq", "source_id"]).join(done, ["group_id", "source_id"], "left")
    first_open = F.min(F.when(F.col("done").isNull(), F.col("place")))
    out = turns.groupBy("group_id").agg(F.count("*").alias("n_turns"), F.coalesce(first_open - 1, F.count("*")).alias("start_index"))
    if logged is None:
        return out
    last = turns.join(logged.select("group_id", "source_id"), ["group_id", "source_id"]).groupBy("group_id").agg(F.max("place").alias("at"))
    start = F.when((F.col("start_index") == 0) & F.col("at").isNotNull(), F.col("at")).otherwise(F.col("start_index"))
    return out.join(last, "group_id", "left").select("group_id", "n_turns", start.alias("start_index"))


def require_resumable(positions: DataFrame) -> DataFrame:
    """The positions; an error for a group without any evidence of where to go on."""
    wrong = F.raise_error(F.concat(F.lit("nothing to resume from in group "), F.col("group_id"))).cast("long")
    return positions.withColumn("start_index", F.when(F.col("start_index") <= 0, wrong).otherwise(F.col("start_index")))


# --- upserts ----------------------------------------------------------------


def _newest(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys wholly; of several new rows the last by ``order``."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([order.desc()] if order is not None else []))
    return _newest(old, new).withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank", "_new")


def upsert_episodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge on (group_id, source_id): the first uuid stays, other columns are overwritten, completion stays true."""
    key = Window.partitionBy("group_id", "source_id")
    both = _newest(old, new)
    both = both.withColumn("_uuid", F.min_by("uuid", F.struct("_new", "seq", "uuid")).over(key))
    both = both.withColumn("_done", F.max(F.coalesce("ingestion_complete", F.lit(False))).over(key))
    rank = key.orderBy(F.desc("_new"), F.desc("seq"), F.desc("uuid"))
    last = both.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1")
    return last.withColumns({"uuid": F.col("_uuid"), "ingestion_complete": F.col("_done")}).drop("_rank", "_new", "_uuid", "_done")


def mark_ingested(episodes: DataFrame, done: DataFrame) -> DataFrame:
    """Sets ingestion_complete for the keys (group_id, source_id) in ``done``."""
    keys = done.select("group_id", "source_id").distinct().withColumn("_done", F.lit(True))
    flag = F.coalesce("_done", "ingestion_complete", F.lit(False))
    return episodes.join(keys, ["group_id", "source_id"], "left").withColumn("ingestion_complete", flag).drop("_done")


def upsert_edges(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Upsert on (source_uuid, target_uuid, uuid); edges without both endpoints in the group are not written."""
    nodes = entities.select("group_id", "uuid").distinct()
    for end in ("source_uuid", "target_uuid"):
        new = new.join(nodes.withColumnRenamed("uuid", end), ["group_id", end], "left_semi")
    return upsert(old, new, ["source_uuid", "target_uuid", "uuid"])


def connect(old: DataFrame, new: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Links that exist once; new ones only where both ends exist in the group. The two last columns are the ends."""
    group, a, b = old.columns
    for end, nodes in ((a, left), (b, right)):
        new = new.join(nodes.select(group, F.col("uuid").alias(end)).distinct(), [group, end], "left_semi")
    return old.unionByName(new.select(group, a, b)).dropDuplicates([group, a, b])


def clear_groups(table: DataFrame, groups: DataFrame) -> DataFrame:
    return table.join(groups.select("group_id").distinct(), "group_id", "left_anti")


def clear_hierarchy(categories: DataFrame, categorizes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Categories of the groups go, and the links that touch them."""
    return clear_groups(categories, groups), clear_groups(categorizes, groups)


def require_unique(table: DataFrame, keys: Sequence[str]) -> None:
    """An error if a key occurs twice: stands for the uniqueness constraints of a graph store."""
    twice = table.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0].asDict()} occurs more than once")


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and the paths of the table, its next and its previous state."""
    jvm = spark.sparkContext._jvm
    now, new, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".next", ".previous"))
    return now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), now, new, old


def restore(spark: SparkSession, path: str) -> None:
    """Puts the previous state back where a run ended between the two renames of ``write_swapped``. Call it before reading."""
    fs, now, _, old = _files(spark, path)
    if not fs.exists(now) and fs.exists(old) and not fs.rename(old, now):
        raise OSError(f"cannot restore {path}")


def write_swapped(table: DataFrame, path: str) -> None:
    """Write next to ``path`` and swap, so that a table can be made from what it replaces.

    At every moment the table is at ``path`` or, between the renames, whole at
    ``path``.previous, from where ``restore`` brings it back; the previous
    state goes only when the new one is in place.
    """
    spark = table.sparkSession
    restore(spark, path)
    table.write.mode("overwrite").parquet(path + ".next")
    fs, now, new, old = _files(spark, path)
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"cannot move {path}")
    if not fs.rename(new, now):
        raise OSError(f"cannot put {path} in place")
    fs.delete(old, True)
