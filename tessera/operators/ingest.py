"""From turns to entities, mentions and fact edges, in set form.

A turn's searches run before its own writes; so does a batch's here: rows are
resolved against the state before the batch, and equal keys inside it meet by
their natural key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, speaker_name, stable_id
from tessera.stages import Keep, as_it_is


def turn_text(recent: Column, speaker: Column, content: Column) -> Column:
    """The current turn, then the recent ones, a line each."""
    return F.array_join(F.concat(F.array(F.concat(F.lit("Current turn: "), speaker, F.lit(": "), content)), F.transform(recent, lambda x: F.concat(F.lit("Recent turn: "), x))), "\n")


def entity_mentions(names: DataFrame, episodes: DataFrame, force_speaker: bool = True) -> DataFrame:
    """Distinct entity names of every episode, in first-seen order: group_id, episode_uuid, name, key, pos, is_speaker.

    names: group_id, episode_uuid, pos, name (extraction, then reflection).
    Blank names go; names that normalise equal are one; the speaker comes first if forced.
    """
    rows = names.filter(F.trim("name") != "").select("group_id", "episode_uuid", F.col("pos").cast("long").alias("pos"), F.trim("name").alias("name"), F.lit(False).alias("is_speaker"))
    if force_speaker:
        forced = episodes.select("group_id", F.col("uuid").alias("episode_uuid"), F.lit(-1).cast("long").alias("pos"), speaker_name(F.col("speaker")).alias("name"), F.lit(True).alias("is_speaker"))
        rows = rows.unionByName(forced)
    rows = rows.withColumn("key", normalize_text(F.col("name")))
    return rows.groupBy("group_id", "episode_uuid", "key").agg(F.min_by("name", F.struct("pos", "name")).alias("name"), F.min("pos").alias("pos"), F.max("is_speaker").alias("is_speaker"))


def resolve_entities(mentions: DataFrame, known: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """Mentions with their entity's uuid: the entity of equal normalised name, else a fuzzy match, else a new stable id.

    known: group_id, uuid, name. fuzzy: group_id, key, match_uuid (see ``match_decisions``).
    """
    have = known.select("group_id", normalize_text(F.col("name")).alias("key"), "uuid").groupBy("group_id", "key").agg(F.min("uuid").alias("_known"))
    rows = mentions.join(have, ["group_id", "key"], "left")
    rows = rows.join(fuzzy.select("group_id", "key", "match_uuid"), ["group_id", "key"], "left") if fuzzy is not None else rows.withColumn("match_uuid", F.lit(None).cast("string"))
    return rows.withColumn("uuid", F.coalesce("_known", "match_uuid", stable_id("entity", F.col("group_id"), F.col("key")))).drop("_known", "match_uuid")


def entity_rows(resolved: DataFrame, episodes: DataFrame, known: DataFrame | None = None, details: DataFrame | None = None, all_known: bool = False) -> DataFrame:
    """One row per entity: first-seen name, summary and tags, sticky is_speaker, episode and source ids in order.

    details: group_id, key, summary, tag from a provider; without one the
    summary is a fallback, at most three tags are kept, and a forced speaker's first tag is ``speaker``.
    An entity in ``known`` keeps its summary, tags, embeddings and other columns where there is nothing new;
    with ``all_known``, those that no mention means come as they are too, so that the result is the new table.
    """
    turns = episodes.select("group_id", F.col("uuid").alias("episode_uuid"), "seq", "source_id")
    rows = resolved.join(turns, ["group_id", "episode_uuid"])
    named = F.min(F.struct("seq", "pos", "name", "key")).alias("_first")
    out = rows.groupBy("group_id", "uuid").agg(named, F.max("is_speaker").alias("is_speaker"), F.collect_set(F.struct("seq", "episode_uuid", "source_id")).alias("_turns"))
    ids = lambda c: F.expr(f"transform(array_sort(array_distinct(transform(_turns, x -> struct(x.seq, x.{c})))), x -> x.{c})")
    out = out.select("group_id", "uuid", "_first.name", "_first.key", "is_speaker", ids("episode_uuid").alias("episode_idx"), ids("source_id").alias("source_ids"))
    given = details.select("group_id", "key", F.col("summary").alias("_s"), F.col("tag").alias("_t")) if details is not None else None
    out = out.join(given, ["group_id", "key"], "left") if given is not None else out.withColumn("_s", F.lit(None).cast("string")).withColumn("_t", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    tag = F.slice(F.array_distinct(F.concat(F.when(F.col("is_speaker"), F.array(F.lit("speaker"))).otherwise(none), F.coalesce("_t", none))), 1, 3)
    out = out.withColumns({"_fallback": F.concat("name", F.lit(" appears in the conversation.")), "tag": tag})
    if known is None:
        return out.withColumn("summary", F.coalesce("_s", "_fallback")).drop("_s", "_t", "_fallback", "key")
    # A known entity keeps all that this batch has nothing new for; an embedding goes only with the summary it is of.
    old = known.select("group_id", "uuid", F.struct(*[c for c in known.columns if c not in ("group_id", "uuid")]).alias("_old"))
    out = out.withColumn("_named", F.lit(True)).join(old, ["group_id", "uuid"], "full_outer" if all_known else "left").withColumns({
        "name": F.coalesce("_old.name", "name"),
        "summary": F.coalesce("_s", "_old.summary", "_fallback"),
        "tag": F.when(F.col("_t").isNull() & (F.size("_old.tag") > 0), F.col("_old.tag")).otherwise(F.col("tag")),
        "is_speaker": F.coalesce("_old.is_speaker", F.lit(False)) | F.col("is_speaker"),
        "episode_idx": F.array_union(F.coalesce("_old.episode_idx", none), F.col("episode_idx")),
        "source_ids": F.array_union(F.coalesce("_old.source_ids", none), F.col("source_ids")),
    })
    for c in known.columns:
        if c not in out.columns:
            kept = F.col("summary").eqNullSafe(F.col("_old.summary")) if c == "summary_embedding" else F.lit(True)
            out = out.withColumn(c, F.when(kept, F.col(f"_old.{c}")))
    if all_known:
        out = out.withColumns({c: F.when(F.col("_named"), F.col(c)).otherwise(F.col(f"_old.{c}")) for c in known.columns if c not in ("group_id", "uuid")})
    return out.drop("_s", "_t", "_fallback", "_old", "_named", "key")


def distinct_edges(edges: DataFrame, turn: tuple[str, ...] = ("group_id", "episode_uuid")) -> DataFrame:
    """Edges of an episode that normalise equal (source, target, fact) once: extraction (round 0) before reflection, then order.

    ``turn`` names the columns that tell episodes apart; edges dealt by them are not shuffled again.
    """
    keys = [normalize_text(F.col(c)).alias(f"_{c}") for c in ("source", "target", "fact")]
    rows = edges.select("*", *keys)
    order = Window.partitionBy(*turn, "_source", "_target", "_fact").orderBy("round", "pos")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_source", "_target", "_fact")


def resolve_edges(edges: DataFrame, entities: DataFrame, episodes: DataFrame, matched: DataFrame | None = None, exact_case: bool = False) -> DataFrame:
    """Edges between known entities of the group, with stable or matched ids; self loops and unresolved ends go.

    Names meet normalised, or by exact case. Of edges with one id, the latest turn's stays.
    """
    key = (lambda c: c) if exact_case else normalize_text
    ends = entities.select("group_id", key(F.col("name")).alias("_k"), "uuid").groupBy("group_id", "_k").agg(F.min("uuid").alias("_u"))
    rows = _with_ends(edges, ends, key, ["group_id"], episodes)
    if matched is not None:
        rows = rows.join(matched.select("uuid", "match_uuid"), "uuid", "left").withColumn("uuid", F.coalesce("match_uuid", "uuid")).drop("match_uuid")
    return latest_edges(rows)


def placed_edges(edges: DataFrame, resolved: DataFrame, entities: DataFrame, episodes: DataFrame, keep: Keep = as_it_is) -> DataFrame:
    """Edges with the entities that their ends' names mean in their own turn, or else in the group by equal normalised name.

    Most ends are said in their turn, so only the other edges are joined with the group's names.
    """
    said = resolved.select("group_id", "episode_uuid", F.col("key").alias("_k"), "uuid").groupBy("group_id", "episode_uuid", "_k").agg(F.min("uuid").alias("_u"))
    named = entities.select("group_id", normalize_text(F.col("name")).alias("_k"), "uuid").groupBy("group_id", "_k").agg(F.min("uuid").alias("_named"))
    rows = edges
    for end in ("source", "target"):
        side = said.select("group_id", "episode_uuid", F.col("_k").alias("_end"), F.col("_u").alias(f"{end}_uuid"))
        rows = rows.withColumn("_end", normalize_text(F.col(end))).join(side, ["group_id", "episode_uuid", "_end"], "left").drop("_end")
    rows = keep("said-edges", rows)
    whole = F.col("source_uuid").isNotNull() & F.col("target_uuid").isNotNull()
    lacking = rows.filter(~whole)
    if not lacking.isEmpty():
        for end in ("source", "target"):
            side = named.withColumnRenamed("_k", "_end")
            lacking = lacking.withColumn("_end", normalize_text(F.col(end))).join(side, ["group_id", "_end"], "left")
            lacking = lacking.withColumn(f"{end}_uuid", F.coalesce(f"{end}_uuid", "_named")).drop("_end", "_named")
        rows = rows.filter(whole).unionByName(lacking.filter(whole))
    return _identified(rows, episodes)


def _with_ends(edges: DataFrame, ends: DataFrame, key, by: list[str], episodes: DataFrame) -> DataFrame:
    rows = edges
    for end in ("source", "target"):
        side = ends.select(*by, F.col("_k").alias(f"_{end}"), F.col("_u").alias(f"{end}_uuid"))
        rows = rows.withColumn(f"_{end}", key(F.col(end))).join(side, [*by, f"_{end}"]).drop(f"_{end}")
    return _identified(rows, episodes)


def _identified(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Edges with two ends that differ, with their turn's time and their id."""
    rows = rows.filter("source_uuid <> target_uuid").withColumn("_fact", normalize_text(F.col("fact")))
    rows = rows.join(episodes.select("group_id", F.col("uuid").alias("episode_uuid"), "valid_at", "seq"), ["group_id", "episode_uuid"])
    return rows.withColumn("uuid", stable_id("fact", F.col("source_uuid"), F.col("target_uuid"), F.col("_fact")))


def latest_edges(rows: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Of rows with one id the latest turn's, as edges; with the edges ``old``, the table after them, in the same shuffle.

    An edge of ``old`` that has a new row is replaced wholly, so of its columns that edges of turns lack nothing stays.
    """
    none = F.lit(None).cast("timestamp").alias("invalid_at")
    if old is None:
        last = F.max_by(F.struct("group_id", "fact", "valid_at"), F.struct("seq", "fact")).alias("_e")
        return rows.groupBy("source_uuid", "target_uuid", "uuid").agg(last).select("_e.group_id", "uuid", "source_uuid", "target_uuid", "_e.fact", "_e.valid_at", none)
    keys = ["source_uuid", "target_uuid", "uuid"]
    new = rows.select("group_id", *keys, "fact", "valid_at", none, F.lit(1).alias("_new"), F.col("seq").cast("long").alias("_seq"))
    both = old.withColumns({"_new": F.lit(0), "_seq": F.lit(None).cast("long")}).unionByName(new, allowMissingColumns=True)
    last = F.max(F.struct("_new", "_seq", "fact", *[c for c in old.columns if c not in (*keys, "fact")])).alias("_e")
    return both.groupBy(*keys).agg(last).select(*[c if c in keys else f"_e.{c}" for c in old.columns])


def detail_batch_size(max_tokens: int) -> int:
    """Entities whose details one call asks for."""
    return max(1, min(8, max_tokens // 128))


def edge_batch_size(max_tokens: int) -> int:
    """Entities between which one call asks for edges."""
    return max(2, min(6, max_tokens // 128))
