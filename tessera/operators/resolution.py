"""Which entity or fact a mention means, turn by turn: known ones, and those that earlier turns of the same batch made.

A turn's searches run before its own writes. A name means the entity of equal
normalised name; else the most similar one, if it is near enough (similarity of
``high``, or of ``low`` with a common token); else it makes an entity. So a
name makes an entity only if no near one is there when it is first said, and
whether one is there depends on the names said before.

``resolve_in_order`` decides that for all groups at once, in rounds over the
graph of near names; ``fold_entities`` says a group's turns one after another.
They give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, stable_id, tokens
from tessera.providers import Embedder
from tessera.stages import Stages

from .search import AT_ONCE, in_tiles, matrix
from .vector_index import usable

#: More rounds than this are an error; a round decides at least the earliest undecided names of each group.
MOST_ROUNDS = 10_000
RESOLVED = "group_id string, episode_uuid string, key string, name string, pos long, is_speaker boolean, uuid string"


def with_turns(mentions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Mentions (group_id, episode_uuid, key, ...) with ``turn``, the place of their episode in the group's order."""
    turn = F.struct(F.col("seq").cast("long").alias("seq"), "source_id", F.col("uuid").alias("episode"))
    return mentions.join(episodes.select("group_id", F.col("uuid").alias("episode_uuid"), turn.alias("turn")), ["group_id", "episode_uuid"])


def known_keys(known: DataFrame) -> DataFrame:
    """Known entities by normalised name, one for each: group_id, key, uuid."""
    return known.select("group_id", normalize_text(F.col("name")).alias("key"), "uuid").groupBy("group_id", "key").agg(F.min("uuid").alias("uuid"))


def turn_places(*turns: list[dict | None]) -> list[np.ndarray]:
    """The place of each turn among all that are given; -1 for null, which is before all."""
    keys = [[None if t is None else (t["seq"] is not None, t["seq"] or 0, t["source_id"] or "", t["episode"] or "") for t in part] for part in turns]
    place = {t: k for k, t in enumerate(sorted({t for part in keys for t in part if t is not None}))} | {None: -1}
    return [np.array([place[t] for t in part], np.int64) for part in keys]


def near_in_tile(match: tuple[float, float], best: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a tile's names (query_id, _q, _said, _turn) and rows (uuid, vector, words, since): the pairs that are near.

    With ``best``, of a name's rows in the order of their similarity, then
    uuid, only those that were there before all better ones: at any turn, the
    best one there is among them. Else all rows that were there before the name.
    """

    def run(asked: pa.Table, have: pa.Table) -> pa.Table:
        have = have.sort_by("uuid")
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        if asked.num_rows and have.num_rows:
            size = have.column("_d")[0].as_py()
            (rows, lengths), (names, own_lengths) = matrix(have.column("vector"), size), matrix(asked.column("_q"), size)
            since, turn = turn_places(have.column("since").to_pylist(), asked.column("_turn").to_pylist())
            holders: dict[str, list[int]] = {}
            for k, said in enumerate(have.column("words").to_pylist()):
                for word in set(said):
                    holders.setdefault(word, []).append(k)
            own, step = asked.column("_said").to_pylist(), max(1, AT_ONCE // len(rows))
            for i in range(0, len(names), step):
                scale = own_lengths[i : i + step, None] * lengths
                near = names[i : i + step] @ rows.T
                near = np.round(np.divide(near, scale, out=np.zeros_like(near), where=scale > 0), 6)
                real = near >= match[0]
                for k, said in enumerate(own[i : i + step]):
                    for word in said:
                        if places := holders.get(word):
                            real[k, places] |= near[k, places] >= match[1]
                if not best:
                    real &= since < turn[i : i + step, None]
                q, v = np.nonzero(real)
                similarity = near[q, v]
                if best:
                    order = np.lexsort((v, -similarity, q))
                    q, v, similarity = q[order], v[order], similarity[order]
                    # Each name's places lie below all of the name before, so that the running minimum starts anew.
                    places = since[v] - q * (len(rows) + len(names) + 2)
                    first = np.ones(len(q), bool)
                    first[1:] = places[1:] < np.minimum.accumulate(places)[:-1]
                    q, v, similarity = q[first], v[first], similarity[first]
                found.append((q + i, v, similarity))
        q, v, similarity = (np.concatenate(part) for part in zip(*found))
        q, v = pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64))
        taken = [asked.column("query_id").take(q), *(have.column(c).take(v) for c in ("group_id", "uuid", "since"))]
        return pa.table([*taken, pa.array(similarity.astype("f8"))], names=["key", "group_id", "other", "since", "similarity"])

    return run


def near_names(asked: DataFrame, have: DataFrame, match: tuple[float, float], best: bool) -> DataFrame:
    """The rows of ``have`` near each name of ``asked`` (see ``near_in_tile``): key, group_id, other, since, similarity.

    asked: group_id, key, vector, words, turn. have: group_id, key, vector, words, since (a turn, or null for known ones),
    and with ``best`` uuid, which then is ``other``. All pairs are compared, tile by tile; memory does not grow with a group.
    """
    by = F.col("uuid" if best else "key").alias("uuid")
    names = asked.select("group_id", F.col("key").alias("query_id"), F.col("vector").alias("_q"), F.col("words").alias("_said"), F.col("turn").alias("_turn"), F.size("vector").alias("_d"))
    rows = have.select("group_id", by, "vector", "words", "since", F.size("vector").alias("_d"))
    names, rows = in_tiles(names, rows)  # under names of their own, as both may come from one table
    turn = dict(have.dtypes)["since"]
    return names.cogroup(rows).applyInArrow(near_in_tile(match, best), f"key string, group_id string, other string, since {turn}, similarity double")


def makers(open_names: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """Those of ``open_names`` (group_id, key, ...), names without a near one known, that make an entity.

    edges: group_id, key, other, of which ``other`` is a near open name said in an earlier turn.

    In rounds: a name makes an entity when no near name said in an earlier turn
    is undecided or has made one; and none when such a name has made one. Each
    round's rows are written, and only undecided names stay.
    """
    made = None
    for step in range(MOST_ROUNDS):
        # Names that were decided to make none do not count for others.
        waiting = edges.join(open_names.select("group_id", F.col("key").alias("other")), ["group_id", "other"], "left_semi")
        now = stages.keep(f"made-{step}", open_names.join(waiting.select("group_id", "key"), ["group_id", "key"], "left_anti"))
        made = now if made is None else made.unionByName(now)
        rest = open_names.join(now.select("group_id", "key"), ["group_id", "key"], "left_anti")
        beaten = edges.join(now.select("group_id", F.col("key").alias("other")), ["group_id", "other"], "left_semi").select("group_id", "key")
        open_names = stages.keep(f"open-{step}", rest.join(beaten, ["group_id", "key"], "left_anti"))
        if open_names.isEmpty():
            return made
    raise RuntimeError("the rounds of resolution did not end")


def resolve_in_order(mentions: DataFrame, episodes: DataFrame, known: DataFrame, embedder: Embedder, match: tuple[float, float], stages: Stages) -> DataFrame:
    """``mentions`` with the uuid of their entity, as if turns were said one after another (RESOLVED).

    mentions: one row per episode and key (see ``ingest.entity_mentions``).
    known: group_id, uuid, name. Of entities equally similar the least uuid counts.

    Names are compared with entities, and with each other only where no known
    one is near; and of the entities near a name only those are kept that are
    the best one at some turn. So what is written grows with the names, not with their pairs.
    """
    rows = stages.keep("mentions-in-order", with_turns(mentions, episodes))
    have = known_keys(known).withColumn("since", F.lit(None).cast(rows.schema["turn"].dataType))
    first = rows.join(have.select("group_id", "key"), ["group_id", "key"], "left_anti").groupBy("group_id", "key").agg(F.min("turn").alias("turn"))
    seen = {"vector": embedder.embed(F.col("key")), "words": tokens(F.col("key"))}
    have, first = stages.keep("known-keys", have.withColumns(seen)), stages.keep("first-said", first.withColumns(seen))
    comparable = usable(F.col("vector"))
    at_known = stages.keep("near-known", near_names(first.filter(comparable), have.filter(comparable), match, best=True))
    open_names = stages.keep("open", first.join(at_known.select("group_id", "key"), ["group_id", "key"], "left_anti"))
    able = open_names.filter(comparable)
    earlier = stages.keep("near-before", near_names(able, able.withColumnRenamed("turn", "since"), match, best=False).select("group_id", "key", "other"))
    made = makers(open_names.select("group_id", "key", F.col("turn").alias("since")), earlier, stages)
    made = stages.keep("made", made.withColumn("uuid", stable_id("entity", F.col("group_id"), F.col("key"))))
    entities = have.select("group_id", "key", "uuid", "since").unionByName(made)
    exact = rows.join(entities.select("group_id", "key", "uuid"), ["group_id", "key"])
    # A name without an entity of its own: of the near ones that are there at each turn, the most similar.
    others = first.filter(comparable).join(made.select("group_id", "key"), ["group_id", "key"], "left_anti")
    makes = able.select("group_id", "key", "vector", "words").join(made, ["group_id", "key"])
    at_made = stages.keep("near-made", near_names(others, makes, match, best=True))
    near = at_known.unionByName(at_made).withColumnRenamed("other", "uuid")
    fuzzy = rows.join(entities.select("group_id", "key"), ["group_id", "key"], "left_anti").join(near, ["group_id", "key"]).filter("since IS NULL OR since < turn")
    own = ["group_id", "episode_uuid", "key"]
    best = fuzzy.groupBy(*own).agg(*[F.first(c).alias(c) for c in ("name", "pos", "is_speaker")], F.min_by("uuid", F.struct(-F.col("similarity"), "uuid")).alias("uuid"))
    columns = ("group_id", "episode_uuid", "key", "name", "pos", "is_speaker", "uuid")
    return exact.select(*columns).unionByName(best.select(*columns))


class Names:
    """What there is so far, for a fold: keys, ids and directions of vectors."""

    def __init__(self, known: Iterable[tuple[str, str, list[float]]] = ()):
        self.uuids: dict[str, str] = {}
        self.keys: list[str] = []
        self.ids: list[str] = []
        self.rows: list[np.ndarray] = []
        for key, uuid, vector in known:
            self.add(key, uuid, vector)

    def add(self, key: str, uuid: str, vector: list[float]) -> None:
        v = np.asarray(vector, "f8")
        length = np.sqrt(v @ v)
        self.uuids[key] = uuid
        self.keys.append(key)
        self.ids.append(uuid)
        self.rows.append(v / length if length else v)

    def find(self, key: str, vector: list[float], match: tuple[float, float]) -> str | None:
        """The id of the entity that ``key`` means, or None for a new one."""
        if key in self.uuids:
            return self.uuids[key]
        return self.nearest(key, vector, match)

    def nearest(self, key: str, vector: list[float], match: tuple[float, float]) -> str | None:
        v = np.asarray(vector, "f8")
        length = np.sqrt(v @ v)
        if not self.rows or not length:
            return None
        similar = np.round(np.stack(self.rows) @ (v / length), 6)
        own = words(key)
        best = [(-s, uuid) for s, k, uuid in zip(similar, self.keys, self.ids) if s >= match[1] and (s >= match[0] or own & words(k))]
        return min(best)[1] if best else None


def words(key: str) -> set[str]:
    import regex

    return set(regex.findall(r"[\p{L}\p{N}_-]+", key))


def say_turn(names: Names, said: list[tuple[str, str, list[float]]], match: tuple[float, float]) -> list[tuple[str, str]]:
    """One turn's (key, own id, vector): searches first, then writes. Gives (key, uuid)."""
    found = [(key, names.find(key, vector, match)) for key, _, vector in said]
    for (key, own, vector), (_, uuid) in zip(said, found):
        if uuid is None:
            names.add(key, own, vector)
    return [(key, uuid or own) for (key, own, _), (_, uuid) in zip(said, found)]


def turns_said(mentions: DataFrame, episodes: DataFrame, embedder: Embedder) -> DataFrame:
    """One row per turn with its names, for a fold: group_id, seq, source_id, episode_uuid, said (key, own, name, pos, is_speaker, vector)."""
    rows = with_turns(mentions, episodes).withColumns({"own": stable_id("entity", F.col("group_id"), F.col("key")), "vector": embedder.embed(F.col("key"))})
    said = F.array_sort(F.collect_list(F.struct("key", "own", "name", "pos", "is_speaker", "vector")))
    return rows.groupBy("group_id", "turn", "episode_uuid").agg(said.alias("said")).select("group_id", "turn.seq", "turn.source_id", "episode_uuid", "said")


def folded(names: Names, group: str, turns: pd.DataFrame, match: tuple[float, float], made: Callable[[str, str, list[float]], None] = lambda *_: None) -> pd.DataFrame:
    """A group's turns in order, as rows of RESOLVED; ``made`` is told each new entity."""
    out = []
    for turn in turns.sort_values(["seq", "source_id", "episode_uuid"]).itertuples():
        said = [(m["key"], m["own"], m["vector"]) for m in turn.said]
        before = set(names.uuids)
        found = dict(say_turn(names, said, match))
        for key, own, vector in said:
            if key in names.uuids and key not in before:
                made(key, own, vector)
        out += [(group, turn.episode_uuid, m["key"], m["name"], m["pos"], m["is_speaker"], found[m["key"]]) for m in turn.said]
    return pd.DataFrame(out, columns=["group_id", "episode_uuid", "key", "name", "pos", "is_speaker", "uuid"])


def fold_entities(mentions: DataFrame, episodes: DataFrame, known: DataFrame, embedder: Embedder, match: tuple[float, float]) -> DataFrame:
    """As ``resolve_in_order``, but each group's turns are said one after another by one task. For groups of moderate size."""
    have = known_keys(known).withColumn("vector", embedder.embed(F.col("key")))

    def run(key: tuple, turns: pd.DataFrame, entities: pd.DataFrame) -> pd.DataFrame:
        names = Names(zip(entities["key"], entities["uuid"], entities["vector"]))
        return folded(names, key[0], turns, match)

    return turns_said(mentions, episodes, embedder).groupBy("group_id").cogroup(have.groupBy("group_id")).applyInPandas(run, RESOLVED)


def fold_facts(edges: DataFrame, known: DataFrame, embedder: Embedder, match: tuple[float, float]) -> DataFrame:
    """New edges with the uuid of the fact that they repeat, or their own: group_id, source_uuid, target_uuid, uuid, fact, valid_at, seq.

    edges: group_id, source_uuid, target_uuid, uuid (its own), fact, valid_at,
    seq, pos. known: stored edges. Only facts between the same two entities, in
    that direction, are compared: the one of equal normalised text, else the
    most similar one that is near. A match takes over the new text, so facts of
    a pair are said in order, by one task per pair as a stream over sorted rows
    that holds the pair's facts so far.
    """
    shape = ["group_id", "source_uuid", "target_uuid", "uuid", "fact", "valid_at", "seq", "pos"]
    old = known.select("group_id", "source_uuid", "target_uuid", "uuid", "fact", F.lit(None).cast("timestamp").alias("valid_at"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("pos"))
    old = old.join(edges.select("group_id", "source_uuid", "target_uuid").distinct(), ["group_id", "source_uuid", "target_uuid"], "left_semi")
    new = edges.select(*shape[:6], F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"))
    rows = old.select(*shape).unionByName(new).withColumns({"key": normalize_text(F.col("fact")), "vector": embedder.embed(normalize_text(F.col("fact")))})
    ends = ("group_id", "source_uuid", "target_uuid")
    rows = rows.repartition(*ends).sortWithinPartitions(*ends, F.asc_nulls_first("seq"), "pos", "uuid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, facts, turn, waiting = None, {}, None, {}
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if (r.group_id, r.source_uuid, r.target_uuid) != pair:
                    pair, facts, turn, waiting = (r.group_id, r.source_uuid, r.target_uuid), {}, None, {}
                if pd.isna(r.seq):
                    facts[r.uuid] = (r.key, r.vector)
                    continue
                if r.seq != turn:  # the facts of a turn are written after all its searches
                    facts |= waiting
                    turn, waiting = r.seq, {}
                same = [uuid for uuid, (key, _) in facts.items() if key == r.key]
                uuid = min(same) if same else Names((key, uuid, v) for uuid, (key, v) in facts.items()).nearest(r.key, r.vector, match) or r.uuid
                waiting[uuid] = (r.key, r.vector)
                out.append((*pair, uuid, r.fact, r.valid_at, r.seq))
            yield pd.DataFrame(out, columns=shape[:7])

    return rows.mapInPandas(run, "group_id string, source_uuid string, target_uuid string, uuid string, fact string, valid_at timestamp, seq long")
