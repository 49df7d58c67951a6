"""Repair of damaged conversations by a retained-subsequence dynamic program.

A conversation is read as its turns in order. Some are kept or get another
role, the rest is deleted, and empty turns are inserted, so that the roles are
one optional system turn and then user and assistant in turn, at the least
cost. Between two retained turns everything is deleted, which a prefix sum of
deletion costs prices; the two roles alone say whether a turn is inserted. So
the best way to each role of each turn comes from three running minima, one
for each role of the turn retained before. Equal costs are told apart by the
audit, the string of edits, whose order is carried as ranks.

A long conversation is not one task's work: the turns are dealt by ranges of
conversation and turn, each task prices its segment from every role that may
come before, and the segments of a conversation are joined like links of a
chain. Only the hash of the repaired text, which has to be taken in order, is
made by one task per conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the faults; signs that end a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of another role, a deletion, an insertion, and of a truncated turn that stays.
REROLE, DELETE, INSERT, STAYS = 2, 3, 2, 1
#: The role retained last: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns inserted between a retained role and the next; pairs that are not here cannot be made.
INSERTS = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
#: Turns inserted after the last retained role.
CLOSING = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: How a turn may be retained: role afterwards, roles before with their insertions.
ENTRIES = {role: [(q, n) for (q, r), n in INSERTS.items() if r == role] for role in (SYSTEM, USER, ASSISTANT)}
LEGAL = ("su", "ua", "au")


class Turn(NamedTuple):
    """What the program needs of a turn: the initial of its role, and its first fault (blank, duplicate, truncated or none)."""

    initial: str
    fault: str


def priced(turns: list[Turn], entry: int) -> dict[int, tuple[int, str]]:
    """The cheapest edits of consecutive turns for each role retained at their end, after ``entry``: role -> (cost, audit).

    An audit ends with the last turn's own edit: insertions stand before the
    turn that they precede, behind the deletions of the gap, which is least in ASCII.
    """
    # The least of cost without the deletions of the turns before, and its place among the audits so far, for each role.
    best, rank = {entry: 0}, {entry: 0}
    backs: list[dict[int, tuple[int, str]]] = []
    deleted = 0
    for initial, fault in turns:
        own = OF_INITIAL.get(initial, NONE)
        found = {role: (cost, rank[role], "D", role) for role, cost in best.items()}
        if fault not in ("blank", "duplicate"):
            stays = deleted + STAYS * (fault == "truncated") - (deleted + DELETE)
            for role, ways in ENTRIES.items():
                if role == own:
                    price, edit = stays, "K"
                elif role != SYSTEM:
                    price, edit = stays + REROLE, "R"
                else:
                    continue
                for before, inserts in ways:
                    if before in best:
                        way = (best[before] + price + INSERT * inserts, rank[before], "I" * inserts + edit, before)
                        if role not in found or way < found[role]:
                            found[role] = way
        deleted += DELETE
        best = {role: way[0] for role, way in found.items()}
        # No audit is the beginning of another, so the order of the old ones, then the new edits, is the order of the whole.
        places = sorted(found, key=lambda role: found[role][1:3])
        rank = {role: k for k, role in enumerate(places)}
        backs.append({role: (way[3], way[2]) for role, way in found.items()})
    out = {}
    for role in best:
        edits, at = [], role
        for back in reversed(backs):
            at, edit = back[at]
            edits.append(edit)
        out[role] = (best[role] + deleted, "".join(reversed(edits)))
    return out


def chained(segments: Iterable[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its segments in order, each entry role -> exit role -> (cost, audit)."""
    ways: dict[int, tuple[int, list[str]]] = {NONE: (0, [])}
    rank = {NONE: 0}
    for segment in segments:
        found: dict[int, tuple[int, int, str]] = {}
        for before, (cost, _) in ways.items():
            for role, (more, audit) in segment[before].items():
                way = (cost + more, rank[before], audit, before)
                if role not in found or way < found[role]:
                    found[role] = way
        kept = {before: pieces for before, (_, pieces) in ways.items()}
        ways = {role: (way[0], [*kept[way[3]], way[2]]) for role, way in found.items()}
        rank = {role: k for k, role in enumerate(sorted(found, key=lambda role: found[role][1:3]))}
    closed = min((cost + INSERT * CLOSING[role], rank[role], role) for role, (cost, _) in ways.items())
    role = closed[2]
    return closed[0], "".join(ways[role][1]) + "I" * CLOSING[role]


class Repaired:
    """Takes a conversation's turns in order with its audit, and hashes the repaired text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.hash, self.lines = audit, 0, NONE, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.line(self.following(), "")

    def following(self) -> str:
        self.role = ASSISTANT if self.role == USER else USER
        return "assistant" if self.role == ASSISTANT else "user"

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.role = OF_INITIAL[role[:1]]
            self.line(role, text)
        elif edit == "R":
            self.line(self.following(), text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


# --- the tables ------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage: by crc32(conv_id:turn) mod 20, 0 drops a row, 1 empties its text, 2 takes the signs that end sentences, 3 repeats it, 4 sets the role user. Null parts of the key count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def fault(text: Column) -> Column:
    """Blank, truncated or none."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated").otherwise("none")


#: The order of a conversation: turns, null first; rows of one turn by role and digest.
ORDER = ("conv_id", "has_turn", "turn", "role", "digest")
#: Numbers of a segment; they add up, but for the turns (see ``joined``).
COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def faulty(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``rows`` (ORDER, fault) with how often they occur (n) and whether the first has its role and text for the first time (new).

    Equal rows are counted before anything is dealt by role and text, and first
    places are minima, combined early: many copies of one turn stay cheap.
    """
    each = rows.groupBy(*ORDER, "fault").agg(F.count("*").alias("n"))
    place = F.struct("has_turn", "turn")
    first = each.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return each.join(first, same).select(*ORDER, "fault", "n", place.eqNullSafe(F.col("first")).alias("new"))


def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``faulty`` to one row per conversation and task: its place, its counts and its ways."""
    names = ("conv_id", "has_turn", "turn", "role", "digest")
    key: tuple | None = None
    rows: list[dict[str, Any]] = []
    initial_of_task = True

    def close(turns: list[Turn], head: dict, last: dict, seen: dict[str, int]) -> None:
        nonlocal initial_of_task
        # Only the first conversation of a task may go on from another task.
        entries = (NONE, SYSTEM, USER, ASSISTANT) if initial_of_task else (NONE,)
        initial_of_task = False
        ways = [{"entry": q, "exit": r, "cost": cost, "audit": audit} for q in entries for r, (cost, audit) in priced(turns, q).items()]
        rows.append({c: head[c] for c in names} | {"counts": [seen[c] for c in COUNTS], "least": seen["least"], "last_turn": last["turn"], "first_initial": turns[0].initial, "last_initial": turns[-1].initial, "ways": ways})

    turns: list[Turn] = []
    head: dict = {}
    last: dict = {}
    seen: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["conv_id"],):
                if turns:
                    close(turns, head, last, seen)
                key, turns, head, last, seen = (row["conv_id"],), [], row, {"turn": None}, dict.fromkeys(COUNTS, 0) | {"least": None}
            initial = row["role"][:1]
            for k in range(row["n"]):
                kind = row["fault"]
                if kind != "blank" and (k or not row["new"]):
                    kind = "duplicate"
                if kind != "none":
                    seen[kind] += 1
                if turns and turns[-1].initial + initial not in LEGAL:
                    seen["illegal"] += 1
                turns.append(Turn(initial, kind))
            if row["turn"] is not None:
                seen["least"] = row["turn"] if seen["least"] is None else seen["least"]
                seen["turns"] += last["turn"] != row["turn"]
            last = row
        if rows:
            yield segment_rows(rows, batch.schema)
            rows.clear()
    if turns:
        close(turns, head, last, seen)
        yield segment_rows(rows, batch.schema)


def segment_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [schema.field(c) for c in ORDER] + [pa.field("counts", pa.list_(pa.int64())), pa.field("least", pa.int64()), pa.field("last_turn", pa.int64()), pa.field("first_initial", pa.string()), pa.field("last_initial", pa.string()), pa.field("ways", pa.list_(WAY))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def joined(segments: list[dict]) -> dict[str, Any]:
    """The numbers of a conversation and its audit from its segments in order."""
    out = dict.fromkeys(("gaps", *COUNTS, "cost"), 0) | {"audit": ""}
    if segments:
        for k, segment in enumerate(segments):
            for c, n in zip(COUNTS, segment["counts"]):
                out[c] += n
            if k:
                before = segments[k - 1]
                out["illegal"] += before["last_initial"] + segment["first_initial"] not in LEGAL
                # A turn that goes on in the next segment was counted twice.
                out["turns"] -= segment["least"] is not None and before["last_turn"] == segment["least"]
        turns = [s for s in segments if s["least"] is not None]
        if turns:
            out["gaps"] = turns[-1]["last_turn"] - turns[0]["least"] + 1 - out["turns"]
        out["cost"], out["audit"] = chained({q: {w["exit"]: (w["cost"], w["audit"]) for w in s["ways"] if w["entry"] == q} for q in (NONE, SYSTEM, USER, ASSISTANT)} for s in segments)
    return out


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its segments before its texts, to one row per conversation."""
    key, segments, done, text = None, [], None, None
    rows: list[dict] = []

    def close() -> None:
        nonlocal done, text
        if done is None:
            done = joined(segments)
            text = Repaired(done["audit"])
        rows.append({"conv_id": key[0], **{c: done[c] for c in RESULT}, "audit": done["audit"], "repaired_sha256": text.digest()})

    for batch in batches:
        kind = pa.schema([batch.schema.field("conv_id"), *[pa.field(c, pa.int64()) for c in RESULT], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if key != (row["conv_id"],):
                if key:
                    close()
                key, segments, done, text = (row["conv_id"],), [], None, None
            if row["kind"] == 1:
                segments.append(row)
            elif row["kind"] == 2:
                if done is None:
                    done = joined(segments)
                    text, segments = Repaired(done["audit"]), []
                text.turn(row["role"], row["text"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)
            rows.clear()
    if key:
        close()
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def repair_conversations(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair, and a hash of the repaired text.

    conversations: conv_id, turn (whole numbers), role, text. With ``damage``
    the rows are damaged first (see ``damaged``). Returns conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    * Null roles and texts are one space. A role counts by its first character; a role without one,
      or with another than s, u or a, cannot be kept.
    * Turns are in the order of their numbers, null first. Rows of one turn are in the order of role, then of the
      SHA-256 of the text, so results do not depend on how the table is dealt; repeated rows stand together, and all
      but the first are duplicates.
    * Every conv_id has a row, a null one too. Without rows after the damage: zeros, an empty audit, the hash of the empty string.
    * Of repairs of equal cost the one whose audit is least in ASCII counts. Texts are hashed whole.
    * An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    space = F.lit(" ")
    source = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    rows = damaged(source) if damage else source
    rows = rows.withColumns({"has_turn": F.col("turn").isNotNull(), "digest": F.unhex(F.sha2(F.col("text"), 256))})
    id_type = dict(source.dtypes)["conv_id"]
    order_types = f"conv_id {id_type}, has_turn boolean, turn long, role string, digest binary"
    light = faulty(rows.withColumn("fault", fault(F.col("text"))).drop("text"))
    dealt = light.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ways = "array<struct<entry: int, exit: int, cost: bigint, audit: string>>"
    segments = dealt.mapInArrow(segmented, f"{order_types}, counts array<bigint>, least long, last_turn long, first_initial string, last_initial string, ways {ways}")

    every = source.select("conv_id").distinct().withColumn("kind", F.lit(0))
    both = every.unionByName(segments.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(rows.select(*ORDER, "text").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    out = f"conv_id {id_type}, {', '.join(f'{c} long' for c in RESULT)}, audit string, repaired_sha256 string"
    return both.mapInArrow(repaired, out)
