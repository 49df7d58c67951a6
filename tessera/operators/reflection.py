"""Reflection: asking again about turns, with what was found so far, for a number of rounds.

An answer row has group_id, episode_uuid, the found columns, and ``failed``:
true where the provider's answer for that turn could not be used. Such a turn
is not asked again; other turns go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text
from tessera.stages import Stages

TURN = ["group_id", "episode_uuid"]
#: Places of later rounds come behind those of earlier ones.
ROUND_PLACES = 1_000_000


def reflect(turns: DataFrame, found: DataFrame, ask: Callable[[DataFrame, DataFrame, int], DataFrame], key: Callable[[DataFrame], list[Column]], rounds: int, stages: Stages, until_quiet: bool = False) -> DataFrame:
    """``found`` and what ``rounds`` rounds of ``ask(turns, found, round)`` add, with ``round``.

    turns: episodes with uuid. ``key`` gives the columns by which rows are the
    same; of those the first round's, then the first by pos, stays. Each round
    asks only the active turns: not those that failed and, with
    ``until_quiet``, not those to which the round before added nothing. A
    round's new rows are written once, as a delta.
    """
    columns = found.columns
    keyed = lambda df: df.withColumns({f"_k{n}": c for n, c in enumerate(key(df))})
    found = stages.keep("found-0", found.withColumn("round", F.lit(0)) if "round" not in columns else found)
    active = stages.keep("active-0", turns)
    for step in range(1, rounds + 1):
        if active.isEmpty():
            break
        answer = stages.keep(f"answer-{step}", ask(active, found, step))
        own = answer.withColumn("_active", F.lit(True)).filter(~F.coalesce("failed", F.lit(False)))
        own = own.join(active.select("group_id", F.col("uuid").alias("episode_uuid")), TURN, "left_semi")
        rows = keyed(own)
        keys = [c for c in rows.columns if c.startswith("_k")]
        order = Window.partitionBy(*TURN, *keys).orderBy("pos")
        rows = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").join(keyed(found).select(*TURN, *keys), [*TURN, *keys], "left_anti")
        rows = rows.withColumns({"round": F.lit(step), "pos": (F.col("pos") + step * ROUND_PLACES).cast(found.schema["pos"].dataType)})
        delta = stages.keep(f"delta-{step}", rows.select(*found.columns))
        over = answer.filter("failed").select("group_id", F.col("episode_uuid").alias("uuid"))
        active = active.join(over, ["group_id", "uuid"], "left_anti")
        if until_quiet:
            active = active.join(delta.select("group_id", F.col("episode_uuid").alias("uuid")), ["group_id", "uuid"], "left_semi")
        active = stages.keep(f"active-{step}", active)
        found = found.unionByName(delta)
    return found


def by_name(df: DataFrame) -> list[Column]:
    return [F.trim("name")]


def by_fact(df: DataFrame) -> list[Column]:
    return [normalize_text(F.col(c)) for c in ("source", "target", "fact")]
