"""Turns as a stream: idempotent upserts per micro-batch, and the recent turns of every group as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import store
from tessera.operators.snapshots import Snapshots


def upsert_stream(turns: DataFrame, tables: Snapshots, name: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the episodes ``name`` of ``tables`` by (group_id, source_id), so replays change nothing.

    Only the buckets of a batch's keys are rewritten, and a reader sees the
    table before or after a batch. Runs over what is there and stops.
    """

    def merge(batch: DataFrame, _: int) -> None:
        tables.upsert(name, batch, store.upsert_episodes)

    return turns.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_windows(turns: DataFrame, limit: int) -> DataFrame:
    """For every turn of a stream (group_id, seq, source_id, content), its group's last ``limit`` turns before it, as text.

    The state of a group is its last turns only. Turns of a micro-batch are taken in the order of seq.
    """
    state = "seq array<bigint>, content array<string>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["seq", "source_id"])
        seqs, contents = (list(x) for x in kept.get) if kept.exists else ([], [])
        out = []
        for seq, source, content in zip(rows["seq"], rows["source_id"], rows["content"]):
            out.append((key[0], source, "\n".join(contents)))
            seqs, contents = (seqs + [int(seq)])[-limit:], (contents + [content])[-limit:]
        kept.update((seqs, contents))
        yield pd.DataFrame(out, columns=["group_id", "source_id", "recent"])

    return turns.select("group_id", "seq", "source_id", "content").groupBy("group_id").applyInPandasWithState(step, "group_id string, source_id string, recent string", state, "append", GroupStateTimeout.NoTimeout)


def late_safe_counts(turns: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Turns per group and window of event time, with a watermark for late ones."""
    timed = turns.withWatermark("valid_at", lateness)
    return timed.groupBy("group_id", F.window("valid_at", width)).agg(F.count("*").alias("turns"))
