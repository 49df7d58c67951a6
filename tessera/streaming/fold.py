"""The sequential fold as a stream: entities of every group are kept as state, and turns are said in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.resolution import RESOLVED, Names, folded


class EntityFold(StatefulProcessor):
    """Keeps a map of each group's entities: key -> uuid, vector."""

    def __init__(self, match: tuple[float, float]):
        self.match = match

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "key string", "uuid string, vector array<float>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = Names((k[0], v[0], v[1]) for k, v in self.entities.iterator())
        turns = pd.concat(list(rows))
        yield folded(names, key[0], turns, self.match, lambda k, uuid, vector: self.entities.updateValue((k,), (uuid, [float(x) for x in vector])))

    def close(self) -> None:
        pass


def fold_stream(turns: DataFrame, match: tuple[float, float]) -> DataFrame:
    """The mentions of a stream of turns (see ``resolution.turns_said``) with their entities (RESOLVED).

    Turns of a micro-batch are said in their order, and micro-batches as they
    come. The session needs the RocksDB state store.
    """
    return turns.groupBy("group_id").transformWithStateInPandas(statefulProcessor=EntityFold(match), outputStructType=RESOLVED, outputMode="append", timeMode="none")
