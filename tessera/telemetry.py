"""Events of model calls and stages, gathered on the driver and handed to the stage report."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .schema import EVENTS


class Recorder:
    """Keeps events in their order; a row per call or stage, never per document."""

    def __init__(self) -> None:
        self.events: list[tuple] = []

    def _add(self, kind: str, stage: str, operation: str, seconds: float, model: str | None = None, tokens: tuple = (None, None), metadata: dict | None = None) -> None:
        total = None if tokens == (None, None) else (tokens[0] or 0) + (tokens[1] or 0)
        began = datetime.now(UTC).replace(microsecond=0).isoformat()
        self.events.append((kind, stage, operation, float(seconds), model, *tokens, total, {k: str(v) for k, v in (metadata or {}).items()}, began, len(self.events)))

    def model_call(self, stage: str, operation: str, seconds: float, model: str, prompt_tokens: int | None = None, completion_tokens: int | None = None, **metadata) -> None:
        self._add("llm_call", stage, operation, seconds, model, (prompt_tokens, completion_tokens), metadata)

    @contextmanager
    def stage(self, stage: str, operation: str, **metadata) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self._add("stage_runtime", stage, operation, time.monotonic() - began, metadata=metadata)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENTS)
