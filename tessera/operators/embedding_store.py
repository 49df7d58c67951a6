"""Vectors kept by content: a text is embedded once, however often and wherever it comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.providers import Embedder
from tessera.stages import Stages

from .snapshots import Snapshots

SCHEMA = "digest binary, vector array<float>"


class EmbeddingStore:
    """Vectors of texts by SHA-256 in the folder ``path``, for one embedder."""

    def __init__(self, spark, path: str, embedder: Embedder, buckets: int = 64):
        self.store, self.embedder = Snapshots(spark, path), embedder
        if not self.store.version():
            self.store.create("vectors", spark.createDataFrame([], SCHEMA), ["digest"], buckets)

    def count(self) -> int:
        return self.store.read("vectors").count()

    def embed(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """``rows`` with a vector for each text column: text column -> vector column. Null texts have none.

        Texts that the store lacks are embedded, each once, and added; only
        the buckets of the texts' digests are read.
        """
        digest = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
        texts = None
        for c in columns:
            part = rows.filter(F.col(c).isNotNull()).select(digest(c).alias("digest"), F.col(c).cast("string").alias("text"))
            texts = part if texts is None else texts.unionByName(part)
        with Stages(self.store.spark, "texts") as stages:
            texts = stages.keep("texts", texts.dropDuplicates(["digest"]))
            buckets = self.store.buckets_of("vectors", texts)
            new = texts.join(self.store.read("vectors", buckets).select("digest"), "digest", "left_anti")
            new = stages.keep("new", new.select("digest", self.embedder.embed(F.col("text")).alias("vector")))
            if not new.isEmpty():
                self.store.append({"vectors": new})
        vectors = self.store.read("vectors", buckets)
        for c, out in columns.items():
            found = vectors.select(F.col("digest").alias(f"_{out}"), F.col("vector").alias(out))
            rows = rows.drop(out).withColumn(f"_{out}", digest(c)).join(found, f"_{out}", "left").drop(f"_{out}")
        return rows
