"""Tables in hash buckets with a manifest: a change rewrites only the buckets that it touches, and readers see whole states.

A folder holds ``data``, which is only ever added to, and ``manifest``, with a
numbered file per state that lists the folders of each table's buckets. A
reader takes the newest number; a writer adds its folders first and its number
last. So a reader sees the old state or the new one, and a run that dies leaves
the old one in place. There is one writer at a time: of two, the second gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Snapshots:
    """Named tables below ``path`` that change together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, below: str) -> list[str]:
        at = self._path(below)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    # --- states

    def version(self) -> int:
        """The newest state's number; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        """The tables of a state: name -> schema, keys, buckets, parts (bucket, folder)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"manifest/{version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict, after: int) -> int:
        """Makes ``state`` the one that follows ``after``; an error if there is one already."""
        new, target = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{after + 1:010d}.json")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(new, target):
            self.fs.delete(new, False)
            raise RuntimeError(f"{self.path} was changed by another writer")
        return after + 1

    # --- reading

    def folders(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> list[str]:
        wanted = None if buckets is None else set(buckets)
        return [folder for bucket, folder in self.state(version)[name]["parts"] if wanted is None or bucket in wanted]

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or the rows of some of its buckets: only their files are read."""
        version = self.version() if version is None else version
        schema = StructType.fromJson(self.state(version)[name]["schema"])
        found = self.folders(name, buckets, version)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in found])

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that hold the rows with ``keys`` (the table's keys): as many numbers as there are buckets at most."""
        table = self.state()[name]
        rows = keys.select(bucket_of(table["keys"], table["buckets"]).alias(BUCKET)).distinct()
        return sorted(r[0] for r in rows.collect())

    # --- writing

    def _add(self, name: str, df: DataFrame, keys: Sequence[str], buckets: int) -> list[list]:
        """Writes ``df`` in buckets to a new folder; gives its parts. A large bucket is dealt to several tasks."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return [[int(n.partition("=")[2]), f"{folder}/{n}"] for n in sorted(self._names(folder)) if n.startswith(BUCKET)]

    def create(self, name: str, df: DataFrame, keys: Sequence[str], buckets: int = 64) -> int:
        """A new table, or a new content and layout for one."""
        after = self.version()
        parts = self._add(name, df, keys, buckets)
        return self.commit(self.state(after) | {name: {"schema": df.schema.jsonValue(), "keys": list(keys), "buckets": buckets, "parts": parts}}, after)

    def append(self, tables: dict[str, DataFrame]) -> int:
        """Rows added to several tables in one state; their files come beside those that are there."""
        after = self.version()
        state = self.state(after)
        for name, df in tables.items():
            table = state[name]
            state[name] = table | {"parts": table["parts"] + self._add(name, df, table["keys"], table["buckets"])}
        return self.commit(state, after)

    def upsert(self, name: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``merge`` (old, new) over the buckets that ``new`` has rows in; the files of all others stay. Gives the touched buckets.

        Rows that merge must have the table's keys in common.
        """
        after = self.version()
        table = self.state(after)[name]
        staged = self._add(f"{name}-new", new, table["keys"], table["buckets"])
        touched = [bucket for bucket, _ in staged]
        if not touched:
            return []
        rows = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/{folder}" for _, folder in staged])
        columns = StructType.fromJson(table["schema"]).names
        merged = merge(self.read(name, touched, after), rows).select(*columns)
        parts = [p for p in table["parts"] if p[0] not in set(touched)] + self._add(name, merged, table["keys"], table["buckets"])
        self.commit(self.state(after) | {name: table | {"parts": parts}}, after)
        self.fs.delete(self._path(staged[0][1].rpartition("/")[0]), True)
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the states before the last ``keep`` and the buckets that no other state names; gives how many buckets went.

        Readers of older states fail afterwards, so keep as many states as the longest reader may see go by.
        """
        newest = self.version()
        versions = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]
        used = {folder for v in versions if v > newest - keep for table in self.state(v).values() for _, folder in table["parts"]}
        for v in (v for v in versions if v <= newest - keep):
            self.fs.delete(self._path(f"manifest/{v:010d}.json"), False)
        gone = 0
        for folder in self._names("data"):
            buckets = [f"data/{folder}/{n}" for n in self._names(f"data/{folder}") if n.startswith(BUCKET)]
            dead = [b for b in buckets if b not in used]
            for b in [f"data/{folder}"] if len(dead) == len(buckets) else dead:
                self.fs.delete(self._path(b), True)
            gone += len(dead)
        return gone
