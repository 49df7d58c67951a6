"""What the operators of this package share: written tables, broadcasts behind a bound, memories of workers, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unless a caller states another bound, a table of more rows than this is never broadcast by hand.
BROADCAST_ROWS = 20_000
#: Bits of the map of a set of keys that ``marks`` makes: 2 MB, whatever the set.
MARKS = 1 << 24
#: What this Python worker remembers, by step (one at most).
_MEMORIES: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests), a
    temporary folder is made and set; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage and survives lost executors: later stages read the
    files, and no step before them runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted; else as it is, for an ordinary join."""
    return F.broadcast(df) if df.count() <= rows else df


def memory_of(step: str) -> dict:
    """What a Python worker remembers from task to task of ``step``. A worker serves many steps: what it remembers of another goes first."""
    if step not in _MEMORIES:
        _MEMORIES.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _MEMORIES[step] = {}
    return _MEMORIES[step]


def marks(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashes of ``key``, in at most ``MARKS`` / 32,768 rows (_group, _bits) of 4 KB, for ``marked``."""
    slot = F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1
    return keys.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_group")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def marked(rows: DataFrame, key: str, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: true where ``key`` is in the set of ``marks``, and for few other keys. Nothing is shuffled."""
    slot = F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("_group", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_group", "left")
    return rows.withColumn(name, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_group", "_bits")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, root) per node that has an edge.

    root is the smallest node of the component. Each round takes the least
    label of the neighbours, then jumps to the label's own label, and is
    written; the number of rounds grows with the logarithm of the longest
    path in practice. Nothing is gathered on the driver but the count of
    labels that changed. Null nodes are not allowed; self loops do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = written(labels.select("node", F.least("node", "m").alias("root")), f"{name}-0")
    for step in range(1, 100):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        hooked = hooked.join(jump, "root").select("node", "old", F.least("root", "further").alias("root"))
        hooked = written(hooked, f"{name}-{step}")
        labels = hooked.select("node", "root")
        if hooked.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
