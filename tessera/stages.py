"""Steps of a long plan, each written once and read by the narrow plans after it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Takes a name and a table, and gives the table to go on with: as it is, or written and read again.
Keep = Callable[[str, DataFrame], DataFrame]


def as_it_is(name: str, df: DataFrame) -> DataFrame:
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; on one machine, where none is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stages:
    """The written steps of one run.

    A step's plan ends at its files, so plans stay as small as their own step,
    and a lost executor costs a step. ``release`` deletes the steps; results
    that are still read from them have to be computed or written before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)  # ids are hexadecimal digits, which snappy leaves as they are
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Steps that do not need each other, written at the same time."""
        with ThreadPoolExecutor(len(tables)) as pool:
            return dict(zip(tables, pool.map(self.keep, tables.keys(), tables.values())))

    def release(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.release()
