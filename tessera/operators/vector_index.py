"""Exact nearest vectors with pruning: cells around pivots, and triangle bounds on angles.

Each vector lies in the cell of its nearest pivot and of its ring, a range of
angles to that pivot. For a query at angle b to the pivot, no vector of a ring
[lo, hi] is nearer than max(b - hi, lo - b, 0). The nearest cells that hold
``limit`` vectors give a first threshold; then only the cells whose bound
reaches it are compared. The angle between vectors is a metric, so the result
is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import norm
from tessera.stages import Stages

from .search import top_per_query
from .snapshots import Snapshots

#: Pivots per dimension at most (of fewer vectors, the square root of the largest group's number), the width of a ring
#: in radians, vectors or queries of a block, what rounding may take from a similarity.
PIVOTS, RING, BLOCK, MARGIN = 256, 0.2, 256, 2e-6
#: The pivot of vectors of length 0, whose similarity is 0 to all.
NO_PIVOT = -1


def choose_pivots(rows: DataFrame, vector: str, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each dimension up to ``pivots`` vectors as directions: those whose ids hash lowest, a sample of fixed size."""
    sized = rows.select("uuid", F.col(vector).alias("v"), F.size(vector).alias("d")).filter(usable(F.col("v")) & (norm(F.col("v")) > 0))
    order = Window.partitionBy("d").orderBy(F.xxhash64("uuid"), "uuid")
    found: dict[int, list] = {}
    for r in sized.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= pivots).collect():
        found.setdefault(r["d"], []).append(r["v"])
    return {d: directions(np.asarray(v, "f8")) for d, v in found.items()}


def usable(v: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def directions(v: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, lengths, out=np.zeros_like(v), where=lengths > 0)


def angles_to(pivots: dict[int, np.ndarray], vector: Column) -> Column:
    """The angles of a vector to all pivots of its dimension; empty for one of length 0 or without pivots."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out: list = [[]] * len(values)
            sizes = np.array([len(v) for v in values])
            for d in set(sizes) & pivots.keys():
                at = np.flatnonzero(sizes == d)
                near = directions(np.stack(values.iloc[at].to_numpy()).astype("f8"))
                found = np.arccos(np.clip(near @ pivots[d].T, -1.0, 1.0))
                for k, row, alive in zip(at, found, near.any(axis=1)):
                    if alive:
                        out[k] = row
            yield pd.Series(out)

    # Pandas UDFs read their types from annotations, which are text here.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(vector)


def packed(rows: DataFrame, keys: list[str], name: str, vector: str, length: str) -> DataFrame:
    """Rows with equal ``keys`` as one, for numpy: names, lengths, and the vectors one after another, as they are (of doubles only where they were)."""
    own = F.collect_list(F.struct(F.col(name).alias("name"), F.col(vector).alias("v"), F.col(length).alias("length")))
    rows = rows.groupBy(*keys).agg(own.alias("_own"))
    return rows.select(*keys, F.transform("_own", lambda x: x["name"]).alias("names"), F.flatten(F.transform("_own", lambda x: x["v"])).alias("flat"), F.transform("_own", lambda x: x["length"]).alias("lengths"))


def compare(limit: int | None, least: float | None):
    """A function over record batches: the similarities of each row's queries (q_...) with its vectors, by blocks.

    Of those of a query in a block only the ``limit`` best with their ties, and only those of ``least`` or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                of = lambda c: column[c][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                names, asked, lengths, q_lengths = of("names"), of("q_names"), of("lengths"), of("q_lengths")
                doubles = lambda c, n: of(c).astype("f8", copy=False).reshape(n, -1)  # noqa: B023, E731
                near = doubles("q_flat", len(asked)) @ doubles("flat", len(names)).T
                scale = np.outer(q_lengths, lengths)
                near = np.round(np.divide(near, scale, out=np.zeros_like(near), where=scale > 0), 6)
                kept = np.ones_like(near, bool) if least is None else near >= least
                if limit is not None and limit < len(names):
                    kept &= near >= -np.partition(-near, limit - 1, axis=1)[:, limit - 1 : limit]
                q, v = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q], pa.string()), pa.array([column["group_id"][i].as_py()] * len(q), pa.string()), pa.array(names[v], pa.string()), pa.array(near[q, v])], names=["query_id", "group_id", "uuid", "similarity"])

    return run


#: A cell: the vectors of a group and dimension around one pivot in one ring.
CELL = ["group_id", "d", "pivot", "ring"]


class VectorIndex:
    """The index in the folder ``path``: blocks of vectors, dealt by group, dimension and pivot, and a table of their cells."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.store, self.buckets, self.pivots = Snapshots(spark, path), buckets, {}

    def create(self, rows: DataFrame, vector: str, pivots: int = PIVOTS) -> VectorIndex:
        """Indexes the rows (group_id, uuid) that have a vector without null and non-finite components."""
        with Stages(self.store.spark, "vectors") as stages:
            have = rows.filter(usable(F.col(vector))).select("group_id", "uuid", F.col(vector).alias("v"), norm(F.col(vector)).alias("length"), F.size(vector).alias("d"))
            have = stages.keep("have", have)
            largest = have.groupBy("group_id", "d").count().agg(F.max("count")).first()[0] or 0
            self.pivots = choose_pivots(have, "v", min(pivots, int(np.ceil(np.sqrt(largest))) or 1))
            have = have.withColumn("_angles", angles_to(self.pivots, F.col("v")))
            nearest = F.array_min("_angles")
            have = have.withColumns({"angle": F.coalesce(nearest, F.lit(0.0)), "pivot": F.when(nearest.isNull(), NO_PIVOT).otherwise(F.array_position("_angles", nearest).cast("int") - 1)})
            have = stages.keep("dealt", have.withColumn("ring", F.floor(F.col("angle") / RING).cast("int")).drop("_angles"))
            cells = stages.keep("cells", have.groupBy(*CELL).agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")))
            # A cell of any size is dealt into blocks by the hash of its ids.
            block = F.pmod(F.xxhash64("uuid"), F.ceil(F.col("n") / BLOCK)).cast("int")
            dealt = have.join(cells.select(*CELL, "n"), CELL).withColumn("block", block)
            self.store.create("vectors", packed(dealt, [*CELL, "block"], "uuid", "v", "length"), CELL[:3], self.buckets)
            self.store.create("cells", cells, CELL[:2], self.buckets)
        return self

    def bounded(self, queries: DataFrame) -> DataFrame:
        """The cells of each query's group and dimension, with the highest similarity that one of their vectors can have."""
        asked = queries.filter(usable(F.col("vector"))).select("query_id", "group_id", F.size("vector").alias("d"), angles_to(self.pivots, F.col("vector")).alias("angles"))
        cells = self.store.read("cells").join(asked, CELL[:2])
        to_pivot = F.get("angles", F.col("pivot"))
        nearest = F.greatest(to_pivot - F.col("hi"), F.col("lo") - to_pivot, F.lit(0.0))
        # Vectors of length 0 have similarity 0; so has a query of length 0, which has no angles, to all.
        bound = F.when(F.col("pivot") == NO_PIVOT, 0.0).otherwise(F.coalesce(F.cos(nearest), F.lit(1.0)))
        return cells.select("query_id", *CELL, "n", bound.alias("bound"))

    def compared(self, cells: DataFrame, queries: DataFrame, limit: int | None = None, least: float | None = None) -> DataFrame:
        """The similarities of each query with the vectors in its ``cells``, as matrix products of blocks of both (see ``compare``). Only the files of their buckets are read."""
        some = -(-queries.count() // BLOCK) or 1
        asked = queries.select("query_id", F.col("vector").alias("q"), norm(F.col("vector")).alias("q_length"))
        asked = cells.select("query_id", *CELL).join(asked, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(some)))
        asked = packed(asked, [*CELL, "part"], "query_id", "q", "q_length").withColumnsRenamed({"names": "q_names", "flat": "q_flat", "lengths": "q_lengths"})
        blocks = self.store.read("vectors", self.store.buckets_of("vectors", cells)).join(asked, CELL)
        return blocks.mapInArrow(compare(limit, least), "query_id string, group_id string, uuid string, similarity double")

    def within(self, queries: DataFrame, least: float) -> DataFrame:
        """All vectors of each query's group with a similarity of ``least`` or more: query_id, group_id, uuid, similarity. Exact."""
        return self.compared(self.bounded(queries).filter(F.col("bound") >= least - MARGIN), queries, least=least)

    def plan(self, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """The cells that ``bounded`` gives, and those of them that a search compares."""
        cells = self.bounded(queries)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "pivot", "ring").rowsBetween(Window.unboundedPreceding, -1)
        lead = cells.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("_before") < limit).drop("_before")
        least = top_per_query(self.compared(lead, queries, limit), "similarity", limit).filter(F.col("rank") == limit).select("query_id", F.col("similarity").alias("least"))
        cells = cells.join(least, "query_id", "left")
        return cells, cells.filter(F.coalesce(F.col("bound") >= F.col("least") - MARGIN, F.lit(True)))

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """The ``limit`` most similar vectors of each query's group, ties by uuid: query_id, group_id, uuid, similarity, rank."""
        _, read = self.plan(queries, limit)
        return top_per_query(self.compared(read, queries, limit), "similarity", limit)


def compared_share(cells: DataFrame, read: DataFrame) -> float:
    """The part of all pairs of queries and vectors that a search compares."""
    every, some = (t.agg(F.sum("n")).first()[0] or 0 for t in (cells, read))
    return some / every if every else 0.0
