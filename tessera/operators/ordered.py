"""Places and running sums in groups of any size.

A window over a whole group is one task's work. Here rows are dealt by ranges
of group and order, so a large group lies in many ranges; each range numbers
its own rows, and the counts of the ranges before it, a small table, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.stages import Stages

#: Rows of a stretch of places, in which ``looking_back`` looks.
STRETCH = 4_096


def in_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[str], stages: Stages) -> DataFrame:
    """``rows`` written with ``_range``, which grows with (by, order): the border of ranges is drawn once and kept."""
    dealt = rows.repartitionByRange(*by, *order)
    return stages.keep("ranges", dealt.withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column], stages: Stages | None = None) -> DataFrame:
    """``rows`` with running sums of columns from the first row of their group to their own, and ``place`` from 1.

    order must tell the rows of a group apart. Nulls of the order come first.
    """
    stages = stages or Stages(rows.sparkSession, "ordered")
    names = list(sums)
    ranged = in_ranges(rows.withColumns(sums | {"place": F.lit(1).cast("long")}), by, order, stages)
    names.append("place")
    local = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in names])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)) for c in names})
    totals = totals.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), *[f"_{c}" for c in names])
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    out = ranged.withColumns({c: F.sum(c).over(local) for c in names}).join(totals, same)
    return out.withColumns({c: F.col(c) + F.col(f"_{c}") for c in names}).drop("_range", "_r", *[f"_by{k}" for k in range(len(by))], *[f"_{c}" for c in names])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], stages: Stages | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 1 within the group in order."""
    return running(rows, by, order, {}, stages)


def looking_back(placed: DataFrame, by: Sequence[str], value: Column, limit: int, name: str) -> DataFrame:
    """``placed`` rows (with place) with the ``limit`` values before each in its group, oldest first.

    Places are cut into stretches; the last rows of a stretch go to the next as
    well, as its border. Null values are left out.
    """
    size = max(STRETCH, limit)
    stretch = F.floor((F.col("place") - 1) / size)
    border = F.when((F.col("place") - 1) % size >= size - limit, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    rows = placed.withColumn("_value", value).withColumn("_own", stretch).withColumn("_stretch", F.explode(border))
    window = Window.partitionBy(*by, "_stretch").orderBy("place").rowsBetween(-limit, -1)
    rows = rows.withColumn(name, F.collect_list("_value").over(window))
    return rows.filter("_own = _stretch").drop("_own", "_stretch", "_value")
