"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k``, the mergeable frequent-items
sketch of that family) names the digests that may be frequent. Their groups
are recounted exactly, and the verified winners are broadcast, so that rows of
large groups are decided where they are read. Every other digest has at most
about rows / ``tracked`` copies and goes through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 and a row_no of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    return written(digests.withColumn("row_no", F.monotonically_increasing_id()), "digests")


def frequent_groups(digests: DataFrame, frequent: int, tracked: int) -> DataFrame:
    """text_sha256, top (doc_id, row_no) and group_size of the digests that may be frequent, at most ``frequent`` rows; recounted, so exact."""
    candidates = digests.agg(F.expr(f"approx_top_k(text_sha256, {int(frequent)}, {int(tracked)})").alias("found"))
    candidates = candidates.select(F.explode("found").alias("c")).filter("c.count > 1").select("c.item")
    winners = digests.join(F.broadcast(candidates.withColumnRenamed("item", "text_sha256")), "text_sha256", "left_semi")
    return written(winners.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_no")).alias("top"), F.count("*").alias("group_size")), "winners")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1000, tracked: int = 8192) -> DataFrame:
    """Group rows of equal text; the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    * A null text counts as the empty text, so both fall in one group.
    * A null id sorts below every id; a group of null ids only has a null keep_id.
    * Of repeated rows (same id and text) exactly one is kept.
    * Texts of any length are hashed whole. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.

    ``frequent`` bounds what is broadcast (rows), ``tracked`` the sketch.
    """
    digests = digests_of(docs, id_col, text_col)
    winners = frequent_groups(digests, frequent, tracked)
    top, size = F.max(F.struct("doc_id", "row_no")), F.count("*")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.select("*", top.over(same).alias("top"), size.over(same).alias("group_size"))
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("top.row_no")).alias("kept"),
        "text_sha256",
    )


def keep_last_copies(docs: DataFrame, frequent: int = 1000, tracked: int = 8192) -> DataFrame:
    """The rows of ``docs`` that stay, all columns (whatever their names) as they were.

    As in ``exact_dedup``: null texts count as empty, null ids sort below all
    others, of repeated rows one stays, and an empty table gives an empty
    table. Rows of frequent texts that do not stay go where they are read; the
    others meet by their digests, in one shuffle.
    """
    winners = frequent_groups(digests_of(docs), frequent, tracked)
    winners = winners.select(F.col("text_sha256").alias("_sha"), F.col("top.doc_id").alias("_top"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), sha.alias("_sha"))
    rows = rows.join(F.broadcast(winners.withColumn("_heavy", F.lit(True))), "_sha", "left")
    rows = rows.filter(F.col("_heavy").isNull() | F.col("_id").eqNullSafe(F.col("_top")))
    last = F.row_number().over(Window.partitionBy("_sha").orderBy(F.desc_nulls_last("_id")))
    return rows.withColumn("_n", last).filter("_n = 1").select("_row.*")
