"""Fusion, merging and ranking of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_ranks(lists: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) of each uuid over the lists of a query: query_id, uuid, rrf_score."""
    return lists.groupBy("query_id", "uuid").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def last_not_null(column: str, order: str) -> Column:
    """The value of the last row, by ``order``, that has one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column)


def fuse_ranked(lists: DataFrame, limit: int, k: int = 60, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Fuse ranked lists (query_id, uuid, list_no, rank, other columns): one row per uuid.

    The other columns have their value of the last list that has one. Order:
    rrf_score, similarity, fulltext_score, all descending, then the place in
    the first list that has the row, then uuid. Rows that are dealt by columns
    ``dealt``, which a query has one value of, are not shuffled again.
    """
    keep = [c for c in lists.columns if c not in (*dealt, "query_id", "uuid", "list_no", "rank")]
    fused = lists.groupBy(*dealt, "query_id", "uuid").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
        *[last_not_null(c, "list_no") for c in keep],
    )
    zero = F.lit(0.0)
    scores = [F.coalesce(F.col(c), zero).desc() for c in ("similarity", "fulltext_score") if c in keep]
    order = Window.partitionBy(*dealt, "query_id").orderBy(F.desc("rrf_score"), *scores, "_first", "uuid")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_first")


def merge_by_uuid(items: DataFrame, order: str = "seq", score: str = "rrf_score", last_wins: bool = False) -> DataFrame:
    """One row per query and uuid; later values win where not null. The score is the largest, or the last with ``last_wins``."""
    keep = [c for c in items.columns if c not in ("query_id", "uuid", order, score)]
    best = last_not_null(score, order) if last_wins else F.max(score).alias(score)
    return items.groupBy("query_id", "uuid").agg(best, *[last_not_null(c, order) for c in keep])


def propagate_scores(expanded: DataFrame, seeds: DataFrame) -> DataFrame:
    """The largest rrf_score of the seeds that an expanded item matched, 0 without one.

    expanded: query_id, uuid, matched_entity_uuids. seeds: query_id, uuid, rrf_score.
    """
    score = seeds.select("query_id", F.col("uuid").alias("_seed"), "rrf_score")
    flat = expanded.select("query_id", "uuid", F.explode_outer("matched_entity_uuids").alias("_seed")).join(score, ["query_id", "_seed"], "left")
    best = flat.groupBy("query_id", "uuid").agg(F.coalesce(F.max("rrf_score"), F.lit(0.0)).alias("rrf_score"))
    return expanded.drop("rrf_score").join(best, ["query_id", "uuid"])


def annotate(items: DataFrame, branch: str, score: Column | None = None) -> DataFrame:
    """Tags the branch that found a row; sets the score, or keeps the one there is."""
    out = items.withColumn("system1_branch", F.lit(branch))
    return out if score is None else out.withColumn("rrf_score", score)


def pool_order() -> list[Column]:
    """The order of a candidate pool: missing scores count as 0, ties by uuid."""
    zero = F.lit(0.0)
    return [F.coalesce(F.col(c).cast("double"), zero).desc() for c in ("rrf_score", "matched_entity_count", "fulltext_score", "similarity")] + [F.asc("uuid")]


def sort_pool(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Places within each query by the pool order; ``limit`` rows of each query, or all."""
    for c in ("rrf_score", "matched_entity_count", "fulltext_score", "similarity"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("double"))
    placed = items.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*pool_order())))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def merge_routes(system1: DataFrame, system2: DataFrame) -> DataFrame:
    """Both routes' rows by query and uuid: the second overwrites wholly; its hits get a route_score of 1 or more."""
    keys = ["query_id", "uuid"]
    shared = [c for c in system1.columns if c not in (*keys, "rrf_score")]
    one = system1.select(*keys, F.col("rrf_score").alias("_r1"), *[F.col(c).alias("_1" + c) for c in shared], F.lit(True).alias("_in1"))
    two = system2.select(*keys, *([F.col("rrf_score").alias("_r2")] if "rrf_score" in system2.columns else [F.lit(None).cast("double").alias("_r2")]), *[(F.col(c) if c in system2.columns else F.lit(None)).alias("_2" + c) for c in shared], F.lit(True).alias("_in2"))
    both = one.join(two, keys, "full_outer")
    hit = F.coalesce("_in2", F.lit(False))
    # A column that the second route does not carry at all is left as it was.
    values = [(F.when(hit, F.col("_2" + c)).otherwise(F.col("_1" + c)) if c in system2.columns else F.col("_1" + c)).alias(c) for c in shared]
    rrf = F.coalesce("_r1", "_r2", F.lit(0.0))
    return both.select(*keys, *values, rrf.alias("rrf_score"), F.when(hit, F.greatest(F.coalesce("_r1", F.lit(0.0)), F.lit(1.0))).otherwise(rrf).alias("route_score"), F.col("_in1").isNotNull().alias("from_system1"), hit.alias("from_system2"))


def rerank(items: DataFrame, scores: DataFrame, limit: int, partition: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``limit`` best of each query: rerank score (unscored rows last), route score, rrf score, then uuid."""
    scored = items.join(scores.select("query_id", "uuid", "rerank_score"), ["query_id", "uuid"], "left")
    order = Window.partitionBy(*partition).orderBy(F.coalesce("rerank_score", F.lit(-1.0)).desc(), F.coalesce("route_score", F.lit(0.0)).desc(), F.coalesce("rrf_score", F.lit(0.0)).desc(), "uuid")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
