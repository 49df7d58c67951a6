"""Counts, accuracies and stage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def counts_block(raw: DataFrame, merged: DataFrame, reranked: DataFrame, final: DataFrame) -> DataFrame:
    """Rows per query and item type at each step: tables of (query_id, item_type, uuid, ...); raw also has route."""
    tagged = [
        raw.select("query_id", "item_type", F.concat(F.lit("system"), "route").alias("step")),
        raw.select("query_id", "item_type", F.lit("raw").alias("step")),
        *[t.select("query_id", "item_type", F.lit(s).alias("step")) for t, s in ((merged, "merged_unique"), (reranked, "reranked"), (final, "final"))],
    ]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    steps = ("system1", "system2", "raw", "merged_unique", "reranked", "final")
    return rows.groupBy("query_id", "item_type").agg(*[F.count_if(F.col("step") == s).alias(f"{s}_count") for s in steps])


def stage_report(events: DataFrame) -> DataFrame:
    """Sums per (stage, operation): calls, seconds, tokens, models in first-seen order, and the stage's wall clock.

    Wall clock is the sum of stage runtimes; an operation without any counts its first model call's time instead.
    """
    llm, run = F.col("event_type") == "llm_call", F.col("event_type") == "stage_runtime"
    zero = F.lit(0.0)
    # Sums per model first, so that an operation's models are as many rows as it has models.
    first = F.struct("seq", F.when(llm, F.col("runtime_seconds")).otherwise(zero).alias("seconds"))
    each = events.groupBy("stage", "operation", "model").agg(
        F.count_if(llm).alias("llm_calls"),
        F.sum(F.when(llm, F.col("runtime_seconds")).otherwise(zero)).alias("llm_seconds"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.sum(F.when(run, F.col("runtime_seconds")).otherwise(zero)).alias("_stage"),
        F.min(first).alias("_first"),
    )
    sums = ("llm_calls", "llm_seconds", "prompt_tokens", "completion_tokens", "total_tokens", "_stage")
    seen = F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct(F.col("_first.seq").alias("seq"), "model"))))
    calls = each.groupBy("stage", "operation").agg(*[F.sum(c).alias(c) for c in sums], F.min("_first").alias("_first"), seen.alias("_models"))
    models = F.array_join(F.transform("_models", lambda x: x["model"]), "|")
    # The rule of the event order: a call seen while the stage's clock is still 0 sets it once.
    return calls.select("stage", "operation", *sums[:5], models.alias("models"), (F.col("_stage") + F.col("_first.seconds")).alias("wall_clock_seconds"))


def eval_summary(answers: DataFrame, *by: str) -> DataFrame:
    """Questions, correct, failed and accuracy (0 if empty), over all or by columns."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    n = F.count("*")
    return answers.groupBy(*by).agg(
        n.alias("question_count"), F.count_if(right).alias("correct_count"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_count"),
        F.when(n > 0, F.count_if(right) / n).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def category_accuracy(answers: DataFrame, excluded: str) -> DataFrame:
    """Accuracy per category and, in rows of null category, over all and over all but ``excluded``."""
    with_scope = lambda df, name: eval_summary(df).withColumns({"scope": F.lit(name), "category": F.lit(None).cast("string")})
    each = eval_summary(answers, "category").withColumn("scope", F.lit("category"))
    return each.unionByName(with_scope(answers, "all")).unionByName(with_scope(answers.filter(F.col("category") != excluded), "without_excluded"))


def running_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy after each question of a group, in the order of (user_index, question_index)."""
    right = F.coalesce(F.col("is_correct"), F.lit(False)).cast("long")
    rows = answers.select("group_id", "user_index", "question_index", "is_correct")
    rows = running(rows, ["group_id"], ["user_index", "question_index"], {"correct": right})
    return rows.select("group_id", "user_index", "question_index", F.col("place").alias("seen"), "correct", (F.col("correct") / F.col("place")).alias("running_accuracy"))


def gold_hits(found: DataFrame, gold: DataFrame) -> DataFrame:
    """How many of a query's gold source ids its results hold: query_id, hits, n_gold."""
    wanted = gold.select("query_id", F.explode(F.array_distinct("evidence")).alias("source_id"))
    hits = wanted.join(found.select("query_id", "source_id"), ["query_id", "source_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return gold.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.size("evidence").cast("long").alias("n_gold"))


def token_delta(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), after - before)
