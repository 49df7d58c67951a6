"""Reports as JSON and CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sorted_json
from tessera.operators.evaluate import eval_summary, stage_report


def write_stage_reports(events: DataFrame, folder: str) -> None:
    """The stage report as JSON and CSV, and the events as CSV with their metadata as sorted JSON."""
    report = stage_report(events)
    report.write.mode("overwrite").json(f"{folder}/report_json")
    report.write.mode("overwrite").option("header", True).csv(f"{folder}/report_csv")
    flat = events.withColumn("metadata", sorted_json(F.col("metadata")))
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/events_csv")


def write_evaluation(answers: DataFrame, folder: str) -> None:
    """Answers in the order of (user_index, question_index) as JSON lines and CSV, and their summary."""
    ordered = answers.orderBy("user_index", "question_index")
    ordered.write.mode("overwrite").json(f"{folder}/answers_json")
    ordered.withColumn("evidence", F.to_json("evidence")).write.mode("overwrite").option("header", True).csv(f"{folder}/answers_csv")
    eval_summary(answers).write.mode("overwrite").json(f"{folder}/summary_json")


def write_selections(selections: DataFrame, path: str) -> None:
    """Selection results as JSON lines; the partitions are the batches."""
    selections.write.mode("overwrite").json(path)
