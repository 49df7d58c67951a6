"""Questions to answers to judgements; a question that fails becomes a row with its error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.providers import Answerer, Judge


def answer_and_judge(questions: DataFrame, contexts: DataFrame, answerer: Answerer, judge: Judge) -> DataFrame:
    """questions: query_id, question, reference_answer and more; contexts: query_id, context. Adds predicted_answer, is_correct, error."""
    rows = questions.join(contexts, "query_id", "left")
    rows = rows.withColumn("error", F.when(F.col("context").isNull(), F.lit("no context")))
    answer = F.when(F.col("error").isNull(), answerer.answer(F.col("context"), F.col("question")))
    rows = rows.withColumn("predicted_answer", answer)
    correct = judge.judge(F.col("reference_answer"), F.col("predicted_answer"))
    return rows.withColumn("is_correct", F.coalesce(correct, F.lit(False))).drop("context")
