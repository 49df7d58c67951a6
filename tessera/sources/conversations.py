"""Conversations and questions from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import answer_text, session_time, sorted_json, stable_id

_TURNS = "array<struct<speaker: string, text: string, dia_id: string, query: string, blip_caption: string, img_url: variant>>"


def _users(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """One row per user of a file that holds a JSON array: group_id, user_index, user (variant)."""
    text = spark.read.text(path, wholetext=True)
    users = text.select(F.posexplode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("user_index", "user"))
    return users.withColumn("group_id", F.concat_ws("_", F.lit(prefix), "user_index"))


def read_episodes(spark: SparkSession, path: str, prefix: str = "user", numeric_sessions: bool = False) -> DataFrame:
    """Turns of all users in the order of ingestion: the columns of an episode.

    Sessions ``session_N`` come in the order of their keys as text, or by
    number. Blank turns go. A turn without an id is named after its session and
    place, so that such turns stay apart.
    """
    users = _users(spark, path, prefix)
    sessions = users.select("group_id", "user_index", F.explode(F.try_variant_get("user", "$.conversation", "map<string, variant>")).alias("key", "value"))
    times = sessions.filter(F.col("key").rlike("^session_[0-9]+_date_time$")).select("group_id", F.regexp_extract("key", "^(session_[0-9]+)_", 1).alias("session"), F.try_variant_get("value", "$", "string").alias("said_at"))
    turns = sessions.filter(F.col("key").rlike("^session_[0-9]+$")).select("group_id", "user_index", F.col("key").alias("session"), F.posexplode(F.try_variant_get("value", "$", _TURNS)).alias("turn", "t"))
    turns = turns.filter(F.trim(F.coalesce("t.text", F.lit(""))) != "").join(times, ["group_id", "session"], "left")
    number = F.regexp_extract("session", "([0-9]+)$", 1).cast("int")
    place = Window.partitionBy("group_id").orderBy(*([number] if numeric_sessions else []), "session", "turn")
    source = F.concat_ws(":", "group_id", F.coalesce("t.dia_id", F.concat_ws(":", "session", F.col("turn").cast("string"))))
    text = lambda c: F.col(c).cast("string")
    metadata = F.create_map(*[x for k, c in (("query", text("t.query")), ("caption", text("t.blip_caption")), ("img_url", F.to_json("t.img_url")), ("session", text("session")), ("turn", text("turn"))) for x in (F.lit(k), c)])
    return turns.select(
        "group_id", stable_id("episode", F.col("group_id"), source).alias("uuid"), source.alias("source_id"), F.coalesce("t.speaker", F.lit("unknown")).alias("speaker"), F.col("t.text").alias("content"),
        session_time(F.col("said_at")).alias("valid_at"), F.row_number().over(place).cast("long").alias("seq"), sorted_json(metadata).alias("metadata_json"),
    )


def count_users(spark: SparkSession, path: str) -> int:
    return _users(spark, path, "user").count()


def read_questions(spark: SparkSession, path: str, prefix: str = "user", users: list[int] | None = None, excluded_categories: tuple[int, ...] = ()) -> DataFrame:
    """Questions of the chosen users: group_id, user_index, question_index, question, reference_answer, category, evidence. Blank ones go."""
    rows = _users(spark, path, prefix)
    if users is not None:
        rows = rows.filter(F.col("user_index").isin(users))
    qa = "array<struct<question: string, answer: variant, category: int, evidence: array<string>>>"
    rows = rows.select("group_id", "user_index", F.posexplode(F.try_variant_get("user", "$.qa", qa)).alias("question_index", "q"))
    rows = rows.filter(F.trim(F.coalesce("q.question", F.lit(""))) != "")
    if excluded_categories:
        rows = rows.filter(~F.coalesce(F.col("q.category").isin(list(excluded_categories)), F.lit(False)))
    answer = F.coalesce(F.try_variant_get("q.answer", "$", "string"), F.to_json("q.answer"))
    return rows.select("group_id", "user_index", "question_index", F.col("q.question").alias("question"), answer_text(answer).alias("reference_answer"), F.col("q.category").alias("category"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"))


def read_single_questions(spark: SparkSession, path: str, prefix: str = "user") -> DataFrame:
    """Files with one question per row and group: group_id, query, question_id."""
    rows = _users(spark, path, prefix)
    return rows.select("group_id", F.try_variant_get("user", "$.question", "string").alias("query"), F.try_variant_get("user", "$.question_id", "string").alias("question_id"))
