"""Small parts: question files, selection sinks, id prefixes, token deltas, speaker notes."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import has_id_prefix
from tessera.operators.evaluate import token_delta
from tessera.operators.hierarchy import speaker_note
from tessera.sources import conversations, reports


def test_files_with_one_question_for_each_group(spark, tmp_path):
    rows = [{"question_id": "a1", "question": "Where?"}, {"question_id": "a2", "question": "When?", "other": [1]}, {}]
    (tmp_path / "questions.json").write_text(json.dumps(rows))
    found = conversations.read_single_questions(spark, f"{tmp_path}/questions.json", "lm").collect()
    assert sorted(tuple(r) for r in found[:]if r["query"]) == [("lm_0", "Where?", "a1"), ("lm_1", "When?", "a2")] and len(found) == 3


def test_excluded_categories_go(spark, tmp_path):
    rows = [{"qa": [{"question": "q1", "answer": " yes ", "category": 1, "evidence": ["D1:1"]}, {"question": "q5", "answer": 7, "category": 5}, {"question": " ", "category": 1}]}]
    (tmp_path / "qa.json").write_text(json.dumps(rows))
    every = conversations.read_questions(spark, f"{tmp_path}/qa.json").collect()
    some = conversations.read_questions(spark, f"{tmp_path}/qa.json", excluded_categories=(5,)).collect()
    assert [r["question"] for r in every] == ["q1", "q5"] and [(r["question"], r["reference_answer"]) for r in some] == [("q1", "yes")]


def test_selections_are_written_as_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("q1", ["a", "b"]), ("q2", [])], "query_id string, selected array<string>").repartition(2)
    reports.write_selections(rows, f"file://{tmp_path}/out")
    reports.write_selections(rows, f"file://{tmp_path}/out")  # again: replaced, not added
    found = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert sorted(found, key=lambda r: r["query_id"]) == [{"query_id": "q1", "selected": ["a", "b"]}, {"query_id": "q2", "selected": []}]


def test_prefixes_and_deltas(spark):
    df = spark.createDataFrame([("entity_1", 5, 9), ("entities", 9, 5), (None, None, 1)], "id string, a int, b int")
    rows = df.select(has_id_prefix(F.col("id"), "entity").alias("own"), token_delta(F.col("a"), F.col("b")).alias("delta")).collect()
    assert [tuple(r) for r in rows] == [(True, 4), (False, 0), (None, 0)]


def test_speaker_notes():
    notes = {mode: speaker_note(mode) for mode in ("paper_v2", "appendix_prompt", "disabled")}
    assert notes["disabled"] == "" and "Speaker" in notes["appendix_prompt"] and notes["paper_v2"]
    with pytest.raises(KeyError):
        speaker_note("other")
