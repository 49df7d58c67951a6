"""Tables after a batch of turns, and vectors of an index, without shuffles and widths that they do not need."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import ingest, store
from tessera.operators.vector_index import packed

EDGES = "group_id string, uuid string, source_uuid string, target_uuid string, fact string, valid_at timestamp, invalid_at timestamp"
DAY = datetime.datetime(2024, 1, 1)


def test_edges_after_a_batch_take_one_shuffle(spark):
    old = spark.createDataFrame([("g", "f1", "a", "b", "old", DAY, DAY), ("g", "f2", "a", "c", "stays", DAY, DAY)], EDGES)
    rows = spark.createDataFrame([("g", "f1", "a", "b", "new", DAY, 1), ("g", "f1", "a", "b", "newer", DAY, 2), ("g", "f3", "b", "c", "first", DAY, 1)], "group_id string, uuid string, source_uuid string, target_uuid string, fact string, valid_at timestamp, seq long")
    entities = spark.createDataFrame([("g", x) for x in "abc"], "group_id string, uuid string")
    found = ingest.latest_edges(rows, old)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.columns == old.columns
    assert sorted(found.collect()) == sorted(store.upsert_edges(old, ingest.latest_edges(rows), entities).select(old.columns).collect())


def test_known_entities_that_no_mention_means_stay_as_they_are(spark):
    known = spark.createDataFrame(
        [("g", "u1", "ada", "s1", ["x"], None, ["e0"], ["s0"], 7), ("g", "u2", "bob", None, [], True, None, ["s0"], None)],
        "group_id string, uuid string, name string, summary string, tag array<string>, is_speaker boolean, episode_idx array<string>, source_ids array<string>, seq long",
    )
    turns = spark.createDataFrame([("g", "e1", 1, "s1"), ("g", "e2", 2, "s2")], "group_id string, uuid string, seq long, source_id string")
    said = [("g", "e2", "ada", "Ada", 0, False, "u1"), ("g", "e1", "ada", "Ada", 3, False, "u1"), ("g", "e1", "cyd", "Cyd", 1, True, "u3")]
    resolved = spark.createDataFrame(said, "group_id string, episode_uuid string, key string, name string, pos long, is_speaker boolean, uuid string")
    rows = lambda df: sorted(map(repr, df.select(known.columns).collect()))
    merged = ingest.entity_rows(resolved, turns, known, all_known=True)
    assert rows(merged) == rows(store.upsert(known, ingest.entity_rows(resolved, turns, known), ["group_id", "uuid"]))
    assert merged.filter("uuid = 'u1'").select("episode_idx", "source_ids").first() == (["e0", "e1", "e2"], ["s0", "s1", "s2"])


def test_vectors_of_an_index_keep_their_width(spark):
    rows = spark.createDataFrame([("g", "a", [1.0, 2.0], 2.2)], "group_id string, uuid string, v array<float>, length double")
    assert dict(packed(rows, ["group_id"], "uuid", "v", "length").dtypes)["flat"] == "array<float>"
    assert dict(packed(rows.withColumn("v", F.col("v").cast("array<double>")), ["group_id"], "uuid", "v", "length").dtypes)["flat"] == "array<double>"
