"""Tables of the graph that are written once, places of edges by ids, frequencies of frequent tokens."""

from pyspark.sql import functions as F

from tessera.operators import graph, search
from tessera.queries.base import graph_tables


def test_graph_tables_are_written_once(spark, tmp_path):
    said = [(1, 0, "user", "Wonder banana wonder"), (1, 1, "user", "banana kitchen"), (11, 0, "user", "kitchen banana"), (2, 0, None, None)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    g = graph_tables(spark, str(tmp_path))
    assert sorted((r["group_id"], r["name"], r["summary"]) for r in g["entities"].collect()) == [("g1", "banana", "banana seen in 3"), ("g1", "kitchen", "kitchen seen in 2")]
    assert sorted((r["group_id"], r["fact"]) for r in g["edges"].collect()) == [("g1", "banana with kitchen"), ("g1", "kitchen with banana")]
    assert g["mentions"].count() == 5
    for name in ("entities", "edges"):
        assert all("/graph-" in f for f in g[name].inputFiles())


def test_limited_expansion_is_the_head_of_the_whole(spark):
    entities = spark.createDataFrame([("g", f"u{k}", f"n{k}") for k in range(9)], "group_id string, uuid string, name string")
    rows = [("g", f"e{k}", f"u{k % 9}", f"u{(k * k + 1) % 11}", f"f{k}", None if k % 7 == 0 else f"2024-01-{k % 5 + 1:02d}") for k in range(60)]  # some ends are unknown, some loops
    edges = spark.createDataFrame(rows, "group_id string, uuid string, source_uuid string, target_uuid string, fact string, valid_at string")
    edges = edges.withColumns({"valid_at": F.to_timestamp("valid_at"), "invalid_at": F.lit(None).cast("timestamp")})
    seeds = spark.createDataFrame([(q, "g", f"u{k}") for q in ("a", "b") for k in range(9) if q == "a" or k % 2], "query_id string, group_id string, uuid string")
    whole = graph.expand_to_edges(seeds, entities, edges)
    some = graph.expand_to_edges(seeds, entities, edges, 12)
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.filter("place <= 12").collect()))
    assert some.count() == 24


def test_frequent_tokens_have_their_frequency(spark, monkeypatch):
    monkeypatch.setattr(search, "FREQUENT", 1)
    frequencies = spark.createDataFrame([("g", "with", 9), ("h", "with", 2), ("g", "rare", 1)], "group_id string, token string, df long")
    wanted = spark.createDataFrame([("q1", "g", "with"), ("q2", "g", "with"), ("q2", "h", "with"), ("q1", "g", "rare"), ("q1", "g", "none")], "query_id string, group_id string, token string")
    found = search.with_frequencies(wanted, frequencies, ["token", "group_id"])
    assert sorted((r["query_id"], r["group_id"], r["token"], r["df"]) for r in found.collect()) == [("q1", "g", "rare", 1), ("q1", "g", "with", 9), ("q2", "g", "with", 9), ("q2", "h", "with", 2)]
