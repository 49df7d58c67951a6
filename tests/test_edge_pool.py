"""The pool of all edges around the seeds without sorting a query's edges whole, and packed ids."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import packed, unpacked
from tessera.operators import fusion, graph


def graph_of(spark):
    """Unknown ends, loops, uuids of several rows (in one group and in two), ids of any form."""
    md5 = lambda c: F.md5(c.cast("string"))
    entities = spark.createDataFrame([(g, k, f"n{k}") for g in "gh" for k in range(9)], "group_id string, k int, name string").withColumn("uuid", F.when(F.col("k") < 7, md5(F.col("k"))).otherwise(F.concat(F.lit("é"), "k")))
    rows = [("g" if k % 4 else "h", f"e{k % 50}" if k % 3 else f"{k % 45:032x}", k % 9, (k * k + 1) % 11, None if k % 7 == 0 else f"2024-01-{k % 5 + 1:02d}") for k in range(90)]
    edges = spark.createDataFrame(rows, "group_id string, uuid string, s int, t int, valid_at string")
    end = lambda c: F.when(F.col(c) < 7, md5(F.col(c))).otherwise(F.concat(F.lit("é"), c))
    edges = edges.withColumns({"source_uuid": end("s"), "target_uuid": end("t"), "fact": F.lit("f"), "valid_at": F.to_timestamp("valid_at"), "invalid_at": F.lit(None).cast("timestamp")})
    seeds = entities.crossJoin(spark.createDataFrame([("a",), ("b",)], "query_id string")).filter("query_id = 'a' OR k % 2 = 1").select("query_id", "group_id", "uuid")
    return seeds, entities.select("group_id", "uuid", "name"), edges


@pytest.mark.parametrize("few", [20_000, 0])
def test_the_pool_is_that_of_the_whole_expansion(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_KEYS", few)
    tables = graph_of(spark)
    whole = graph.distinct_last(graph.expand_to_edges(*tables), "edge_uuid").select("query_id", F.col("edge_uuid").alias("uuid"), "matched_entity_count")
    for limit in (5, 1_000):
        want = fusion.sort_pool(whole, limit).select("query_id", "uuid", "matched_entity_count", "place")
        assert sorted(map(tuple, graph.edge_pool(*tables, limit).collect())) == sorted(map(tuple, want.collect()))


def test_no_query_is_sorted_whole(spark):
    """Sorting a query's edges takes one task for each query; the pool only sorts the heads of all tasks."""
    plan = graph.edge_pool(*graph_of(spark), 5)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "query_id" in line]
    assert windows and plan.count("WindowGroupLimit") >= 2 and not any("matched_entity_count" in w and "valid_at" in w for w in windows)


def test_packed_ids_come_back(spark):
    ids = ["0" * 32, "0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "g" * 32, "", "e1", "é" * 3, "a" * 31, "a" * 33, "q-" + "0" * 32, "é" + "0" * 32, "0" * 32 + "\n", "\n" + "0" * 32, None]
    found = spark.createDataFrame([(i,) for i in ids], "id string").select("id", packed(F.col("id")).alias("p")).select("id", "p", unpacked(F.col("p")).alias("back")).collect()
    assert [r["back"] for r in found] == ids
    assert len({bytes(r["p"]) for r in found if r["id"] is not None}) == len(ids) - 1
    assert {r["id"]: len(r["p"]) for r in found if r["id"]}["0" * 32] == 17
