"""Edges of turns are made in tasks of so many turns, behind one shuffle of the texts."""

from tessera.queries import base, building

DATA = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_turns(spark, monkeypatch):
    want = sorted(map(str, building.edge_dedup_key(spark, DATA).collect()))
    turns = base.table(spark, DATA, "conversations").count()
    monkeypatch.setattr(base, "TURNS", 5)
    found = building.edge_dedup_key(spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert found.rdd.getNumPartitions() == -(-turns // 5) > spark.sparkContext.defaultParallelism
    assert sorted(map(str, found.collect())) == want
