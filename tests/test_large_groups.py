"""Groups that lie in many tasks, closures of any depth, bounded aggregates, and providers that answer by query or batch."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import evaluate, graph, ordered, store
from tessera.plans import hierarchy as hierarchy_plan
from tessera.plans import retrieval
from tessera.providers import ReusingCategorizer, ServiceReranker, ServiceSelector
from tessera.stages import Stages


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def some_rows(n=3_000):
    rng = random.Random(3)
    rows = [(rng.choice(["big", "big", "big", "small", None]), rng.choice([None, rng.randint(0, 50)]), k, rng.randint(0, 5)) for k in range(n)]
    return rows


def test_running_sums_of_a_group_in_many_ranges(spark, many_ranges):
    rows = some_rows()
    stages = Stages(spark, "running")
    df = spark.createDataFrame(rows, "g string, a long, b long, v long").repartition(5)
    found = {r["b"]: (r["place"], r["total"]) for r in ordered.running(df, ["g"], ["a", "b"], {"total": F.col("v")}, stages).collect()}
    want, sums = {}, {}
    for g, a, b, v in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        place, total = sums.get(g, (0, 0))
        sums[g] = want[b] = (place + 1, total + v)
    assert found == want
    ranges = ordered.in_ranges(df, ["g"], ["a", "b"], stages).filter("g = 'big'").groupBy("_range").count().collect()
    assert len(ranges) > 3 and max(r["count"] for r in ranges) < df.filter("g = 'big'").count() / 2
    assert ordered.numbered(df.limit(0), ["g"], ["a", "b"]).collect() == []


def test_contexts_cross_the_borders_of_stretches(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(ordered, "STRETCH", 7)
    rows = [("g", k, f"s{k:03d}", "x", f"t{k}", 0) for k in range(60)]
    df = spark.createDataFrame(rows, "group_id string, seq long, source_id string, speaker string, content string, valid_at int").repartition(4)
    found = {r["seq"]: r["recent"] for r in store.turn_contexts(df, 4).collect()}
    assert found == {k: [f"x: t{j}" for j in range(max(0, k - 4), k)] for k in range(60)}


def test_a_chain_of_many_links_and_a_cycle(spark):
    links = [("g", f"n{k}", f"n{k + 1}") for k in range(50)] + [("g", "n50", "n10"), ("h", "n1", "x")]
    categorizes = spark.createDataFrame(links, "group_id string, parent_uuid string, child_uuid string")
    parents = spark.createDataFrame([("q1", "g", "n0"), ("q2", "g", "n45"), ("q3", "g", "leaf")], "query_id string, group_id string, uuid string")
    reached = graph.reachable(parents, categorizes)
    found = {}
    for r in reached.collect():
        found.setdefault(r["query_id"], set()).add(r["uuid"])
    assert found == {"q1": {f"n{k}" for k in range(1, 51)}, "q2": {f"n{k}" for k in range(10, 51)}}
    assert reached._jdf.queryExecution().optimizedPlan().toString().count("\n") <= 3  # the plan is a scan, however many steps there were


def test_gold_and_models_without_arrays_of_groups(spark):
    found = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), ("r", "z")], "query_id string, source_id string")
    gold = spark.createDataFrame([("q", ["a", "a", "c"]), ("r", ["y"]), ("s", [])], "query_id string, evidence array<string>")
    assert {tuple(r) for r in evaluate.gold_hits(found, gold).collect()} == {("q", 1, 3), ("r", 0, 1), ("s", 0, 0)}
    events = [("llm_call", "s", "o", 2.0, "m2", 1, 1, 2, 3), ("llm_call", "s", "o", 1.0, "m1", 1, 1, 2, 1), ("stage_runtime", "s", "o", 5.0, None, None, None, None, 2), ("llm_call", "s", "o", 1.0, "m1", 1, 1, 2, 4)]
    df = spark.createDataFrame(events, "event_type string, stage string, operation string, runtime_seconds double, model string, prompt_tokens long, completion_tokens long, total_tokens long, seq long")
    r = evaluate.stage_report(df).first()
    assert (r["models"], r["llm_calls"], r["llm_seconds"], r["total_tokens"], r["wall_clock_seconds"]) == ("m1|m2", 3, 4.0, 6, 6.0)


def layers(spark, size, n=57):
    # With more children than one, an assignment of a single node is dropped before equal names are joined, whatever the batch.
    rng = random.Random(5)
    tags = ["City", "city", "person", "PERSON", "thing"]
    rows = [(g, f"{g}{k}", f"name {k:03d}", [rng.choice(tags)], False) for g in ("g", "h") for k in range(n)]
    entities = spark.createDataFrame(rows, "group_id string, uuid string, name string, tag array<string>, is_speaker boolean")
    categories, links = hierarchy_plan.build(entities, ReusingCategorizer(), Config(max_layers=1, assign_batch=size, min_children=1))
    names = {r["uuid"]: r["name"] for r in categories.collect()}
    return sorted((r["group_id"], names[r["parent_uuid"]].lower(), r["child_uuid"]) for r in links.collect())


def test_batches_see_the_categories_of_earlier_ones(spark):
    spark.sparkContext.setCheckpointDir(Stages(spark, "layers").folder)
    small, large = layers(spark, 10), layers(spark, 96)
    assert small == large and {name for _, name, _ in small} == {"layer 1 city", "layer 1 person", "layer 1 thing"}


def test_a_reranking_service(spark):
    items = spark.createDataFrame([("q", "u2", "two"), ("q", "u1", "one"), ("r", "u3", "three")], "query_id string, uuid string, candidate_text string")
    queries = spark.createDataFrame([("q", "g", "T"), ("r", "g", "R")], "query_id string, group_id string, text string")
    ask = lambda text, texts: [(i, float(len(t))) for i, t in enumerate(texts)] + [(99, 1.0)]
    assert {tuple(r) for r in ServiceReranker(ask).scores(items, queries).collect()} == {("q", "u1", 3.0), ("q", "u2", 3.0), ("r", "u3", 5.0)}
    with pytest.raises(Exception, match="no usable rerank scores for query r"):
        ServiceReranker(lambda text, texts: [(7, 1.0)] if text == "R" else [(0, 1.0)]).scores(items, queries).collect()


def test_a_selecting_service_on_a_walk(spark):
    entities = spark.createDataFrame([("g", f"e{k}", f"entity {k}", ["t"], None) for k in range(4)], "group_id string, uuid string, name string, tag array<string>, summary string")
    categories = spark.createDataFrame([("g", "c0", "even", ["t"], 1), ("g", "c1", "odd", ["t"], 1)], "group_id string, uuid string, name string, tag array<string>, layer int")
    links = spark.createDataFrame([("g", f"c{k % 2}", f"e{k}") for k in range(4)], "group_id string, parent_uuid string, child_uuid string")
    tables = {"entities": entities, "categories": categories, "categorizes": links}
    queries = spark.createDataFrame([("q", "g", "odd"), ("r", "g", "by id"), ("s", "g", "none")], "query_id string, group_id string, text string")
    chosen = {"odd": [(None, "odd", True), (None, "no such", False)], "by id": [("c0", "?", True)], "none": []}
    walk = retrieval.layer_walk(tables, queries, ServiceSelector(lambda text, nodes: chosen[text]), 1)
    assert {(r["query_id"], r["uuid"]) for r in walk.collect()} == {("q", "e1"), ("q", "e3"), ("r", "e0"), ("r", "e2")}
    wrong = lambda text, nodes: [("x", "no such", False)]
    with pytest.raises(Exception, match="no selection matches a node"):
        retrieval.layer_walk(tables, queries, ServiceSelector(wrong), 1).collect()
    assert retrieval.layer_walk(tables, queries, ServiceSelector(wrong, strict=False), 1).collect() == []
