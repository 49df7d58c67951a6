"""State that must survive, and hierarchies of any shape."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Config
from tessera.functions import text
from tessera.operators import graph, hierarchy, store
from tessera.plans import hierarchy as hierarchy_plan
from tessera.plans import ingestion, retrieval
from tessera.providers import LexicalReranker, LexicalSelector, RoutedReranker, TokenExtractor, indexed_scores


def tables(spark):
    kinds = {"episodes": schema.EPISODES, "entities": schema.ENTITIES, "mentions": schema.MENTIONS, "edges": schema.RELATES_TO}
    return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}


def turn(k, content):
    return ("g", f"e{k}", f"s{k}", "Ann", content, datetime(2024, 1, k), k, None, None, False)


def test_a_known_entity_keeps_what_a_batch_has_nothing_new_for(spark):
    first = ingestion.ingest_turns(tables(spark), spark.createDataFrame([turn(1, "Berlin is far")], schema.EPISODES), TokenExtractor())
    one = [0.5, 0.5]
    first["entities"] = first["entities"].withColumns({"summary": F.lit("told before"), "tag": F.array(F.lit("city")), "summary_embedding": F.array(*map(F.lit, one)).cast("array<float>"), "name_embedding": F.array(*map(F.lit, one)).cast("array<float>")})
    names = {r["name"] for r in first["entities"].collect()}
    second = ingestion.ingest_turns(first, spark.createDataFrame([turn(2, "Berlin is near")], schema.EPISODES), TokenExtractor())
    rows = {r["name"]: r for r in second["entities"].collect()}
    assert names and names <= set(rows)
    for name in names:
        r = rows[name]
        assert (r["summary"], r["tag"], list(r["summary_embedding"]), list(r["name_embedding"])) == ("told before", ["city"], one, one)
    assert max(len(rows[n]["episode_idx"]) for n in names) == 2


def test_new_details_replace_the_summary_and_its_embedding(spark):
    first = ingestion.ingest_turns(tables(spark), spark.createDataFrame([turn(1, "Berlin is far")], schema.EPISODES), TokenExtractor())
    first["entities"] = first["entities"].withColumns({"summary_embedding": F.array(F.lit(1.0)).cast("array<float>"), "name_embedding": F.array(F.lit(1.0)).cast("array<float>")})
    details = spark.createDataFrame([("g", "berlin", "a city", ["place"])], "group_id string, key string, summary string, tag array<string>")
    second = ingestion.ingest_turns(first, spark.createDataFrame([turn(2, "Berlin is near")], schema.EPISODES), TokenExtractor(), details=details)
    r = second["entities"].filter("lower(name) = 'berlin'").first()
    assert (r["summary"], r["tag"], r["summary_embedding"], list(r["name_embedding"])) == ("a city", ["place"], None, [1.0])


@pytest.mark.parametrize("crash", ["after writing", "between the renames", "before the clean-up"])
def test_a_crash_loses_no_table(spark, tmp_path, crash):
    path = str(tmp_path / "table")
    store.write_swapped(spark.range(5), path)
    fs, now, new, old = store._files(spark, path)
    spark.range(9).write.parquet(path + ".next")
    if crash != "after writing":
        fs.rename(now, old)
    if crash == "before the clean-up":
        fs.rename(new, now)
    store.restore(spark, path)
    assert spark.read.parquet(path).count() == (9 if crash == "before the clean-up" else 5)
    store.write_swapped(spark.read.parquet(path).unionByName(spark.range(100, 101)), path)
    assert spark.read.parquet(path).count() == (10 if crash == "before the clean-up" else 6)


def hierarchy_of(spark, chains):
    """A chain of categories over one entity for each (group, depth)."""
    entities, categories, links = [], [], []
    for group, depth in chains:
        entities.append((group, f"{group}0", "tree leaf"))
        for k in range(1, depth + 1):
            categories.append((group, f"{group}{k}", f"tree {k}", k))
            links.append((group, f"{group}{k}", f"{group}{k - 1}"))
    frame = lambda rows, kind, full: spark.createDataFrame([], full).unionByName(spark.createDataFrame(rows, kind), allowMissingColumns=True)
    return {
        "entities": frame(entities, "group_id string, uuid string, name string", schema.ENTITIES),
        "categories": frame(categories, "group_id string, uuid string, name string, layer int", schema.CATEGORIES),
        "categorizes": frame(links, "group_id string, parent_uuid string, child_uuid string", schema.CATEGORIZES),
    }


def test_closures_of_any_depth(spark):
    t = hierarchy_of(spark, [("g", 5)])
    nodes = graph.hierarchy_nodes(t["entities"], t["categories"])
    top = spark.createDataFrame([("q", "g", "g5")], "query_id string, group_id string, uuid string")
    assert {r["uuid"] for r in graph.descendants(top, t["categorizes"], nodes).collect()} == {f"g{k}" for k in range(5)}
    assert [r["uuid"] for r in graph.descendant_entities(top, t["categorizes"], nodes).collect()] == ["g0"]


def test_each_group_is_entered_at_its_own_top(spark):
    t = hierarchy_of(spark, [("a", 1), ("b", 2)])
    asked = spark.createDataFrame([(g, g, "which tree") for g in "ab"], "query_id string, group_id string, text string")
    found = retrieval.layer_walk(t, asked, LexicalSelector(), 2)
    assert sorted((r["query_id"], r["uuid"]) for r in found.collect()) == [("a", "a0"), ("b", "b0")]


def test_promoted_names_are_free(spark):
    nodes = spark.createDataFrame([("g", k, f"n{k}", name) for k, name in enumerate(["Pair", "Pair", "Solo", "Trio", "Trio (Promoted)"])], "group_id string, index int, uuid string, name string")
    taken = spark.createDataFrame([("g", "Pair"), ("g", "Pair (Promoted)"), ("g", "Pair (Promoted 3)"), ("g", "Trio")], "group_id string, category string")
    found = {r["index"]: r["category"] for r in hierarchy.promoted_names(nodes, taken).collect()}
    assert found == {0: "Pair (Promoted 2)", 1: "Pair (Promoted 4)", 2: "Solo", 3: "Trio (Promoted 2)", 4: "Trio (Promoted)"}


def test_a_reranker_that_fails_when_it_runs_gives_way(spark):
    class Broken:
        def scores(self, items, queries):
            return items.select("query_id", "uuid", F.raise_error(F.lit("no model")).cast("double").alias("rerank_score"))

    items = spark.createDataFrame([("q", "u", "red house")], "query_id string, uuid string, candidate_text string")
    asked = spark.createDataFrame([("q", "red house")], "query_id string, text string")
    routed = RoutedReranker(Broken(), LexicalReranker())
    assert routed.scores(items, asked).first()["rerank_score"] == 100.0 and "no model" in routed.reason


def test_utc_seconds(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        shown = spark.range(1).select(text.utc_seconds().alias("t")).first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs((datetime.strptime(shown, "%Y-%m-%dT%H:%M:%SZ") - datetime.now(UTC).replace(tzinfo=None)).total_seconds()) < 60


def test_hierarchy_is_cleared_with_its_links(spark):
    t = hierarchy_of(spark, [("a", 2), ("b", 1)])
    categories, links = store.clear_hierarchy(t["categories"], t["categorizes"], spark.createDataFrame([("a",)], "group_id string"))
    assert [r["uuid"] for r in categories.collect()] == ["b1"] and links.count() == 1


def test_selections_that_all_miss_are_an_error(spark):
    nodes = spark.createDataFrame([("g", "u1", "tree", 1)], "group_id string, uuid string, name string, seq int")
    kind = "query_id string, group_id string, uuid string, name string"
    picked = lambda rows: graph.matched_selections(graph.resolve_selections(spark.createDataFrame(rows, kind), nodes)).collect()
    assert [r["node_uuid"] for r in picked([("q", "g", "u1", "x"), ("q", "g", "lost", "lost")])] == ["u1"]
    assert picked([]) == []
    with pytest.raises(Exception, match="no selection matches a node for query r"):
        picked([("q", "g", "u1", "x"), ("r", "g", "lost", "lost")])


def test_rerank_scores_by_place(spark):
    items = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("r", "c", 0)], "query_id string, uuid string, index int")
    scored = lambda rows: {r["uuid"]: r["rerank_score"] for r in indexed_scores(items, spark.createDataFrame(rows, "query_id string, index int, score double")).collect()}
    assert scored([("q", 1, 3.0), ("q", 1, 5.0), ("q", 9, 1.0), ("q", -1, 1.0), ("q", 0, None), ("r", 0, 2.0)]) == {"b": 5.0, "c": 2.0}
    with pytest.raises(Exception, match="no usable rerank scores for query r"):
        scored([("q", 0, 1.0), ("r", 7, 2.0)])


def test_layers_are_assigned_in_batches_and_described(spark):
    class Pairs:
        def assign(self, nodes, layer):
            rows = nodes.groupBy("group_id", "batch_id").agg(F.array_sort(F.collect_list("index")).alias("indexes"))
            return rows.select("group_id", F.concat(F.lit(f"L{layer} "), F.col("batch_id").cast("string")).alias("category"), "indexes", F.col("batch_id").alias("row_no"))

    class Told:
        def details(self, categories, layer):
            return categories.filter("batch_id = 0").select("group_id", "category", F.lit(" told ").alias("summary"), F.array(F.lit("t")).alias("tag"))

    rows = [("g", f"u{k}", f"n{k}", ["old"], False) for k in range(6)]
    entities = spark.createDataFrame(rows, "group_id string, uuid string, name string, tag array<string>, is_speaker boolean")
    categories, _ = hierarchy_plan.build(entities, Pairs(), Config(assign_batch=2, detail_batch=2, max_layers=1), Told())
    found = {r["name"]: (r["summary"], r["tag"]) for r in categories.collect()}
    assert found == {"L1 0": ("told", ["t"]), "L1 1": ("told", ["t"]), "L1 2": ("L1 2: n4, n5", ["old"])}
