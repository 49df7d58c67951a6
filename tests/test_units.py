"""Small fixtures for what the driver's tables do not show."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import config, providers, telemetry
from tessera.functions import payload, text, vectors
from tessera.operators.snapshots import Snapshots
from tessera.operators import evaluate, fusion, graph, hierarchy, ingest, store
from tessera.plans import hierarchy as hierarchy_plan
from tessera.plans.answering import answer_and_judge
from tessera.sources import conversations, logs, reports
from tessera.streaming import ingest as streaming


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_session_times(spark):
    df = spark.createDataFrame([("1:56 pm on 8 May, 2023",), ("9:05 a.m. on 12 Sep, 2022",), ("2024-02-03",)], "s string")
    assert [str(r[0]) for r in df.select(text.session_time(F.col("s")).cast("string")).collect()] == ["2023-05-08 13:56:00", "2022-09-12 09:05:00", "2024-02-03 00:00:00"]
    with pytest.raises(Exception, match="unknown session time"):
        spark.createDataFrame([("soon",)], "s string").select(text.session_time(F.col("s"))).collect()
    assert spark.createDataFrame([(" ",)], "s string").select(text.session_time(F.col("s")).isNotNull()).first()[0]


def test_sorted_json_drops_nulls(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "c": None},)], "m map<string,string>")
    assert df.select(text.sorted_json(F.col("m"))).first()[0] == '{"a":"1","b":"2"}'


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    with pytest.raises(Exception, match="fewer than 3"):
        df.select(vectors.truncate_renormalize(F.col("a"), 3)).collect()


@pytest.mark.parametrize(
    ("value", "kind", "names"),
    [
        ('[{"name": "a"}]', "entities", ["a"]),
        ('{"entities": [{"name": "a"}]}', "entities", ["a"]),
        ('{"results": [{"name": "b"}]}', "entities", ["b"]),
        ('{"x": [1], "y": [{"name": "c"}]}', "entities", ["c"]),
        ('so: {"entities": [{"name": "d"}]} done', "entities", ["d"]),
        ("{ not json [", "entities", None),
        ('{"new_edges": [{"source": "s", "target": "t", "fact": "f", "name": "e"}]}', "edges", ["e"]),
    ],
)
def test_payload_shapes(spark, value, kind, names):
    found = spark.createDataFrame([(value,)], "v string").select(payload.payload_items(F.col("v"), kind)).first()[0]
    assert (found and [x["name"] for x in json.loads(found)]) == names


def test_judge_payload(spark):
    df = spark.createDataFrame([('{"is_correct": true}',), ('{"result": "Correct"}',), ('{"result": "incorrect"}',)], "v string")
    assert [r[0] for r in df.select(payload.judged_correct(F.col("v"))).collect()] == [True, True, False]


def test_read_episodes(spark, tmp_path):
    user = {
        "conversation": {
            "session_2": [{"speaker": "B", "text": "two", "dia_id": "D2:1", "img_url": ["u"]}], "session_2_date_time": "2024-01-02",
            "session_10": [{"speaker": "A", "text": "ten"}, {"text": "  "}, {"text": "no id"}], "session_10_date_time": "1:00 pm on 3 May, 2024",
        },
        "qa": [{"question": "q1", "answer": 7, "category": 2, "evidence": ["D2:1"]}, {"question": " "}, {"question": "q2", "answer": "x", "category": 5}],
    }
    path = tmp_path / "users.json"
    path.write_text(json.dumps([user, user]))
    found = conversations.read_episodes(spark, str(path), "u").filter("group_id = 'u_0'").orderBy("seq").collect()
    assert [(r["source_id"], r["speaker"], r["content"]) for r in found] == [("u_0:session_10:0", "A", "ten"), ("u_0:session_10:2", "unknown", "no id"), ("u_0:D2:1", "B", "two")]
    assert json.loads(found[2]["metadata_json"]) == {"img_url": '["u"]', "session": "session_2", "turn": "0"}
    assert str(found[0]["valid_at"]) == "2024-05-03 13:00:00"
    numeric = conversations.read_episodes(spark, str(path), "u", numeric_sessions=True).filter("group_id = 'u_1'").orderBy("seq").collect()
    assert numeric[0]["content"] == "two"
    assert conversations.count_users(spark, str(path)) == 2
    q = conversations.read_questions(spark, str(path), "u", users=[1], excluded_categories=(5,)).collect()
    assert [(r["group_id"], r["question"], r["reference_answer"], r["evidence"]) for r in q] == [("u_1", "q1", "7", ["D2:1"])]


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n1 turn done | group_id=g1, turn=1/2, source_id=g1:1, entity_count=3\nturn done | group_id=g1, turn=2/2, source_id=g1:2, entity_count=3\n")
    assert rows(logs.last_turns(spark, str(tmp_path / "a.log")), "group_id", "source_id") == [("g1", "g1:2")]
    assert logs.latest_log(str(tmp_path)).endswith("a.log")
    assert logs.latest_log(str(tmp_path / "none")) is None


def turns(spark, done):
    e = spark.createDataFrame([("g", f"s{k}", k) for k in (1, 2, 3)], "group_id string, source_id string, seq long")
    c = spark.createDataFrame([("g", s) for s in done], "group_id string, source_id string")
    return e, c


@pytest.mark.parametrize(("done", "logged", "start"), [(["s1", "s3"], None, 1), (["s3"], "s3", 3), ([], None, 0), (["s1", "s2", "s3"], None, 3), (["s2"], "s1", 2)])
def test_resume(spark, done, logged, start):
    log = spark.createDataFrame([("g", logged)], "group_id string, source_id string") if logged else None
    assert rows(store.resume_positions(*turns(spark, done), log), "start_index") == [(start,)]


def test_resume_needs_evidence(spark):
    with pytest.raises(Exception, match="nothing to resume from"):
        store.require_resumable(store.resume_positions(*turns(spark, []))).collect()


def test_unique_and_swap(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="more than once"):
        store.require_unique(df, ["k"])
    path = f"file://{tmp_path}/t"
    store.write_swapped(df, path)
    store.write_swapped(spark.read.parquet(path).filter("v = 2"), path)
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 2)]


def nodes(spark, data):
    return spark.createDataFrame([("g", k, f"u{k}", n, [t], s) for k, (n, t, s) in enumerate(data)], "group_id string, index int, uuid string, name string, tag array<string>, is_speaker boolean")


def test_promotion_and_minimum_before_joining(spark):
    n = nodes(spark, [("a", "x", False), ("b", "x", False), ("c", "y", False)])
    assigned = spark.createDataFrame([("g", 1, "Pair", [0, 1, 1, 9]), ("g", 2, "One", [2]), ("g", 3, "One", [2]), ("g", 4, "This and that", [0, 1])], "group_id string, row_no long, category string, indexes array<int>")
    found = hierarchy.materialize_layer(assigned, n, 1)
    assert rows(found, "category", "kind", "uuid") == [("Pair", "natural", "u0"), ("Pair", "natural", "u1"), ("c", "promoted", "u2")]


def test_promoted_names_collide(spark):
    n = nodes(spark, [("Pair", "x", False), ("Pair", "x", False), ("z", "y", False)])
    taken = spark.createDataFrame([("g", "Pair")], "group_id string, category string")
    assert rows(hierarchy.promoted_names(n, taken), "category") == [("Pair (Promoted 2)",), ("Pair (Promoted)",), ("z",)]


def test_layer_rules(spark):
    n = nodes(spark, [("a", "x", False), ("b", "x", False)])
    made = spark.createDataFrame([("g", "A", "natural", ["u0", "u1"]), ("g", "B", "natural", ["u0", "u1"]), ("g", "C", "promoted", ["u0"])], "group_id string, category string, kind string, children array<string>")
    assert rows(hierarchy.check_layer(made, n, 1), "accepted") == [(True,)]
    assert rows(hierarchy.check_layer(made, n, 2), "accepted") == [(False,)]
    single = made.filter("category = 'C'").withColumn("kind", F.lit("natural"))
    assert rows(hierarchy.check_layer(single, n, 1), "accepted") == [(False,)]


def test_build_hierarchy_stops(spark):
    e = nodes(spark, [("a", "x", False), ("b", "x", False), ("c", "y", False), ("d", "y", False), ("me", "x", True)]).drop("index")
    categories, links = hierarchy_plan.build(e, providers.TagCategorizer(), config.Config(max_layers=2))
    layer1 = rows(categories.filter("layer = 1"), "name")
    assert layer1 == [("Layer 1 x",), ("Layer 1 y",), ("Speaker",)]
    assert links.filter(F.col("child_uuid") == "u4").count() == 1


def test_speaker_modes(spark):
    df = spark.createDataFrame([("Me", None), ("Ann", True)], "name string, is_speaker boolean")
    found = {m: [r[0] for r in df.select(hierarchy.is_reserved_speaker(1, m)).collect()] for m in ("paper_v2", "appendix_prompt", "disabled")}
    assert found == {"paper_v2": [False, True], "appendix_prompt": [True, False], "disabled": [False, False]}
    assert not any(r[0] for r in df.select(hierarchy.is_reserved_speaker(2, "paper_v2")).collect())
    with pytest.raises(ValueError):
        hierarchy.is_reserved_speaker(1, "x")


def test_expansion_has_null_times_first_and_both_directions(spark):
    e = spark.createDataFrame([("g", "a", "A"), ("g", "b", "B")], "group_id string, uuid string, name string")
    edges = spark.createDataFrame([("g", "r1", "a", "b", "f", None, None), ("g", "r2", "b", "a", "f2", datetime(2024, 1, 1), None)], "group_id string, uuid string, source_uuid string, target_uuid string, fact string, valid_at timestamp, invalid_at timestamp")
    seeds = spark.createDataFrame([("q", "g", "a"), ("q", "g", "b")], "query_id string, group_id string, uuid string")
    found = graph.expand_to_edges(seeds, e, edges)
    assert [r["edge_uuid"] for r in found.orderBy("place").collect()] == ["r1", "r1", "r2", "r2"]
    assert graph.distinct_last(found, "edge_uuid").count() == 2


def test_merge_modes(spark):
    df = spark.createDataFrame([("q", "u", 0, 0.9, "old"), ("q", "u", 1, 0.2, None)], "query_id string, uuid string, seq int, rrf_score double, name string")
    assert rows(fusion.merge_by_uuid(df), "rrf_score", "name") == [(0.9, "old")]
    assert rows(fusion.merge_by_uuid(df, last_wins=True), "rrf_score", "name") == [(0.2, "old")]


def test_rerank_fills_with_unscored(spark):
    items = spark.createDataFrame([("q", x, 0.0, s) for x, s in (("a", 0.1), ("b", 0.9), ("c", 0.5))], "query_id string, uuid string, route_score double, rrf_score double")
    scores = spark.createDataFrame([("q", "a", 3.0)], "query_id string, uuid string, rerank_score double")
    assert [r["uuid"] for r in fusion.rerank(items, scores, 2).orderBy("place").collect()] == ["a", "b"]


def test_stage_report_and_reports(spark, tmp_path):
    r = telemetry.Recorder()
    r.model_call("build", "extract", 1.25, "m", 100, 25)
    r._add("stage_runtime", "build", "extract", 3.5)
    found = evaluate.stage_report(r.table(spark)).first()
    assert (found["total_tokens"], found["wall_clock_seconds"], found["models"], found["llm_calls"]) == (125, 4.75, "m", 1)
    with r.stage("build", "walk"):
        pass
    reports.write_stage_reports(r.table(spark), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/report_json").count() == 2


def test_evaluation(spark, tmp_path):
    q = spark.createDataFrame([("q1", "g", 0, 0, "who", "Ann Lee", "1", ["s"]), ("q2", "g", 0, 1, "when", "May", "5", [])], "query_id string, group_id string, user_index int, question_index int, question string, reference_answer string, category string, evidence array<string>")
    c = spark.createDataFrame([("q1", "<NODES>\nthe lee ann\n</NODES>")], "query_id string, context string")
    a = answer_and_judge(q, c, providers.EchoAnswerer(), providers.ContainmentJudge())
    assert rows(a, "query_id", "is_correct", "error") == [("q1", True, None), ("q2", False, "no context")]
    s = evaluate.eval_summary(a).first()
    assert (s["question_count"], s["correct_count"], s["failed_count"], s["accuracy"]) == (2, 1, 1, 0.5)
    assert evaluate.eval_summary(a.limit(0)).first()["accuracy"] == 0.0
    reports.write_evaluation(a, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e/answers_json").count() == 2


def test_providers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert providers.with_tries(flaky, wait=0) == "ok"
    with pytest.raises(KeyError):
        providers.with_tries(lambda: {}["x"], wait=0)
    df = spark.createDataFrame([(str(k),) for k in range(70)], "t string").coalesce(1)
    found = providers.remote_map(df, "t", "n", "int", lambda part: [len(part)] * len(part))
    assert rows(found.groupBy("n").count(), "n", "count") == [(6, 6), (32, 64)]
    with pytest.raises(Exception, match="0 answers to"):
        providers.remote_map(df, "t", "n", "int", lambda part: []).collect()
    answers = iter(["no", '{"x": 1}', '{"x": 2}'])

    def check(v):
        if v["x"] < 2:
            raise ValueError("too small")
        return v["x"]

    assert providers.ask_json(lambda p: next(answers), "p", check) == 2
    with pytest.raises(ValueError, match="in 3 tries"):
        providers.ask_json(lambda p: "no", "p", check)


class Broken:
    def scores(self, items, queries):
        raise RuntimeError("down")


def test_routed_reranker_switches_for_good(spark):
    items = spark.createDataFrame([("q", "a", "ann went home")], "query_id string, uuid string, candidate_text string")
    queries = spark.createDataFrame([("q", "ann home")], "query_id string, text string")
    routed = providers.RoutedReranker(Broken(), providers.LexicalReranker())
    assert rows(routed.scores(items, queries), "rerank_score") == [(100.0,)]
    assert "down" in routed.reason
    with pytest.raises(RuntimeError):
        providers.RoutedReranker(Broken(), providers.LexicalReranker(), "true_reranker").scores(items, queries)


def test_config():
    c = config.Config.read({"TESSERA_RRF_K": "30", "TESSERA_SPEAKER_MODE": "Appendix", "TESSERA_FORCE_SPEAKER": "no", "TESSERA_EDGE_MATCH": "0.9,0.8"})
    assert (c.rrf_k, c.speaker_mode, c.force_speaker, c.edge_match) == (30, "appendix_prompt", False, (0.9, 0.8))
    assert config.parse_indexes("2, 0-1,1", 3) == [2, 0, 1]
    with pytest.raises(ValueError):
        config.parse_indexes("3", 3)
    assert (ingest.detail_batch_size(4096), ingest.detail_batch_size(10), ingest.edge_batch_size(4096), ingest.edge_batch_size(1)) == (8, 1, 6, 2)


def test_streams(spark, tmp_path):
    schema = "group_id string, uuid string, source_id string, speaker string, content string, valid_at timestamp, seq long, ingestion_complete boolean"
    at = datetime(2024, 1, 1)
    source = spark.createDataFrame([("g", f"e{k}", f"s{k}", "user", f"t{k}", at, k, False) for k in range(5)], schema)
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    tables = Snapshots(spark, f"file://{tmp_path}/tables")
    tables.create("episodes", spark.createDataFrame([], schema), ["group_id", "source_id"], 4)
    for run in ("c1", "c2"):  # a second run replays every turn
        streaming.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), tables, "episodes", f"{tmp_path}/{run}").awaitTermination()
        assert tables.read("episodes").count() == 5
    q = streaming.recent_windows(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2).writeStream.format("memory").queryName("recent").option("checkpointLocation", f"{tmp_path}/c3").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert dict(rows(spark.table("recent"), "source_id", "recent"))["s3"] == "t1\nt2"
