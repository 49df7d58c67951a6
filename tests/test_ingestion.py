"""Turns in order: rounds, fold and stream agree; reflection, batches, and vectors kept by content."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Config
from tessera.operators import ingest, reflection, resolution
from tessera.operators.embedding_store import EmbeddingStore
from tessera.plans.ingestion import in_batches, ingest_turns
from tessera.providers import LetterEmbedder, RemoteEmbedder, TokenExtractor
from tessera.stages import Stages
from tessera.streaming.fold import fold_stream

MATCH = (0.92, 0.88)
COLUMNS = ("group_id", "episode_uuid", "key", "name", "pos", "is_speaker", "uuid")


def said(spark, turns):
    """turns: (group, number, names). The mentions and the episodes."""
    episodes = spark.createDataFrame([(g, f"{g}-e{k:03d}", k, f"s{k:03d}") for g, k, _ in turns], "group_id string, uuid string, seq long, source_id string")
    rows = [(g, f"{g}-e{k:03d}", name.lower(), name, pos, pos == 0) for g, k, names in turns for pos, name in enumerate(names)]
    return spark.createDataFrame(rows, "group_id string, episode_uuid string, key string, name string, pos long, is_speaker boolean"), episodes


def some_turns(seed, groups=3, n=25):
    """Spellings with few differences, so that chains of near names arise."""
    rng = random.Random(seed)
    stems = ["jonathan", "berlin harbour", "margarethe", "aab", "zzz", "", "12"]
    def spelling():
        word = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            word.insert(rng.randint(0, len(word)), rng.choice("abe "))
        return " ".join("".join(word).split()) or "x"
    return [(f"g{g}", k, list({spelling().lower(): None for _ in range(rng.randint(0, 5))})) for g in range(groups) for k in range(n)]


def resolved(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("g0", "known-1", "Jonathan"), ("g0", "known-2", "JONATHAN "), ("g1", "known-3", "margarethe a"), ("g9", "other", "aab")], "group_id string, uuid string, name string")


def test_rounds_equal_the_fold(spark, known):
    mentions, episodes = said(spark, some_turns(1))
    fold = resolution.fold_entities(mentions, episodes, known, LetterEmbedder(), MATCH)
    rounds = resolution.resolve_in_order(mentions, episodes, known, LetterEmbedder(), MATCH, Stages(spark, "rounds"))
    want = resolved(fold)
    assert resolved(rounds) == want and len(want) == mentions.count()
    assert len({(r[0], r[6]) for r in want}) < len({(r[0], r[2]) for r in want})  # near names share entities


def test_a_turn_does_not_see_its_own_names(spark, known):
    mentions, episodes = said(spark, [("g", 0, ["aaabbb", "aaabbbc"]), ("g", 1, ["aaabbbb"]), ("g", 2, ["zq"])])
    rows = {r[2]: r[6] for r in resolved(resolution.resolve_in_order(mentions, episodes, known, LetterEmbedder(), MATCH, Stages(spark, "own")))}
    assert rows["aaabbb"] != rows["aaabbbc"] and rows["aaabbbb"] == rows["aaabbb"] and len(set(rows.values())) == 3


def test_the_lower_threshold_wants_a_common_token(spark, known):
    # Similarity 0.8944 of "aab" to "aac b": between the thresholds.
    near = [("g", 0, ["xxa y"]), ("g", 1, ["xxa yz"]), ("g", 2, ["xxayw"])]
    mentions, episodes = said(spark, near)
    rows = {r[2]: r[6] for r in resolved(resolution.resolve_in_order(mentions, episodes, known, LetterEmbedder(), (0.99, 0.88), Stages(spark, "token")))}
    assert rows["xxa yz"] == rows["xxa y"] != rows["xxayw"]


def test_resolving_nothing(spark, known):
    mentions, episodes = said(spark, [("g", 0, ["a"])])
    none = mentions.limit(0)
    assert resolution.resolve_in_order(none, episodes, known, LetterEmbedder(), MATCH, Stages(spark, "none")).collect() == []
    assert resolution.fold_entities(none, episodes, known.limit(0), LetterEmbedder(), MATCH).collect() == []


def test_the_stream_equals_the_fold(spark, known, tmp_path):
    mentions, episodes = said(spark, some_turns(2, 2, 12))
    turns = resolution.turns_said(mentions, episodes, LetterEmbedder())
    for part in (turns.filter("seq < 5"), turns.filter("seq >= 5 AND seq < 9"), turns.filter("seq >= 9")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = fold_stream(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), MATCH)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert resolved(spark.read.parquet(f"{tmp_path}/out")) == resolved(resolution.fold_entities(mentions, episodes, known.limit(0), LetterEmbedder(), MATCH))


def test_facts_in_order(spark):
    at = datetime(2024, 1, 1)
    shape = "group_id string, source_uuid string, target_uuid string, uuid string, fact string, valid_at timestamp, seq long, pos long"
    edges = spark.createDataFrame([
        ("g", "a", "b", "n1", "likes tea", at, 1, 0),  # near the known fact, which takes over its text
        ("g", "a", "b", "n2", "likes teas", at, 2, 0),  # near the new text
        ("g", "a", "b", "n3", "zzz", at, 2, 1), ("g", "a", "b", "n4", "zzzz", at, 2, 2),  # near each other in one turn: two facts
        ("g", "b", "a", "n5", "likes tea", at, 3, 0),  # another direction
    ], shape)
    old = spark.createDataFrame([("g", "a", "b", "k1", "likes a tea", at)], "group_id string, source_uuid string, target_uuid string, uuid string, fact string, valid_at timestamp")
    rows = {(r["seq"], r["fact"]): r["uuid"] for r in resolution.fold_facts(edges, old, LetterEmbedder(), (0.94, 0.88)).collect()}
    assert rows == {(1, "likes tea"): "k1", (2, "likes teas"): "k1", (2, "zzz"): "n3", (2, "zzzz"): "n4", (3, "likes tea"): "n5"}


def test_a_failed_reflection_ends_only_its_turn(spark):
    turns = spark.createDataFrame([("g", "e1"), ("g", "e2"), ("g", "e3")], "group_id string, uuid string")
    found = spark.createDataFrame([("g", "e1", 0, "Ann"), ("g", "e2", 0, "Bob")], "group_id string, episode_uuid string, pos int, name string")
    asked = []

    def ask(active, so_far, step):
        asked.append(sorted(r["uuid"] for r in active.collect()))
        rows = active.select("group_id", F.col("uuid").alias("episode_uuid"), F.explode(F.array(F.lit(" Ann"), F.lit(f"new {step}"))).alias("name"), F.lit(0).alias("pos"))
        return rows.withColumn("failed", (F.col("episode_uuid") == "e2") & F.lit(step == 2))

    rows = reflection.reflect(turns, found, ask, reflection.by_name, 3, Stages(spark, "reflect")).collect()
    assert asked == [["e1", "e2", "e3"], ["e1", "e2", "e3"], ["e1", "e3"]]
    names = lambda e: sorted(r["name"].strip() for r in rows if r["episode_uuid"] == e)
    assert names("e1") == ["Ann", "new 1", "new 2", "new 3"] and names("e2") == ["Ann", "Bob", "new 1"] and names("e3") == ["Ann", "new 1", "new 2", "new 3"]


def test_pairs_do_not_span_batches(spark):
    mentions = spark.createDataFrame([("g", "e", f"name{k:02d}", f"name{k:02d}", k) for k in range(14)], "group_id string, episode_uuid string, key string, name string, pos long")
    edges = TokenExtractor().edges(None, in_batches(mentions, ingest.edge_batch_size(768))).collect()
    pairs = {(r["source"], r["target"]) for r in edges}
    assert len(pairs) == 11 and ("name05", "name06") not in pairs and ("name11", "name12") not in pairs and ("name00", "name01") in pairs


def counting(path):
    def load():
        def ask(texts):
            with open(path, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return ask

    return load


def test_texts_are_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    rows = spark.createDataFrame([(k, t, u) for k, (t, u) in enumerate([("one", "two"), ("one", None), ("", "one"), (None, "three")])], "id long, a string, b string")
    store = EmbeddingStore(spark, Stages(spark, "vectors").folder, RemoteEmbedder(counting(calls), 2), 4)
    first = {r["id"]: (r["va"], r["vb"]) for r in store.embed(rows, {"a": "va", "b": "vb"}).collect()}
    assert first == {0: ([3.0, 1.0], [3.0, 1.0]), 1: ([3.0, 1.0], None), 2: ([0.0, 1.0], [3.0, 1.0]), 3: (None, [5.0, 1.0])}
    assert sorted(calls.read_text().split("\n")[:-1]) == ["", "one", "three", "two"] and store.count() == 4
    assert {r["id"]: (r["va"], r["vb"]) for r in store.embed(rows, {"a": "va", "b": "vb"}).collect()} == first
    assert len(calls.read_text().split("\n")) == 5  # nothing was embedded again


def test_a_wrong_count_of_vectors_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    store = EmbeddingStore(spark, Stages(spark, "wrong").folder, RemoteEmbedder(lambda: lambda texts: [[1.0, 2.0]] * (len(texts) + 1), 2), 4)
    with pytest.raises(Exception, match="vectors of 2 components"):
        store.embed(rows, {"t": "v"})
    assert store.count() == 0


def test_ingesting_with_vectors(spark):
    kinds = {"episodes": schema.EPISODES, "entities": schema.ENTITIES, "mentions": schema.MENTIONS, "edges": schema.RELATES_TO}
    empty = {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}
    turn = lambda k, text: ("g", f"e{k}", f"s{k}", "Ann", text, datetime(2024, 1, k), k, None, None, False)
    turns = spark.createDataFrame([turn(1, "Jonathan visits Margarethe"), turn(2, "Jonnathan visited Margaretha"), turn(3, None), turn(4, "")], schema.EPISODES)
    vectors = EmbeddingStore(spark, Stages(spark, "letters").folder, LetterEmbedder(), 4)
    once = ingest_turns(empty, turns, TokenExtractor(), Config(), vectors=vectors)
    names = {r["name"] for r in once["entities"].collect()}
    assert names == {"Jonathan", "visits", "Margarethe", "Ann", "visited"}
    assert once["entities"].filter("name_embedding IS NULL OR summary_embedding IS NULL").count() == 0
    edges = once["edges"].collect()
    assert len(edges) == 4 and all(r["fact_embedding"] is not None for r in edges)
    assert [r["source_id"] for r in once["episodes"].filter("episode_embedding IS NOT NULL").orderBy("seq").collect()] == ["s1", "s2", "s4"]
    before = vectors.count()
    again = ingest_turns(once, turns, TokenExtractor(), Config(), vectors=vectors)
    for name in once:
        assert sorted(map(repr, again[name].select(sorted(once[name].columns)).collect())) == sorted(map(repr, once[name].select(sorted(once[name].columns)).collect()))
    assert vectors.count() == before
