"""Written tables and indexes: states, pruning, and the same results as without them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, store
from tessera.operators.snapshots import Snapshots, bucket_of
from tessera.operators.text_index import WrittenIndex
from tessera.operators.vector_index import VectorIndex, compared_share
from tessera.stages import Stages


def folder(spark, name):
    return Stages(spark, name).folder


# --- snapshots


def numbers(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def newest(old, new):
    return store.upsert(old, new, ["k"])


def test_only_touched_buckets_are_rewritten(spark):
    tables = Snapshots(spark, folder(spark, "touched"))
    tables.create("t", numbers(spark, *[(k, "old") for k in range(200)]), ["k"], 16)
    before = dict(map(tuple, tables.state()["t"]["parts"]))
    new = numbers(spark, (3, "new"), (1_000, "new"))
    touched = tables.upsert("t", new, newest)
    after = dict(map(tuple, tables.state()["t"]["parts"]))
    assert set(touched) == {r[0] for r in new.select(bucket_of(["k"], 16)).collect()} and 0 < len(touched) < 16
    assert all((after[b] == before[b]) == (b not in touched) for b in before)
    rows = dict(map(tuple, tables.read("t").collect()))
    assert len(rows) == 201 and rows[3] == rows[1_000] == "new" and rows[4] == "old"
    assert tables.upsert("t", new.limit(0), newest) == []


def test_readers_see_whole_states(spark):
    tables = Snapshots(spark, folder(spark, "states"))
    tables.create("t", numbers(spark, (1, "a"), (2, "b")), ["k"], 4)
    reader = tables.read("t")
    # A writer that dies before its number leaves its folders, and the state as it was.
    tables._add("t", numbers(spark, (9, "lost")), ["k"], 4)
    assert tables.read("t").count() == 2
    tables.upsert("t", numbers(spark, (1, "c")), newest)
    assert dict(map(tuple, reader.collect())) == {1: "a", 2: "b"}  # planned before the change, read after it
    assert dict(map(tuple, tables.read("t").collect())) == {1: "c", 2: "b"}
    assert dict(map(tuple, tables.read("t", version=1).collect())) == {1: "a", 2: "b"}
    with pytest.raises(RuntimeError):
        tables.commit(tables.state(), 1)
    assert tables.vacuum() >= 2 and tables.version() == 2
    assert dict(map(tuple, tables.read("t").collect())) == {1: "c", 2: "b"}


def test_tables_change_together(spark):
    tables = Snapshots(spark, folder(spark, "several"))
    tables.create("a", numbers(spark), ["k"], 4)
    tables.create("b", numbers(spark, (1, "x")), ["k"], 4)
    assert tables.read("a").collect() == []
    version = tables.append({"a": numbers(spark, (1, "x")), "b": numbers(spark, (1, "y"))})
    assert version == 3 and tables.read("a").count() == 1 and tables.read("b").count() == 2
    assert tables.read("b", tables.buckets_of("b", numbers(spark, (1, "")))).count() == 2


# --- text index


def documents(spark, n, seed=1):
    """Words with frequencies like those of a language; one word is in nearly all documents, and one document is very long."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = [(f"g{k % 3}", f"d{k:05d}", " ".join(["all", *rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=rng.randint(0, 40))] if k % 50 else ["all"] * rng.randint(1, 30))) for k in range(n)]
    rows += [("g0", "long", "all w1 " * 5_000), ("g1", "empty", ""), ("g1", "none", None)]
    return spark.createDataFrame(rows, "group_id string, uuid string, content string")


def asked(spark):
    texts = ["all", "all w0 w1", "w17 w200", "w399", "nothing here", "w3 all w3", ""]
    return spark.createDataFrame([(f"q{g}-{k}", f"g{g}", t) for g in range(3) for k, t in enumerate(texts)], "query_id string, group_id string, text string")


def found(df, score):
    return sorted((r["query_id"], r["uuid"], r[score], r["rank"]) for r in df.collect())


def test_written_index_equals_the_plain_one(spark):
    docs, queries = documents(spark, 3_000), asked(spark)
    text = F.col("content")
    index = WrittenIndex(spark, folder(spark, "index"), 32).create(docs.filter("uuid < 'd01500'"), text)
    index.append(docs.filter("uuid >= 'd01500'"), text)
    want = found(search.fulltext_search(search.build_text_index(docs, text), queries, 7), "fulltext_score")
    assert found(index.search(queries, 7), "fulltext_score") == want
    index.merge()
    assert found(index.search(queries, 7), "fulltext_score") == want
    every, read = (t.agg(F.sum("n")).first()[0] for t in index.plan(queries.filter("text = 'all'"), 7))
    assert read < every / 2  # blocks are skipped
    with pytest.raises(ValueError):
        index.append(docs.limit(3), text)


def test_a_search_reads_the_files_of_its_tokens(spark):
    index = WrittenIndex(spark, folder(spark, "files"), 32).create(documents(spark, 300), F.col("content"))
    files = lambda df: len(index.store.read("postings", index.store.buckets_of("postings", df)).inputFiles())
    tokens = lambda *t: spark.createDataFrame([(x,) for x in t], "token string")
    every = len(index.store.read("postings").inputFiles())
    assert 1 == files(tokens("all")) < files(tokens("all", "w1", "w2", "w3")) < every


def test_index_of_nothing(spark):
    index = WrittenIndex(spark, folder(spark, "nothing"), 4).create(documents(spark, 0).limit(0), F.col("content"))
    assert index.search(asked(spark), 3).collect() == []


# --- vector index


def test_pruned_vectors_equal_a_full_scan(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 16))
    rows = [("g" if k % 4 else "h", f"v{k:04d}", (centers[k % 20] + 0.05 * rng.normal(size=16)).tolist()) for k in range(1_200)]
    rows += [("g", "zero", [0.0] * 16), ("g", "short", [1.0, 2.0]), ("g", "opposite", (-centers[0]).tolist())] + [("g", f"same{k}", centers[1].tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "group_id string, uuid string, vector array<double>")
    odd = spark.createDataFrame([("g", "null", None), ("g", "none", []), ("g", "hole", [1.0, None] * 8), ("g", "nan", [float("nan")] * 16)], df.schema)
    queries = df.filter("uuid IN ('v0001', 'v0006', 'v0700', 'zero', 'short', 'same3', 'opposite')").select(F.concat(F.lit("q"), "uuid").alias("query_id"), "group_id", "vector")
    queries = queries.unionByName(spark.createDataFrame([("qh", "h", centers[3].tolist()), ("qz", "none", centers[3].tolist())], queries.schema))
    index = VectorIndex(spark, folder(spark, "vectors"), 16).create(df.unionByName(odd), "vector", 32)
    assert found(index.search(queries, 9), "similarity") == found(search.vector_search(df, "vector", queries, 9), "similarity")
    share = compared_share(*index.plan(queries.filter("query_id IN ('qv0001', 'qv0006', 'qv0700', 'qh')"), 9))
    assert 0 < share < 0.5  # of clustered vectors only some are compared


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "group_id string, uuid string, vector array<double>")
    index = VectorIndex(spark, folder(spark, "no-vectors"), 4).create(empty, "vector")
    asked = spark.createDataFrame([("q", "g", [1.0, 0.0])], "query_id string, group_id string, vector array<double>")
    assert index.search(asked, 3).collect() == []


def test_stages_are_released(spark):
    with Stages(spark, "released") as stages:
        kept = stages.keep_all({"a": spark.range(3), "b": spark.range(4)})
        assert kept["a"].count() + kept["b"].count() == 7
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stages.folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path)
