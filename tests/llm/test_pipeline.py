"""The pipeline against its stages done by hand."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, pieces, queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    before = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == before.columns
        kept[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]

    every = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    judge = toxicity.learn(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    judge.start()
    assert sorted(kept["toxicity"]) == sorted(r for r in every if judge.score(r[1]) < 0.7)

    last = {}
    for r in sorted(kept["toxicity"]):
        last[r[1]] = r
    assert sorted(kept["exact_dedup"]) == sorted(last.values())

    # The stage's rule on all pairs: sets of five-word shingles, a Jaccard similarity of 0.8 or more.
    rows = sorted(kept["exact_dedup"])
    sets = [set(simhash.shingle_hashes(r[1] or "", 5)) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if k in (x, y) else k for k in root]
    assert sorted(kept["simhash_near_dedup"]) == [r for k, r in enumerate(rows) if root[k] == k]

    near = spark.createDataFrame(kept["simhash_near_dedup"], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(near).collect()}
    assert Counter(r[0] for r in kept["mixing"]) == {k: n for k, n in copies.items() if n}

    coder = pieces.encoder(pieces.default_model())
    digest = lambda t: hashlib.sha256(",".join(map(str, coder.encode(t))).encode()).hexdigest()
    found = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert found == sorted((i, digest(t)) for i, t, _ in kept["mixing"])


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"empty-{name}")
        assert docs.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "one text of some words to keep", "a"), (1, "one text of some words to keep", "a"), (2, None, None), (None, "", "a"), (None, "no id but a text of its own", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("_sha", "_row", "_key", "_id", "_copy", "_shard", "shuffle_key", "alt", "size", "score"):
        docs = docs.withColumn(name, F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns
        assert {tuple(r[3:]) for r in found.collect()} == {("own",) * 10}


def test_registry():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)
