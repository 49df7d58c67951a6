"""Bitmaps of keys, and what the near stage shuffles: texts that are asked for and rows that may go, not all."""

import random

from pyspark.sql import functions as F

from tessera.llm import common, simhash


def test_marks_hold_every_key(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 1 << 17)
    rows = spark.range(6_000).select(F.col("id"), F.concat(F.lit("k"), "id").alias("key"))
    found = common.marked(rows, "key", common.marks(rows.filter("id % 5 = 0"), "key"), "there").collect()
    assert len(found) == 6_000 and all(r["there"] for r in found if r["id"] % 5 == 0)
    assert sum(r["there"] for r in found if r["id"] % 5) < 300
    assert not any(r["there"] for r in common.marked(rows, "key", common.marks(rows.limit(0), "key"), "there").collect())


def shuffled(df):
    """Bytes that the plan of ``df`` has shuffled once it ran."""
    df.write.format("noop").mode("overwrite").save()
    plan, total = df._jdf.queryExecution(), 0
    plan.executedPlan().execute().count()
    nodes = [plan.executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() in ("AdaptiveSparkPlan",):
            node = node.executedPlan()
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        metric = node.metrics().get("shuffleBytesWritten")
        total += metric.get().value() if metric.isDefined() else 0
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_rows_that_stay_are_not_shuffled(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))
    rows = [(k, text()) for k in range(300)]
    rows += [(1_000 + k, rows[k][1] + " more") for k in range(10)] + rows[20:25]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string"), "test-marks")
    kept = simhash.keep_one_of_near(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    assert shuffled(kept) < 0.6 * sum(len(t) for _, t in rows)
