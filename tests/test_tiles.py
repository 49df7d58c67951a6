"""Exact searches in tiles: groups larger than a task, ties of copies, queries with equal texts."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.queries.building import nearest_in_label

ROWS = "group_id string, uuid string, vector array<double>"


def test_a_group_of_several_tiles_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_ROWS", 40)
    monkeypatch.setattr(search, "TILE_QUERIES", 7)
    monkeypatch.setattr(search, "AT_ONCE", 64)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 8)).round(2)
    v[100:] = v[3]  # copies: the least uuids stand first
    rows = [("g", f"v{k:03d}", x.tolist()) for k, x in enumerate(v)]
    odd = [("h", "one", [1.0, 2.0]), ("h", "other", [2.0, 1.0, 0.0]), ("g", "null", None), ("g", "hole", [1.0, None] * 4), ("g", "zero", [0.0] * 8)]
    asked = [("q" + u, g, x) for g, u, x in rows[::9] + odd[:1] + odd[2:3]]
    queries = spark.createDataFrame(asked, "query_id string, group_id string, vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["uuid"], r["similarity"]) for r in search.vector_search(spark.createDataFrame(rows + odd, ROWS), "vector", queries, 6).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {("qone", 1): ("one", 1.0)}
    for k in range(0, 150, 9):
        near = [(-round(float(s), 6), f"v{j:03d}") for j, s in enumerate(unit @ unit[k])] + [(-0.0, "hole"), (-0.0, "zero")]
        want |= {(f"qv{k:03d}", i + 1): (u, -s) for i, (s, u) in enumerate(sorted(near)[:6])}
    assert found == want


class Asked:
    """A written index that remembers its queries."""

    def search(self, queries, limit):
        self.texts = sorted((r["group_id"], r["text"]) for r in queries.collect())
        return queries.select("query_id", "group_id", F.concat("group_id", F.lit("-doc")).alias("uuid"), F.lit(1.0).alias("fulltext_score"), F.lit(1).alias("rank"))


def test_equal_texts_of_a_group_are_searched_once(spark):
    rows = [(f"q{k}", f"g{k % 2}", ("The and", "and the THE", "other", "", None)[k % 5]) for k in range(40)]
    index = Asked()
    found = search.fulltext_search(index, spark.createDataFrame(rows, "query_id string, group_id string, text string"), 5)
    assert {(r["query_id"], r["uuid"], r["rank"]) for r in found.collect()} >= {(q, f"{g}-doc", 1) for q, g, t in rows if t}
    assert [t for t in index.texts if t[1]] == [("g0", "and the"), ("g0", "other"), ("g1", "and the"), ("g1", "other")]


def test_rows_of_its_own_do_not_count(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [1.0, 0.0]), (1, 4, [0.0, 1.0]), (2, 5, [1.0, 0.0])], "group_id int, uuid long, vector array<double>")
    queries = rows.select(F.col("uuid").alias("query_id"), "group_id", F.col("uuid").alias("own"), "vector")
    assert sorted((r["query_id"], r["uuid"]) for r in search.vector_search(rows, "vector", queries, 1).collect()) == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_nearest_in_label_has_no_join_of_all_pairs(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.8, 0.6], 1), (20, [1.0, 1.0], 2), (21, None, 2), (40, None, 3), (41, [1.0, 0.0], 3), (42, [1.0, 0.0], 3), (60, [1.0, 0.0], 4), (80, [1.0, 0.0], None), (81, [1.0, 0.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = nearest_in_label(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, 2), (20, 21), (40, 41)]
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
