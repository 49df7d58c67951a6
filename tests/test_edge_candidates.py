"""Candidates for equal facts: by hand, from both kinds of index, and without a query's rows shuffled for each step."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import search

EDGES = [
    # group, uuid, source, target, fact, vector
    ("g", "0" * 31 + "1", "a", "b", "Anna with Berta", [1.0, 0.0]),
    ("g", "0" * 31 + "2", "a", "b", "anna with with berta again", [1.0, 1.0]),
    ("g", "e3", "a", "b", "other words", None),
    ("g", "e4", "a", "b", "Anna Anna", [0.0, 1.0, 0.0]),
    ("g", "e5", "b", "a", "Berta with Anna", [1.0, 0.0]),
    ("g", "e6", "a", "a", "...", [0.0, 0.0]),
    ("h", "e7", "a", "b", "anna with berta", [1.0, 0.5]),
]


def tokens(text):
    return "".join(c if c.isalnum() or c in "_-" else " " for c in (text or "").lower()).split()


def by_hand(queries, limit, per_group):
    found = {}
    for q, group, source, target, text, vector in queries:
        lists = [[], []]
        for g, uuid, s, t, fact, v in EDGES:
            if (g, s, t) != (group, source, target):
                continue
            docs = [tokens(e[4]) for e in EDGES if tokens(e[4]) and (e[0] == g or not per_group)]
            words, mean = tokens(fact), sum(map(len, docs)) / len(docs)
            score, hit = 0.0, False
            for w in set(tokens(text)) & set(words):
                df, hit = sum(w in d for d in docs), True
                tf = words.count(w)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if hit:
                lists[0].append((-round(score, 6), uuid))
            if v and vector and len(v) == len(vector):
                size = math.hypot(*v) * math.hypot(*vector)
                lists[1].append((-round(sum(a * b for a, b in zip(v, vector)) / size, 6) if size else 0.0, uuid))
        best = {}
        for n, rows in enumerate(lists):
            for rank, (score, uuid) in enumerate(sorted(rows)[:limit], 1):
                row = best.setdefault(uuid, [0.0, None, None, (n, rank)])
                row[0], row[1 + n] = row[0] + 1 / (60 + rank), -score
        order = sorted(best, key=lambda u: (-round(best[u][0], 9), -(best[u][2] or 0), -(best[u][1] or 0), best[u][3], u))
        for rank, uuid in enumerate(order[:limit], 1):
            found[q, uuid] = (round(best[uuid][0], 9), best[uuid][1], best[uuid][2], rank)
    return found


@pytest.mark.parametrize("kind", ["documents", "per group", "postings"])
def test_candidates_by_hand(spark, monkeypatch, kind):
    monkeypatch.setattr(search, "FREQUENT", 1)
    edges = spark.createDataFrame(EDGES, "group_id string, uuid string, source_uuid string, target_uuid string, fact string, fact_embedding array<float>")
    queries = [(f"q-{u}" if u != "e7" else "e7", g, s, t, f, v) for g, u, s, t, f, v in EDGES]
    queries += [("none", "g", "a", "b", None, None), ("far", "g", "x", "b", "anna", [1.0, 0.0]), ("same", "g", "a", "b", "again berta", [3.0, 1.0])]
    asked = spark.createDataFrame(queries, "query_id string, group_id string, source_uuid string, target_uuid string, text string, vector array<float>")
    index = search.build_text_index(edges, F.col("fact"), kind == "per group")
    if kind == "postings":
        index = search.index_of(index.postings)
    for limit in (2, 5):
        want = by_hand(queries, limit, kind == "per group")
        found = {(r["query_id"], r["uuid"]): (r["rrf_score"], r["fulltext_score"], r["similarity"], r["rank"]) for r in search.edge_candidates(index, edges, asked, limit).collect()}
        assert found.keys() == want.keys()
        for key, row in found.items():
            assert row[3] == want[key][3] and row[:3] == pytest.approx(want[key][:3], abs=2e-6)


def test_rows_of_a_query_meet_once(spark):
    edges = spark.createDataFrame(EDGES, "group_id string, uuid string, source_uuid string, target_uuid string, fact string, fact_embedding array<float>")
    asked = edges.select(F.col("uuid").alias("query_id"), "group_id", "source_uuid", "target_uuid", F.col("fact").alias("text"), F.col("fact_embedding").alias("vector"))
    plan = search.edge_candidates(search.build_text_index(edges, F.col("fact")), edges, asked, 5)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("(_task" in line for line in dealt) == 1 and not any(c in line.partition("hashpartitioning(")[2].partition(")")[0] for line in dealt for c in ("query_id", "uuid"))
