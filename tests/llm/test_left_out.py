"""The pipeline's near stage where the fingerprints find nothing: the prefixes of the sets still give every similar pair."""

import random

import numpy as np
import pytest

from tessera.llm import simhash

from test_whole import jaccard_kept, near_rows


def test_similar_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(3)
    for n in (*range(1, 40), 200, 1_000):
        for _ in range(20):
            pool = rng.permutation(3 * n + 3).astype(np.uint64)
            for common in range(int(np.ceil(0.8 * n)), n + 1):
                a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : n + max(0, int(common / 0.8 + 1e-9) - n)])))
                if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    frequent = np.sort(rng.choice(pool, n, replace=False))
                    counts = rng.integers(1, 5, n)
                    assert len(np.intersect1d(*(simhash.prefix_of(h, 0.8, frequent, counts) for h in (a, b))))


@pytest.mark.parametrize("rows_of_a_task", [4_000_000, 100])
def test_no_pair_is_left_out_where_fingerprints_find_none(spark, monkeypatch, rows_of_a_task):
    """With candidates of equal fingerprints only, nearly all pairs are left to the prefixes."""
    monkeypatch.setattr(simhash, "search_plan", lambda n, share: (24, 1, 0))
    monkeypatch.setattr(simhash, "PREFIX_ROWS", rows_of_a_task)
    rows = near_rows(9, 60, [5, 8, 9, 10, 14, 60, 120])
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    for k in range(60):  # and a group of many near copies, and a line that all texts of another hold
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 4, 7))):
            words[at] = f"x{k}y{at}"
        rows += [(1_000 + k, " ".join(words)), (2_000 + k, " ".join([*base[:40], *(f"z{k}" for _ in range(3)), *(f"u{k}v{j}" for j in range(k % 9))]))]
    kept = simhash.keep_one_of_near(spark.createDataFrame([*rows, (5_000, None), (5_001, " ")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*jaccard_kept(rows, 5, 0.8), 5_000])
