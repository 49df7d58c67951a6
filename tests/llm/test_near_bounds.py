"""The pipeline's near stage in dense groups: the bitmaps lose no similar pair, and the result equals all pairs."""

import random

import numpy as np

from tessera.llm import simhash


def test_bitmaps_never_exclude_a_similar_pair():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 60, 146, 3_000, 40_000):
        every = rng.integers(0, 1 << 63, n + n // 4 + 2, dtype=np.int64).astype(np.uint64)
        for part in (n, n + n // 8, n + n // 4):
            a, b = np.unique(every[:n]), np.unique(every[:part])
            apart = np.unpackbits(np.frombuffer(simhash.shingle_map(a), np.uint8) ^ np.frombuffer(simhash.shingle_map(b), np.uint8)).sum()
            assert apart <= len(np.setxor1d(a, b))


def test_a_dense_group_equals_all_pairs(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(260):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 5, 6, 9))):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if k in (x, y) else k for k in root]
    want = [k for k, r in enumerate(root) if r == k]
    assert 1 < len(want) < len(texts) - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_near(docs).collect()) == want
