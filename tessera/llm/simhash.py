"""SimHash near-duplicates: fingerprints, and all pairs within a Hamming distance by vantage-point trees.

Two fingerprints that differ in at most ``bits`` bits differ in at most
``bits // 2`` bits in their upper or in their lower half. So there is a
vantage-point tree over each half: an inner node holds a vantage point and a
radius, and its children the fingerprints within and beyond the radius. Each
fingerprint is owned by one leaf of each tree, and visits every leaf that the
triangle inequality cannot exclude: both children where its distance lies so
close to the radius that a partner may be on the other side. Leaves are the
shards that Spark groups by; within a leaf, distances of whole fingerprints to
one vantage point exclude most pairs, and the rest are compared exactly.

Equal fingerprints are one class, so copies are never expanded into pairs; and
a leaf gives back the links of a spanning forest, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, marked, marks, memory_of, small, written

SEED = 42
#: 64-bit words of a wide fingerprint, and the odd numbers that make them of one shingle hash.
WIDE = 4
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Fingerprints that a bucket of the wide search is expected to hold; part of the pairs at the threshold that may be missed.
BUCKET_ROWS, MISSED = 2_000, 0.001
#: Standard deviations above the mean distance of a pair at the threshold that still make it a candidate.
TAIL = 4
#: A bucket with more candidate pairs than this for each of its rows gives them in two steps (it decides speed, never results).
DENSE = 1
#: Slots of the map of a set of shingles, which bounds the exact difference, and pairs that are compared by them at once.
MAP_BITS, MAP_PAIRS = 2_048, 65_536
#: Nodes whose numbers are broadcast to pick their bitmaps; more are joined.
MAP_ROWS = 250_000
#: Documents whose shingles are counted to tell frequent ones, shingles that are told, and documents of the sample that a frequent one is in (they decide speed, never results).
PREFIX_SAMPLE, PREFIX_TOLD, PREFIX_LEAST = 4_096, 100_000, 3
#: Shingles of prefixes that one task compares, and that a task gathers before it deals them (speed only).
PREFIX_ROWS, PREFIX_BATCH = 4_000_000, 1 << 20
#: Rows of groups of such sets that one task takes, if no group is larger (speed only).
PREFIX_MEMBERS = 100_000
#: Fingerprints from which the trees are grown (a bounded sample; it decides speed, never results).
TREE_SAMPLE = 32_768
#: A leaf is split while it is expected to own more fingerprints than this; larger leaves are dealt to several tasks.
LEAF_ROWS = 3_000
#: Rows and columns of one comparison in memory.
TILE_ROWS, TILE_COLUMNS = 512, 8_192


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every shingle of ``words`` words; of all words if there are fewer."""
    tokens = text.encode().lower().split()  # ASCII letters and ASCII white space only
    hashes = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [hashes(b" ".join(tokens), SEED)] if tokens else []
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    return [hashes(line[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str, words: int) -> int:
    """The 64-bit SimHash of a text's shingles of ``words`` words, repeats counted."""
    h = shingle_hashes(text, words)
    if not h:
        return 0
    half = len(h) / 2
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        part = np.array(h[k : k + 65_536], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total > half, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; a null text has no words, and no words give 0."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            prints = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


class VantagePointTree:
    """A tree over the values of one half of a fingerprint, grown from a sample."""

    def __init__(self, sample: np.ndarray, expected: int, reach: int, leaf_rows: int):
        self.reach, self.leaves = reach, 0
        self.parts: list[int] = []
        share = expected / max(1, len(sample))

        def grow(own: np.ndarray) -> tuple:
            if len(own) * share > leaf_rows and len(own) > 16:
                for vantage in own[:: max(1, len(own) // 4)][:4]:
                    far = np.bitwise_count(own ^ vantage)
                    radius = int(np.median(far))
                    if radius == far.max():
                        radius -= 1
                    if (inner := far <= radius).any():
                        return int(vantage), radius, grow(own[inner]), grow(own[~inner])
            self.leaves += 1
            self.parts.append(max(1, round(len(own) * share / (2 * leaf_rows))))
            return (self.leaves - 1,)

        self.root = grow(sample)

    def route(self, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions that visit it, which of them it owns) for each leaf that is visited."""
        found: list[tuple[int, np.ndarray, np.ndarray]] = []

        def walk(node: tuple, at: np.ndarray, own: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 1:
                found.append((node[0], at, own))
                return
            vantage, radius, inner, outer = node
            far = np.bitwise_count(values[at] ^ np.uint32(vantage)).astype(np.int16)
            near = far - self.reach <= radius
            walk(inner, at[near], own[near] & (far[near] <= radius))
            away = far + self.reach > radius
            walk(outer, at[away], own[away] & (far[away] > radius))

        walk(self.root, np.arange(len(values)), np.ones(len(values), bool))
        return found


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that it reaches over the links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def leaf_links(rows: np.ndarray, columns: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``rows`` and ``columns`` (fingerprints) at ``bits`` or fewer bits."""
    vantage = rows[0]
    rows, columns = (x[np.argsort(np.bitwise_count(x ^ vantage), kind="stable")] for x in (rows, columns))
    far_r, far_c = (np.bitwise_count(x ^ vantage).astype(np.int16) for x in (rows, columns))
    values, place = np.unique(np.concatenate((rows, columns)), return_inverse=True)
    at_r, at_c = place[: len(rows)], place[len(rows) :]
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(rows), TILE_ROWS):
        tile = rows[i : i + TILE_ROWS]
        low = np.searchsorted(far_c, far_r[i] - bits)
        high = np.searchsorted(far_c, far_r[min(i + TILE_ROWS, len(rows)) - 1] + bits, side="right")
        for j in range(low, high, TILE_COLUMNS):
            other = columns[j : min(j + TILE_COLUMNS, high)]
            x, y = np.nonzero(np.bitwise_count(tile[:, None] ^ other[None, :]) <= bits)
            x, y = at_r[i + x], at_c[j + y]
            real = x != y
            if real.any():
                root = forest(len(values), np.concatenate((a, x[real])), np.concatenate((b, y[real])))
                a = np.nonzero(root != np.arange(len(values)))[0]
                b = root[a]
    return values[a], values[b]


def links(prints: DataFrame, bits: int = 3, tree_sample: int = TREE_SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct rows) at ``bits`` or fewer differing bits.

    Every pair within the distance is connected by the links, and every link
    is such a pair's chain within one leaf: links of a spanning forest.
    """
    expected = prints.count()
    sample = np.array([r[0] for r in prints.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, tree_sample / max(1, expected)))).select("fp").orderBy("fp").collect()], np.int64).view(np.uint64)
    halves = [lambda v: (v >> np.uint64(32)).astype(np.uint32), lambda v: v.astype(np.uint32)]
    trees = [VantagePointTree(half(sample), expected, bits // 2, leaf_rows) for half in halves]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            signed = np.asarray(batch.column(0))
            own_hash = signed.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            for k, (tree, half) in enumerate(zip(trees, halves)):
                for leaf, at, own in tree.route(half(signed.view(np.uint64))):
                    parts = tree.parts[leaf]
                    for part in range(parts):  # each part owns some rows, and every visitor sees all parts
                        mine = own & (own_hash[at] % np.uint64(parts) == part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), (leaf << 1 | k) * 65_536 + part)), pa.array(signed[at]), pa.array(mine)],
                            names=["shard", "fp", "own"],
                        )

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        memory_of("simhash")
        values, own = shard["fp"].to_numpy().view(np.uint64), shard["own"].to_numpy()
        if not own.any():
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = leaf_links(values[own], values, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    visits = prints.select("fp").mapInArrow(visit, "shard long, fp long, own boolean")
    return visits.groupBy("shard").applyInPandas(match, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose fingerprints are linked, directly or by a chain.

    Returns one row per input row: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id in the group).

    * A null text counts as empty; texts without words have fingerprint 0, which links like any other.
    * Texts with fewer than ``words`` words are one shingle of all their words.
    * Repeated rows, copies and rows of the same id give a row each. Null ids never are a component_id
      unless a group has no other.
    * Texts of any length are used whole. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.

    The driver sees a bounded sample of fingerprints (``TREE_SAMPLE``) and counts.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    grouped = components(written(links(nodes, bits), "simhash-links"), "simhash")
    rooted = nodes.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def wide_print(h: np.ndarray) -> bytes:
    """A SimHash of ``64 * WIDE`` bits of a set of shingle hashes; all zero for none."""
    total = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(h), 16_384):
        turned = h[k : k + 16_384, None] * _TURNS
        turned ^= turned >> np.uint64(32)
        turned *= _TURNS[0]
        total += np.unpackbits(turned.view(np.uint8).reshape(len(turned), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total > len(h) / 2).tobytes()


def wide_fingerprint(text: str, words: int) -> bytes:
    """A SimHash of ``64 * WIDE`` bits of the set of shingles; all zero without words."""
    return wide_print(shingle_set(text, words))


def differing_share(similarity: float) -> float:
    """The part of SimHash bits in which two sets of this Jaccard similarity (and equal size) differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def differing_most(share: float, sizes: int = 60) -> float:
    """The largest part of SimHash bits in which two sets of this Jaccard similarity or more differ on average.

    ``differing_share`` is the limit for large sets of equal size. Sets of few
    shingles differ in more bits, as a majority of few is decided by one of
    them (4 of 5 shingles in common: 3/16), so sets of up to ``sizes``
    shingles are counted exactly.
    """
    worst = differing_share(share)
    ones = [np.array([comb(n, k) for k in range(n + 1)], float) / 2**n for n in range(sizes + 1)]
    for common in range(1, sizes + 1):
        for x in range(sizes - common + 1):
            for y in range(x, sizes - common - x + 1):
                if common / (common + x + y) >= share:
                    s = np.arange(common + 1)[:, None]
                    a, b = (((s + np.arange(e + 1) > (common + e) / 2) * ones[e]).sum(axis=1) for e in (x, y))
                    worst = max(worst, float((ones[common] * (a * (1 - b) + b * (1 - a))).sum()))
    return worst


def search_plan(n: int, share: float) -> tuple[int, int, int]:
    """(bits of a sample, rounds, most differing bits of a candidate) for a search among ``n`` fingerprints.

    A pair at the threshold, whose differing bits are binomial if bits are
    independent, is missed with probability ``MISSED`` at most, over all its
    distances: by falling behind ``most``, or by no common sample in any round.
    """
    bits, differ = 64 * WIDE, differing_most(share)
    most = int(np.ceil(bits * differ + TAIL * np.sqrt(bits * differ * (1 - differ))))
    sampled = int(np.clip(np.ceil(np.log2(max(2, n) / BUCKET_ROWS)), 4, 24))
    chance = np.array([comb(bits, d) * differ**d * (1 - differ) ** (bits - d) for d in range(most + 1)])
    alone = 1 - np.array([comb(bits - d, sampled) / comb(bits, sampled) for d in range(most + 1)])
    rounds = 1
    while 1 - chance.sum() + (chance * alone**rounds).sum() > MISSED:
        rounds += 1
    return sampled, rounds, most


def distances(tile: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``tile`` and each of ``other``."""
    far = np.zeros((len(tile), len(other)), np.uint16)
    for w in range(WIDE):
        far += np.bitwise_count(tile[:, w, None] ^ other[None, :, w])
    return far


def shingle_map(h: np.ndarray) -> bytes:
    """For each of ``MAP_BITS`` slots whether an odd number of a set's shingle hashes lie there.

    Two such maps differ where that holds for the shingles that only one set
    has, so in no more slots than those are, and what large sets have in common hides none of them.
    """
    return np.packbits(np.bincount((h % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS).astype(np.uint8) & 1).tobytes()


def close_pairs(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of rows x and earlier rows y of ``prints`` that differ in at most ``most`` bits, tile by tile."""
    for i in range(0, len(prints), TILE_ROWS):
        tile = prints[i : i + TILE_ROWS]
        for j in range(0, i + len(tile), TILE_COLUMNS // WIDE):
            x, y = np.nonzero(distances(tile, prints[j : min(j + TILE_COLUMNS // WIDE, i + len(tile))]) <= most)
            x, y = x + i, y + j
            yield x[x > y], y[x > y]


def dealt(nodes: DataFrame, plan: tuple[int, int, int], *columns: str) -> DataFrame:
    """``columns`` of ``nodes`` (node long, wide binary), once for each round, with the bucket of the sampled bits of that round."""
    sampled, rounds, _ = plan
    rng = np.random.default_rng(SEED)
    places = np.stack([rng.choice(64 * WIDE, sampled, replace=False) for _ in range(rounds)])
    weights = (1 << np.arange(sampled)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WIDE), axis=1)
            for k in range(rounds):
                yield pa.RecordBatch.from_arrays([pa.array(k << sampled | bits[:, places[k]] @ weights), *(batch.column(c) for c in columns)], names=["bucket", *columns])

    types = dict(nodes.dtypes)
    return nodes.select("node", "wide").mapInArrow(deal, ", ".join(["bucket long", *(f"{c} {types[c]}" for c in columns)]))


def candidates(nodes: DataFrame, plan: tuple[int, int, int]) -> DataFrame:
    """Pairs (a, b) of nodes (node long, wide binary) whose fingerprints may be those of a similar pair.

    At such a similarity too many bits differ for trees over halves to exclude
    anything, so the search is by samples of bits: each round groups the
    fingerprints that agree in some sampled bits and compares all of a group
    on all bits. A group of more than ``DENSE`` pairs a row gives one row with
    its number in ``bucket`` (else null) and no pairs; ``dense_candidates``
    finds those.
    """

    def match(bucket: pd.DataFrame) -> pd.DataFrame:
        memory_of("simhash")
        ids, prints = bucket["node"].to_numpy(), np.frombuffer(b"".join(bucket["wide"]), np.uint64).reshape(-1, WIDE)
        found, count = [(np.empty(0, np.int64),) * 2], 0
        for x, y in close_pairs(prints, plan[2]):
            found.append((x, y))
            count += len(x)
            if count > DENSE * len(ids):
                return pd.DataFrame({"a": [0], "b": [0], "bucket": bucket["bucket"].iloc[:1].to_numpy()})
        a, b = (ids[np.concatenate(part)] for part in zip(*found))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bucket": pd.array([None] * len(a), "Int64")})

    return dealt(nodes, plan, "node", "wide").groupBy("bucket").applyInPandas(match, "a long, b long, bucket long")


def dense_candidates(members: DataFrame, nodes: DataFrame, most: int, share: float, closest: bool) -> DataFrame:
    """Pairs (a, b) of the dense groups ``members`` (bucket, node) of nodes (node, wide, map, size, root) of different roots.

    Beside the fingerprints, bitmaps of the sets of shingles exclude pairs:
    sets of sizes m and n with a Jaccard similarity of ``share`` or more differ
    in at most (m + n) (1 - share) / (1 + share) shingles, and their bitmaps
    never in more bits than that. So no similar pair is lost here. With
    ``closest``, each row gives only the closest of the rows before it and of all rows.
    """

    def match(bucket: pd.DataFrame) -> pd.DataFrame:
        memory_of("simhash")
        bucket = bucket.sort_values("node")  # so that all rounds find the same closest of the rows before
        ids, root, size = (bucket[c].to_numpy() for c in ("node", "root", "size"))
        prints, maps = (np.frombuffer(b"".join(bucket[c]), np.uint64).reshape(len(ids), -1) for c in ("wide", "map"))
        none = np.iinfo(np.int64).max
        found = [(np.empty(0, np.int64),) * 2]
        before, near = np.full(len(ids), none), np.full(len(ids), none)
        for xs, ys in close_pairs(prints, most):
            for k in range(0, len(xs), MAP_PAIRS):
                x, y = xs[k : k + MAP_PAIRS], ys[k : k + MAP_PAIRS]
                apart = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
                real = (root[x] != root[y]) & (apart * (1 + share) <= (size[x] + size[y]) * (1 - share) + 1e-9)
                x, y, d = x[real], y[real], apart[real] << 32
                if closest:
                    np.minimum.at(before, x, d | y)
                    np.minimum.at(near, x, d | y)
                    np.minimum.at(near, y, d | x)
                else:
                    found.append((x, y))
        if closest:
            found = [(at := np.nonzero(c < none)[0], c[at] & 0xFFFFFFFF) for c in (before, near)]
        a, b = (ids[np.concatenate(part)] for part in zip(*found))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # A node is joined once with all its buckets, of which there are at most as many as rounds.
    placed = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets")).join(nodes.select("node", "wide", "map", "size", "root"), "node")
    return placed.select("node", "wide", "map", "size", "root", F.explode("buckets").alias("bucket")).groupBy("bucket").applyInPandas(match, "a long, b long")


def prefix_of(h: np.ndarray, share: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set of shingle hashes, frequent ones last: two sets with a Jaccard similarity of ``share`` or more have one of these in common.

    Such sets have ``share`` of the larger one in common. If the first shingles
    of each, one more than may be missing, had nothing in common, the set whose
    last one of these comes earlier in the order would miss them all, which is too many. That
    holds for any order that is the same for all sets.
    """
    first = len(h) - int(np.ceil(share * len(h) - 1e-9)) + 1 if len(h) else 0
    if len(frequent) and first < len(h):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, counts[at], 0)
        if rank.any():
            h = h[np.lexsort((h, rank))]
    return h[:first]


def set_keys(h: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingle hashes; its ``kid`` are the first eight bytes."""
    return xxhash.xxh3_128_digest(h.tobytes())


def frequent_shingles(texts: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a bounded sample of ``texts`` (of about ``n``), in order of their hash, and their counts there."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text or "", words).view(np.int64))], names=["shingle"])

    some = texts.filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PREFIX_SAMPLE / max(1, n))))
    counted = some.select("text").mapInArrow(make, "shingle long").groupBy("shingle").count().filter(F.col("count") >= PREFIX_LEAST)
    told = counted.orderBy(F.desc("count"), "shingle").limit(PREFIX_TOLD).toPandas()
    hashes, counts = told["shingle"].to_numpy(np.int64).view(np.uint64), told["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix_members(nodes: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """Groups (bucket, kid, times) of sets that have a shingle of their prefixes in common (``prefix_of``): every similar pair is in one.

    Shingles are dealt in blocks, 32 bits of each beside the shard. Where
    these are equal by chance, a group is larger than it has to be. Equal
    groups of a shard are given once, with the number of them.
    """
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, round((total * (1 - share) + n) / PREFIX_ROWS))
    frequent, counts = frequent_shingles(texts, n, words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        kids, prefixes, held = [], [], 0

        def dealt_blocks() -> Iterator[pa.RecordBatch]:
            every, own = np.concatenate(prefixes), np.repeat(np.arange(len(kids), dtype=np.uint32), [len(p) for p in prefixes])
            shard, known = (every >> np.uint64(32)) % np.uint64(shards), np.array(kids, np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in range(shards):
                if ends[k] < ends[k + 1]:
                    at = order[ends[k] : ends[k + 1]]
                    present, place = np.unique(own[at], return_inverse=True)
                    block = (every[at].astype(np.uint32), place.astype(np.uint32), known[present])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in block)], names=["shard", "rest", "place", "kids"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = shingle_set(text or "", words)
                if len(h):
                    kids.append(int.from_bytes(set_keys(h)[:8], "little", signed=True))
                    prefixes.append(prefix_of(h, share, frequent, counts))
                    held += len(prefixes[-1])
                if held >= PREFIX_BATCH:
                    yield from dealt_blocks()
                    kids, prefixes, held = [], [], 0
        if held:
            yield from dealt_blocks()

    def match(table: pa.Table) -> pa.Table:
        memory_of("simhash")
        rest, kids = [], []
        for k in range(table.num_rows):
            row = [table.column(c)[k].as_py() for c in ("rest", "place", "kids")]
            rest.append(np.frombuffer(row[0], np.uint32))
            kids.append(np.frombuffer(row[2], np.int64)[np.frombuffer(row[1], np.uint32)])
        rest, kids, shard = np.concatenate(rest), np.concatenate(kids), table.column("shard")[0].as_py()
        order = np.argsort(rest, kind="stable")
        shared = rest[order][1:] == rest[order][:-1]
        order = order[np.concatenate((shared, [False])) | np.concatenate(([False], shared))]  # all others are in one set only
        order = order[np.lexsort((kids[order], rest[order]))]
        rest, kids = rest[order], kids[order]
        new = np.concatenate((np.ones(1, bool), (rest[1:] != rest[:-1]) | (kids[1:] != kids[:-1])))[: len(rest)]
        rest, kids = rest[new], kids[new]
        starts = np.nonzero(np.concatenate((np.ones(1, bool), rest[1:] != rest[:-1]))[: len(rest)])[0]
        sizes = np.diff(np.concatenate((starts, [len(rest)])))
        turned = kids.view(np.uint64)[:, None] * _TURNS[:2]
        turned ^= turned >> np.uint64(29)
        turned *= _TURNS[2:]
        sums = np.column_stack((sizes.astype(np.uint64), np.add.reduceat(turned, starts, axis=0))) if len(starts) else np.empty((0, 3), np.uint64)
        times = np.zeros(len(starts), np.int64)
        _, first, counted = np.unique(sums, axis=0, return_index=True, return_counts=True)
        times[first] = counted
        times = np.repeat(np.where(sizes > 1, times, 0), sizes)
        stays = times > 0
        return pa.table([pa.array(rest[stays].astype(np.int64) | shard << 32), pa.array(kids[stays]), pa.array(times[stays])], names=["bucket", "kid", "times"])

    blocks = texts.select("text").mapInArrow(deal, "shard int, rest binary, place binary, kids binary")
    return blocks.groupBy("shard").applyInArrow(match, "bucket long, kid long, times long")


def prefix_pairs(members: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of the groups ``members`` (bucket, times, node, root, size) of different roots that may be similar.

    Of two sets, that whose prefix ends earlier has all that both have in
    common up to there in both prefixes, and the rest of it, which has one less than ``share``
    of its shingles, may be in common too. So similar sets of about equal size have many shingles of
    their prefixes in common, by how many groups hold both.
    """
    parts = max(1, -(-members.count() // PREFIX_MEMBERS))

    def match(part: pd.DataFrame) -> pd.DataFrame:
        memory_of("simhash")
        part = part.sort_values(["bucket", "node"], kind="stable")
        ids, place = np.unique(part["node"].to_numpy(), return_inverse=True)
        bucket, times, root, size = (part[c].to_numpy().astype(np.int64) for c in ("bucket", "times", "root", "size"))
        starts = np.nonzero(np.concatenate((np.ones(1, bool), bucket[1:] != bucket[:-1])))[0]
        code, total = np.empty(0, np.int64), np.empty(0, np.int64)
        held, weights, count = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate((code, *held)), return_inverse=True)
            sums = np.zeros(len(every), np.int64)
            np.add.at(sums, at, np.concatenate((total, *weights)))
            return every, sums

        for i, j in zip(starts, [*starts[1:], len(bucket)]):
            for k, l in ((k, l) for k in range(i, j, TILE_ROWS) for l in range(i, min(k + TILE_ROWS, j), TILE_COLUMNS)):
                a, b = np.arange(k, min(k + TILE_ROWS, j))[:, None], np.arange(l, min(l + TILE_COLUMNS, k + TILE_ROWS, j))[None]
                x, y = np.nonzero((a > b) & (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b]) - 1e-9))
                held.append(place[k + x] * len(ids) + place[l + y])
                weights.append(np.full(len(x), times[i]))
                count += len(x)
                if count > 16 * MAP_PAIRS:
                    code, total = summed()
                    held, weights, count = [], [], 0
        code, total = summed()
        x, y = np.divmod(code, len(ids))
        sizes = np.zeros(len(ids), np.int64)
        sizes[place] = size
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "common": total, "m": sizes[x], "n": sizes[y]})

    found = members.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(parts))).applyInPandas(match, "a long, b long, common long, m long, n long")
    found = found.groupBy("a", "b").agg(F.sum("common").alias("common"), *[F.first(c).alias(c) for c in ("m", "n")])
    both = F.ceil((F.col("m") + F.col("n")) * (share / (1 + share)) - 1e-9)
    return found.filter(F.col("common") > both - F.ceil(F.greatest("m", "n") * share - 1e-9)).select("a", "b", "m", "n")


def near_maps(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The ``pairs`` (a, b, sizes m and n) that the bitmaps of nodes (node, map) do not exclude, as in ``dense_candidates``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("_x", "_y"))
            apart, sizes = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), np.asarray(batch.column("m")) + np.asarray(batch.column("n"))
            yield batch.select(["a", "b"]).filter(pa.array(apart * (1 + share) <= sizes * (1 - share) + 1e-9))

    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-mapped")
    maps = written(nodes.select("node", "map").join(small(asked, MAP_ROWS), "node", "left_semi"), "near-maps")
    for end, name in (("a", "_x"), ("b", "_y")):
        pairs = pairs.join(maps.select(F.col("node").alias(end), F.col("map").alias(name)), end)
    return pairs.mapInArrow(keep, "a long, b long")


def similar_groups(nodes: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """The groups (node, root) of nodes (node long, kid long, wide binary, map binary, size int, _sha string) that are linked by shingle sets with a Jaccard similarity of ``share`` or more.

    ``candidates`` finds pairs by their fingerprints, and the exact sets,
    made of ``texts`` (_sha, text) for the nodes of those pairs, decide. In
    dense groups the closest pairs are decided first; then all pairs that are
    not yet connected, so that many copies of one text are not compared each
    with each. Fingerprints leave out a pair whose bits differ by an
    unlikely lot or in each round's sample. So at last all pairs that are not yet connected and have a
    shingle of their prefixes in common (``prefix_members``) are decided too, which are all that can be similar.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for whole in batches:
            for k in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(k, TILE_ROWS)
                sets = [shingle_set(t or "", words).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def decided(pairs: DataFrame) -> DataFrame:
        asked = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "_sha"), "node"), "near-asked")
        wanted = small(asked)
        # Where the join shuffles, only texts that are asked for, and few others, take part.
        some = texts if wanted is not asked else marked(texts, "_sha", written(marks(asked, "_sha"), "near-marks"), "_asked").filter("_asked").drop("_asked")
        sets = some.join(wanted, "_sha").dropDuplicates(["_sha"]).select("node", "text").mapInArrow(make, "node long, shingles array<long>")
        sets = written(sets, "near-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
        both = both.select("a", "b", (F.size("s") + F.size("t")).alias("n"), F.size(F.array_intersect("s", "t")).alias("common"))
        return written(both.filter(F.col("common") / (F.col("n") - F.col("common")) >= share).select("a", "b"), "near-links")

    plan = search_plan(nodes.count(), share)
    found = written(candidates(nodes, plan), "near-found")
    pairs = found.filter("bucket IS NULL").select("a", "b")
    dense = written(found.filter("bucket IS NOT NULL").select("bucket"), "near-buckets")
    if dense.isEmpty():
        links = decided(written(pairs.distinct(), "near-pairs"))
    else:
        members = written(dealt(nodes, plan, "node").join(small(dense), "bucket", "left_semi"), "near-members")
        near = dense_candidates(members, nodes.withColumn("root", F.col("node")), plan[2], share, closest=True)
        links = decided(written(pairs.union(near).distinct(), "near-pairs"))
        rooted = nodes.join(components(links, "near-dense"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = dense_candidates(members, written(rooted, "near-rooted"), plan[2], share, closest=False)
        links = links.union(decided(written(rest.distinct(), "near-rest")))
    grouped = components(links, "near")
    # What the fingerprints left out: sets that share a shingle of their prefixes and are not connected.
    roots = nodes.join(grouped, "node", "left").select("node", "kid", "size", F.coalesce("root", "node").alias("root"))
    members = prefix_members(nodes, texts, words, share).join(roots, "kid")
    bucket = Window.partitionBy("bucket")
    members = members.withColumn("_least", F.min("root").over(bucket)).withColumn("_most", F.max("root").over(bucket)).filter("_least < _most")
    members = written(members.select("bucket", "times", "node", "root", "size"), "near-prefixes")
    rest = written(near_maps(written(prefix_pairs(members, share), "near-shared"), nodes, share), "near-left")
    if rest.isEmpty() or (more := decided(rest)).isEmpty():
        return grouped
    return components(links.union(more), "near-all")


def keep_one_of_near(docs: DataFrame, words: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when each group of near copies keeps its smallest doc_id.

    Groups are the components of links between documents whose sets of
    shingles have a Jaccard similarity of ``share`` or more (``similar_groups``).
    Rows with a null doc_id stay only if their group has no other; repeated
    rows of the smallest doc_id and equal text stay once. Null and empty texts
    and white space have no shingles and are one group. All columns, whatever
    their names, come back as they were; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("simhash")
        for batch in batches:
            sets = [shingle_set(t or "", words) for t in batch.column(2).to_pylist()]
            keys, prints, maps = ([f(h) for h in sets] for f in (set_keys, wide_print, shingle_map))
            made = [*(pa.array(x, pa.binary()) for x in (keys, prints, maps)), pa.array([len(h) for h in sets], pa.int32())]
            kids = pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, kids], names=["_id", "_sha", "key", "wide", "map", "size", "kid"])

    id_type = dict(docs.dtypes)["doc_id"]
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = docs.select(F.col("doc_id").alias("_id"), sha.alias("_sha"), F.col("text").alias("text"))
    texts = rows.select("_sha", "text")
    rows = written(rows.mapInArrow(run, f"_id {id_type}, _sha string, key binary, wide binary, map binary, size int, kid long"), "near-prints")
    nodes = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("wide", "map", "size", "kid")], F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_sha")).alias("first"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "kid", "wide", "map", "size", "first", F.col("first._sha").alias("_sha")), "near-nodes")
    grouped = similar_groups(nodes, texts, words, share)
    rooted = nodes.join(grouped, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._id").alias("_kept_id"), F.col("first._sha").alias("_kept_sha"))
    # One key of id and digest, so that the join and the removal of repeated rows share a shuffle.
    key = lambda i, digest: F.concat_ws("/", digest, F.col(i).cast("string"))
    kept = written(kept.select(key("_kept_id", F.col("_kept_sha")).alias("_key")), "near-kept")
    # Whole rows are shuffled only where some of their key may go: most stay where they are.
    keys = rows.groupBy(key("_id", F.col("_sha")).alias("_key")).agg(F.count("*").alias("n"))
    doubtful = keys.join(kept.withColumn("stays", F.lit(True)), "_key", "left").filter("stays IS NULL OR n > 1")
    doubtful = written(marks(doubtful, "_key"), "near-doubtful")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key("doc_id", sha).alias("_key"))
    rows = marked(rows, "_key", doubtful, "_doubtful")
    rest = rows.filter("_doubtful").select("_key", "_row").join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return rows.filter("NOT _doubtful").select("_row").union(rest.select("_row")).select("_row.*")
