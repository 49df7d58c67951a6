"""URL rules by Bloom filter cascades.

The keys of a url are its host and every parent domain, each with every
prefix of its path that is as long as some rule's path. All keys of a corpus
are the universe. Level 1 of a cascade holds the listed keys; level 2 the keys
of the universe that level 1 takes for listed; level 3 the listed keys that
level 2 takes for those, and so on until a level errs on nothing. The first
level that denies a key then tells exactly whether it is listed, for every
key of the universe, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bloom:
    """A Bloom filter of ``keys`` with about the given rate of false positives."""

    def __init__(self, keys: Iterable[str], rate: float, seed: int):
        keys, self.seed = list(keys), seed
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(len(keys) * self.hashes / math.log(2)))
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)
        for key in keys:
            for p in self._places(key):
                self.bits[p >> 3] |= 1 << (p & 7)
        self.bits = self.bits.tobytes()

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh128_intdigest(key.encode(), self.seed)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + k * b) % self.size for k in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """Exact membership in ``listed`` for every key of a universe, given what level 1 wrongly takes from it."""

    def __init__(self, first: Bloom, listed: set[str], wrong: set[str]):
        self.levels, include, exclude = [first], wrong, listed
        while include:
            level = Bloom(include, 0.5, first.seed + len(self.levels))
            self.levels.append(level)
            include, exclude = {k for k in exclude if k in level}, include

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z in lower case) and path; both empty for a url that is null or has no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def url_keys(host: str, path: str, lengths: list[int], depths: list[int]) -> list[str]:
    """The keys of a url, longest first; of equal length, the one with the longer host first.

    Only ends of the host with as many labels as some rule's host (``depths``)
    and beginnings of the path as long as some rule's (``lengths``) can be a
    rule, so a url has a bounded number of keys, however long it is.
    """
    if not host:
        return []
    labels = host.rsplit(".", max(depths, default=0))
    domains = [".".join(labels[-n:]) for n in sorted(depths, reverse=True) if n <= len(labels)]
    return sorted((d + path[:n] for d in domains for n in lengths if len(path) >= n), key=len, reverse=True)


def build_cascades(pages: DataFrame, rules: dict[str, set[str]], lengths: list[int], depths: list[int]) -> dict[str, Cascade]:
    """One cascade for each list of rules, over all keys of ``pages`` (columns host, path).

    Two passes: an approximate count of the universe sets the rate of level 1
    (size of the list times sqrt(1/2) over size of the universe), and the keys
    it wrongly takes are gathered. Those are about 0.7 for each listed key,
    whatever the size of the universe; if chance made them more than twenty
    times the list, another seed is tried.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for h, p in zip(*(c.to_pylist() for c in batch.columns)) for k in url_keys(h, p, lengths, depths)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    urls = pages.select("host", "path")
    universe = urls.mapInArrow(keys, "key string").agg(F.approx_count_distinct("key")).first()[0]
    for seed in range(0, 1000, 100):
        first = {name: Bloom(listed, min(0.5, max(1e-12, len(listed) * math.sqrt(0.5) / max(1, universe))), seed) for name, listed in rules.items()}

        def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {k for h, p in zip(*(c.to_pylist() for c in batch.columns)) for k in url_keys(h, p, lengths, depths)}
                pairs = sorted((name, k) for name, level in first.items() for k in found if k in level and k not in rules[name])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["name", "key"])

        most = 20 * sum(map(len, rules.values())) + 1000
        wrong = urls.mapInArrow(taken, "name string, key string").distinct().limit(most + 1).collect()
        if len(wrong) <= most:
            return {name: Cascade(level, rules[name], {r["key"] for r in wrong if r["name"] == name}) for name, level in first.items()}
    raise RuntimeError("level 1 takes too many keys for listed")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict on every url by ``rules`` of (verdict, host, path).

    Returns one row per input row: page_id, host, path, rule (host and path
    of the longest rule that fits, else null), verdict (the rule's, else
    ``default``). A rule fits its host and all subdomains if the url's path
    starts with the rule's. Of rules that share host and path, block counts.

    * A null url, or one without ``://``, has an empty host and path, fits no rule and gets ``default``.
    * Repeated rows and null ids give a row each; urls of any length are read whole.
    * An empty table gives an empty result. Other columns, whatever their names, are not read.

    The rules are the driver's own list; what the driver gathers from the corpus is bounded by its length.
    """
    lists: dict[str, set[str]] = {}
    for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):
        if not any(host + path in listed for listed in lists.values()):
            lists.setdefault(verdict, set()).add(host + path)
    lengths = sorted({len(path) for _, _, path in rules})
    urls = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).select("page_id", "host", "path")
    depths = sorted({host.count(".") + 1 for _, host, _ in rules})
    cascades = build_cascades(urls, lists, lengths, depths)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fits = ((k, v) for k in url_keys(host, path, lengths, depths) for v, cascade in cascades.items() if k in cascade)
                found.append(next(fits, (None, default)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, f"page_id {dict(urls.dtypes)['page_id']}, host string, path string, rule string, verdict string")
