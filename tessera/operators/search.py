"""Full-text (BM25) and vector search, batched over queries, and their fusion.

A query set has query_id, group_id, and text or a vector. Searches give
query_id, group_id, uuid and a score; the ``limit`` best rows of each query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tessera.functions.text import packed, stable_id, tokens, unpacked
from tessera.functions.vectors import as_doubles, cosine
from tessera.stages import Stages

from .fusion import fuse_ranked

K1, B = 1.2, 0.75
#: Rows and queries of one group that a task compares, and similarities that it holds at once.
TILE_ROWS, TILE_QUERIES, AT_ONCE = 16_384, 2_048, 1 << 21
#: Tokens whose frequencies are broadcast.
FREQUENT = 1_000


@dataclass
class TextIndex:
    """An inverted index as tables, which can be persisted or written: one row per document and token."""

    postings: DataFrame  # token, group_id, uuid, tf, len
    frequencies: DataFrame  # token, df
    totals: DataFrame  # n_docs, mean_len (one row)
    text: Column | None = None  # the text of a document, where it was built of documents


def build_text_index(docs: DataFrame, text: Column, per_group: bool = False) -> TextIndex:
    """Index ``docs`` (group_id, uuid). Frequencies are over all groups unless ``per_group``."""
    words = tokenized(docs, text)
    group = ["group_id"] if per_group else []
    frequencies = words.select("group_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token", *group).agg(F.count("*").alias("df"))
    totals = words.groupBy(*group).agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    return TextIndex(counted_postings(words), frequencies, totals, text)


def tokenized(docs: DataFrame, text: Column) -> DataFrame:
    """The tokens of each document that has some, and their number: group_id, uuid, tokens, len. A uuid has one document."""
    words = docs.select("group_id", "uuid", tokens(F.lower(text)).alias("tokens"))
    return words.withColumn("len", F.size("tokens").cast("long")).filter("len > 0")


def counted_postings(words: DataFrame) -> DataFrame:
    """How often each document of ``tokenized`` has each token: token, group_id, uuid, tf, len. The length comes along, so nothing is joined."""
    flat = words.select("group_id", "uuid", "len", F.explode("tokens").alias("token"))
    return flat.groupBy("group_id", "uuid", "token").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def index_of(postings: DataFrame) -> TextIndex:
    """The index of stored ``postings`` (token, group_id, uuid, tf, len), with frequencies over all groups."""
    lengths = postings.select("group_id", "uuid", "len").distinct()
    return TextIndex(postings, postings.groupBy("token").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len")))


def with_frequencies(wanted: DataFrame, frequencies: DataFrame, by: list[str]) -> DataFrame:
    """The ``wanted`` tokens that the index has, with df.

    The frequencies of the ``FREQUENT`` most frequent tokens are broadcast, so
    that the rows of such a token stay where they are; those of all others are joined.
    """
    most = F.broadcast(frequencies.select(*by, "df").orderBy(F.desc("df"), *by).limit(FREQUENT))
    rest = wanted.join(most, by, "left_anti").join(frequencies.select(*by, "df"), by)
    return wanted.join(most, by).unionByName(rest)


def weights(found: DataFrame, index: TextIndex) -> tuple[DataFrame, Column]:
    """``found`` (tf, len, df) with the totals of ``index``, and what a token adds to the BM25 of its document."""
    group = [c for c in ("group_id",) if c in index.totals.columns]
    found = found.join(index.totals, group) if group else found.crossJoin(F.broadcast(index.totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    return found, idf * tf


def fulltext_scores(index: TextIndex, queries: DataFrame) -> DataFrame:
    """BM25 of every document of the query's group that holds one of its tokens: query_id, group_id, uuid, fulltext_score."""
    wanted = queries.select("query_id", "group_id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("token"))
    group = [c for c in ("group_id",) if c in index.frequencies.columns]
    # Joined to the tokens that are asked for, before these meet the postings: a frequent token's postings stay dealt.
    wanted = wanted.join(index.frequencies, ["token", *group])
    found, weight = weights(index.postings.join(wanted, ["group_id", "token"]), index)
    return found.groupBy("query_id", "group_id", "uuid").agg(F.sum(weight).alias("fulltext_score"))


def top_per_query(scores: DataFrame, score: str, limit: int, ties: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """The ``limit`` best rows of each query, with their rank from 1; ties by uuid."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fulltext_search(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """The best documents of each query. A written index (``text_index``) searches by itself, with the same result.

    Queries of a group with the same tokens have the same documents, so each set of tokens is searched once.
    """
    asked = queries.select("query_id", "group_id", F.array_join(F.array_sort(F.array_distinct(tokens(F.lower("text")))), " ").alias("text")).filter("text <> ''")
    asked = asked.withColumn("_asked", stable_id("asked", F.col("group_id"), F.col("text")))
    texts = asked.select(F.col("_asked").alias("query_id"), "group_id", "text").distinct()
    if hasattr(index, "search"):
        found = index.search(texts, limit)
    else:
        scores = fulltext_scores(index, texts)
        # The first six places decide the order, so that sums in another order give the same ranks.
        found = top_per_query(scores.withColumn("fulltext_score", F.round("fulltext_score", 6)), "fulltext_score", limit)
    found = asked.select("query_id", "_asked").join(found.withColumnRenamed("query_id", "_asked"), "_asked").drop("_asked", "rank")
    # Ranked again, as a query may ask in several groups.
    return top_per_query(found.select("query_id", "group_id", "uuid", "fulltext_score"), "fulltext_score", limit)


def matrix(vectors: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``size`` components as rows, and their lengths: 0 for one that holds a null."""
    flat = vectors.combine_chunks().flatten()
    rows = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("f8").reshape(-1, size)
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    if flat.null_count:
        lengths[flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)] = 0.0
    return rows, lengths


def millionths(near: np.ndarray) -> np.ndarray:
    """Similarities in whole millionths, halves away from zero; above all others where it is no number, as Spark has it."""
    near = near * 1e6
    near = np.copysign(np.floor(np.abs(near) + 0.5), near)
    return np.where(np.isnan(near), 1 << 29, near).astype(np.int64)


def best_of_tile(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a tile's queries and rows: the ``limit`` best rows of each query by rounded similarity, ties by uuid, without its ``own``."""

    def run(asked: pa.Table, have: pa.Table) -> pa.Table:
        have = have.sort_by("uuid")
        size = have.column("_d")[0].as_py() if have.num_rows else 0
        names = ["query_id", "group_id", "uuid", "similarity"]
        if not have.num_rows or not asked.num_rows:
            return pa.table([*(x.column(c).slice(0, 0) for x, c in ((asked, "query_id"), (have, "group_id"), (have, "uuid"))), pa.array([], pa.float64())], names=names)
        rows, lengths = matrix(have.column("_v"), size)
        queries, q_lengths = matrix(asked.column("_q"), size)
        uuids, place = have.column("uuid").to_pylist(), {}
        own = asked.column("own").to_pylist() if "own" in asked.column_names else []
        if own:
            for k, u in enumerate(uuids):
                place.setdefault(u, []).append(k)
        last, step = len(rows) - 1 - np.arange(len(rows)), max(1, AT_ONCE // len(rows))
        at_q, at_v, values = [], [], []
        for i in range(0, len(queries), step):
            with np.errstate(all="ignore"):
                scale = q_lengths[i : i + step, None] * lengths
                near = queries[i : i + step] @ rows.T / scale
            near[scale == 0] = 0.0
            key = (millionths(near) << 32) + last  # the similarity, then the first place
            for k, o in enumerate(own[i : i + step]):
                key[k, place.get(o, [])] = np.iinfo(np.int64).min
            best = np.broadcast_to(np.arange(len(rows)), key.shape)
            if limit < len(rows):
                best = np.argpartition(key, len(rows) - limit, axis=1)[:, len(rows) - limit :]
            found = np.take_along_axis(key, best, axis=1)
            q, v = np.nonzero(found > np.iinfo(np.int64).min)
            at_q.append(q + i)
            at_v.append(best[q, v])
            values.append(found[q, v] >> 32)
        whole = np.concatenate(values)
        similarity = np.where(whole == 1 << 29, np.nan, whole / 1e6)
        at_q, at_v = np.concatenate(at_q), np.concatenate(at_v)
        return pa.table([asked.column("query_id").take(pa.array(at_q)), have.column("group_id").take(pa.array(at_v)), have.column("uuid").take(pa.array(at_v)), pa.array(similarity)], names=names)

    return run


def in_tiles(asked: DataFrame, have: DataFrame) -> tuple[GroupedData, GroupedData]:
    """``asked`` (query_id, group_id, _d, ...) and ``have`` (uuid, group_id, _d, ...) dealt into tiles, to be cogrouped.

    A group and dimension of any size is dealt into tiles of rows and of
    queries, and each tile of queries meets each tile of rows in one task.
    """
    by = ["group_id", "_d"]

    def larger(t: DataFrame, most: int, name: str) -> DataFrame:
        """The groups of more than one tile; there are fewer of them than tiles."""
        return F.broadcast(t.groupBy(*by).count().filter(F.col("count") > most).select(*by, F.ceil(F.col("count") / most).alias(name)))

    row_tiles, query_tiles = larger(have, TILE_ROWS, "_rows"), larger(asked, TILE_QUERIES, "_queries")

    def tiled(t: DataFrame, key: str, mine: str, other: str, n: str, m: str) -> DataFrame:
        t = t.join(row_tiles, by, "left").join(query_tiles, by, "left")
        t = t.withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))))
        return t.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(m, F.lit(1)) - 1))).drop("_rows", "_queries")

    tiles = [*by, "_tile", "_asked"]
    have = tiled(have, "uuid", "_tile", "_asked", "_rows", "_queries").groupBy(*tiles)
    # Names of its own, as both sides may come from one table.
    return tiled(asked, "query_id", "_asked", "_tile", "_queries", "_rows").withColumnRenamed("group_id", "_group").groupBy("_group", *tiles[1:]), have


def vector_search(rows: DataFrame, vector: str, queries: DataFrame, limit: int) -> DataFrame:
    """Exact cosine of each query's vector with all rows of its group that have a vector of the same dimension.

    Each pair of tiles (see ``in_tiles``) is a matrix product in one task that gives back the ``limit``
    best of each query. Only those are ranked. Where ``queries`` have a column
    ``own``, the rows with that uuid do not count.
    """
    compact = (lambda c: c) if dict(rows.dtypes)[vector] == dict(queries.dtypes)["vector"] == "array<float>" else as_doubles
    have = rows.filter(F.col(vector).isNotNull()).select("group_id", "uuid", compact(F.col(vector)).alias("_v"), F.size(vector).alias("_d"))
    own = [c for c in ("own",) if c in queries.columns]
    asked = queries.filter("vector IS NOT NULL").select("query_id", "group_id", *own, compact(F.col("vector")).alias("_q"), F.size("vector").alias("_d"))
    types = {**dict(rows.dtypes), "query_id": dict(queries.dtypes)["query_id"]}
    schema = ", ".join([*(f"{c} {types[c]}" for c in ("query_id", "group_id", "uuid")), "similarity double"])
    asked, have = in_tiles(asked, have)
    return top_per_query(asked.cogroup(have).applyInArrow(best_of_tile(limit), schema), "similarity", limit)


def hybrid_search(index: TextIndex, rows: DataFrame, vector: str, queries: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Full text and vectors, each with its ``limit`` best, fused by reciprocal ranks.

    The entity, episode, fact and duplicate searches are this one over
    different text and vector columns.
    """
    text = fulltext_search(index, queries, limit).withColumn("list_no", F.lit(0))
    near = vector_search(rows, vector, queries, limit).withColumn("list_no", F.lit(1))
    return fuse_ranked(text.unionByName(near, allowMissingColumns=True), limit, k)


def fact_search(index: TextIndex, edges: DataFrame, queries: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Facts near each query, by text and, where queries and edges have vectors, by ``fact_embedding``; with both ends."""
    if "vector" in queries.columns and "fact_embedding" in edges.columns:
        found = hybrid_search(index, edges, "fact_embedding", queries, limit, k)
    else:
        found = fuse_ranked(fulltext_search(index, queries, limit).withColumn("list_no", F.lit(0)), limit, k)
    group = queries.select("query_id", "group_id")
    ends = edges.select("group_id", "uuid", "source_uuid", "target_uuid", "fact")
    return found.drop("group_id").join(group, "query_id").join(ends, ["group_id", "uuid"])


def edge_candidates(index: TextIndex, edges: DataFrame, queries: DataFrame, limit: int, k: int = 60, stages: Stages | None = None) -> DataFrame:
    """Candidates for equal facts: only edges between the query's source_uuid and target_uuid. ``index`` is that of ``edges``.

    Edges and queries meet once, with texts and vectors, and only ids go on:
    a pair's similarity and common tokens are known where it is made. Then the
    tokens meet their frequencies, and all of a query's rows meet in one task, where they are ranked and fused without another shuffle.
    """
    stages = stages or Stages(edges.sparkSession, "edge-candidates")
    by = ["group_id", "source_uuid", "target_uuid"]
    ends = {c: packed(F.col(c)) for c in by[1:]}
    if index.text is None:
        held = index.postings.groupBy("group_id", "uuid").agg(F.collect_list(F.struct("token", "tf")).alias("_terms"), F.max("len").alias("len"))
        said, have = [F.col("_terms"), F.col("len")], edges.join(held, ["group_id", "uuid"], "left")
    else:
        said, have = [F.lower(index.text).alias("_said")], edges
    have = have.withColumns(ends).select(*by, packed(F.col("uuid")).alias("_uuid"), F.col("fact_embedding").alias("_v"), *said)
    asked = queries.withColumns(ends).select(*by, packed(F.col("query_id").cast("string")).alias("_query"), F.lower("text").alias("_text"), F.col("vector").alias("_q"))
    pairs = have.join(asked, by).withColumn("_tokens", tokens(F.col("_text")))
    if index.text is None:
        common = F.filter("_terms", lambda t: F.array_contains("_tokens", t["token"]))
    else:
        pairs = pairs.withColumn("_words", tokens(F.col("_said"))).withColumn("len", F.size("_words").cast("long"))
        common = F.transform(F.array_intersect("_tokens", "_words"), lambda t: F.struct(t.alias("token"), F.size(F.filter("_words", lambda w: w == t)).cast("long").alias("tf")))
    near = F.round(cosine(F.col("_v"), F.col("_q")), 6)  # null where there is no vector, or one of another size
    pairs = stages.keep("pairs", pairs.select(F.monotonically_increasing_id().alias("_pair"), "_query", "group_id", "_uuid", near.alias("similarity"), common.alias("_terms"), "len"))

    task = F.xxhash64("_query").alias("_task")
    terms = pairs.select(task, "_pair", "group_id", "len", F.explode("_terms").alias("_term")).select("_task", "_pair", "group_id", "len", "_term.token", "_term.tf")
    found, weight = weights(with_frequencies(terms, index.frequencies, ["token", *[c for c in ("group_id",) if c in index.frequencies.columns]]), index)
    rows = pairs.select(task, "_pair", "_query", "group_id", "_uuid", "similarity").unionByName(found.select("_task", "_pair", weight.alias("_weight")), allowMissingColumns=True)
    # All that follows is within a task's rows.
    one = [F.max(c).alias(c) for c in ("_query", "group_id", "_uuid", "similarity")]
    rows = rows.repartition("_task").groupBy("_task", "_pair").agg(*one, F.round(F.sum("_weight"), 6).alias("fulltext_score"))
    rows = rows.select("_task", unpacked(F.col("_query")).cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "group_id", unpacked(F.col("_uuid")).alias("uuid"), "similarity", "fulltext_score")
    lists = []
    for number, score in enumerate(("fulltext_score", "similarity")):
        order = Window.partitionBy("_task", "query_id").orderBy(F.col(score).desc_nulls_last(), "uuid")
        rows = rows.withColumn(f"_{number}", F.row_number().over(order))
        scores = [(F.col(c) if c == score else F.lit(None).cast("double")).alias(c) for c in ("fulltext_score", "similarity")]
        lists.append(F.when(F.col(score).isNotNull() & (F.col(f"_{number}") <= limit), F.struct(F.lit(number).alias("list_no"), F.col(f"_{number}").alias("rank"), *scores)))
    rows = rows.select("_task", "query_id", "group_id", "uuid", F.explode(F.array(*lists)).alias("_row")).filter("_row IS NOT NULL")
    return fuse_ranked(rows.select("_task", "query_id", "group_id", "uuid", "_row.*"), limit, k, ("_task",)).drop("_task")


def match_decisions(candidates: DataFrame, exact: Column, high: float, low: float) -> DataFrame:
    """One decision per query over its fused candidates: ``exact`` anywhere in the list, else the first candidate if near enough.

    Near enough: similarity of ``high``, or of ``low`` with a full-text hit. Returns query_id, match_uuid (null for new).
    """
    similarity, text = F.coalesce("similarity", F.lit(0.0)), F.coalesce("fulltext_score", F.lit(0.0))
    near = (F.col("rank") == 1) & ((similarity >= high) | ((similarity >= low) & (text > 0)))
    return candidates.groupBy("query_id").agg(
        F.coalesce(F.min_by("uuid", F.when(exact, F.col("rank"))), F.max(F.when(near, F.col("uuid")))).alias("match_uuid"),
    )
