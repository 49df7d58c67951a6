"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source fall into hash blocks (about the square root of its
rows, so that both the blocks of a source and the documents of a block stay
few). A source's quota is a number of whole passes over its blocks plus a
last pass over the first blocks of a hash permutation; the rest is filled
greedily, largest first, with documents of all blocks from the boundary on. The exact quotas of drawn blocks are then divided among the
output shards by a binary tree of multivariate hypergeometric draws; each
shard owns disjoint runs of every source's permuted blocks and shuffles its
own documents by a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

WORD = r"[^\x20\x09-\x0D]+"


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Exact quotas of blocks per source, for each of ``shards`` shards.

    The root holds the whole vector of quotas. A node of k shards gives its
    left child k // 2 shards and that share of its blocks, drawn without
    replacement from all of them (multivariate hypergeometric), and the rest
    to its right child. Sums over the shards are the quotas.
    """
    rng = np.random.default_rng(seed)

    def node(q: np.ndarray, k: int) -> list[list[int]]:
        if k == 1:
            return [q.tolist()]
        left = rng.multivariate_hypergeometric(q, int(q.sum()) * (k // 2) // k, method="marginals") if q.sum() else q
        return node(left, k // 2) + node(q - left, k - k // 2)

    return node(np.asarray(quotas, dtype=np.int64), shards)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row per source with its number (by code point, null last), target words and the cap applied.

    ``sizes`` has source, source_size, n_rows. Sources in the order of
    size / weight are capped while ``cap`` times the size is not above the
    share that is left for them; what is left is shared by weight. One task
    sorts them; it gets a row per source, not per document.
    """
    by_name, all_rows = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("source_no") % len(weights)) + 1).cast("int"))
    out = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("source_size") * cap
    left = lambda c: F.sum(c).over(all_rows) - F.coalesce(F.sum(c * (cap if c is size else 1)).over(before), F.lit(0))
    size, w = F.col("source_size"), F.col("weight")
    out = out.withColumn("left_words", left(size)).withColumn("left_weight", left(w))
    out = out.withColumn("capped", room * F.col("left_weight") <= w * F.col("left_words"))
    rest = F.sum(size).over(all_rows) - F.coalesce(F.sum(F.when(F.col("capped"), room)).over(all_rows), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("capped"), w)).over(all_rows)
    target = F.when(F.col("capped"), room.cast("double")).otherwise((w * rest).cast("double") / rest_weight.cast("double"))
    return out.withColumn("target", target).drop("left_words", "left_weight")


def _text_key(id_col: str, text_col: str) -> Column:
    """What tells rows without an id apart: the digest of the text; null for rows with an id."""
    return F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, shards: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document, and into which shards.

    Returns one row per input row: doc_id, size (words), source, source_size,
    target, taken (words, repeats counted), copies, shards (one shard number
    for each copy), shuffle_key, alt (the text's digest where the id is null).
    A shard is read in the order of ``shuffle_key``.

    * A null text has size 0; size-0 documents are copied like their blocks, but do not fill the rest of a quota.
    * A null source is a source of its own, last in the order.
    * Rows that share source and id are taken together or not at all; so are those of null ids and equal text.
    * A source without words has target 0. An empty table gives an empty result.
    * Other columns, whatever their names, are not read. The same table and seed give the same mix.

    The driver gets one row per source (its number and quota of blocks), never documents.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(id_col, text_col).alias("alt"), F.col(source_col).alias("source"), size.alias("size"))
    rows = written(rows, "mix-sizes")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = source_targets(sizes, weights, cap)
    targets = targets.withColumn("n_blocks", F.ceil(F.sqrt("n_rows"))).withColumn("passes", F.least(passes, F.lit(cap)))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")

    block = F.pmod(F.xxhash64("doc_id", "alt", F.lit(seed)), F.col("n_blocks"))
    blocked = rows.join(small(targets), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    blocked = blocked.withColumn("block", block)
    ahead = Window.partitionBy("source_no").orderBy("block")
    blocks = blocked.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("ends", F.sum("words").over(ahead))
    blocks = written(blocks.select("source_no", "block", "words", "rest", "ends"), "mix-blocks")
    edge = blocks.filter("ends > rest").groupBy("source_no").agg(F.min(F.struct("block", "words", "rest", "ends")).alias("e"))
    edge = edge.select("source_no", F.col("e.block").alias("edge_block"), (F.col("e.rest") - F.col("e.ends") + F.col("e.words")).alias("room"))

    # The rest of the quota: largest documents first, from the boundary on, each that still fits. Only how many of each
    # size are taken is decided per source; which ones, block by block, is an ordinary distributed rank.
    units = blocked.join(small(edge), "source_no").filter("block >= edge_block")
    units = units.groupBy("source_no", "block", "room", "doc_id", "alt").agg(F.sum("size").alias("words")).filter("words > 0 AND words <= room")
    units = written(units, "mix-units")
    counts = written(units.groupBy("source_no", "block", "room", "words").agg(F.count("*").alias("n")), "mix-counts")
    of_size = counts.groupBy("source_no", "room", "words").agg(F.sum("n").alias("n"))
    of_size = of_size.groupBy("source_no", "room").agg(F.sort_array(F.collect_list(F.struct("words", "n")), asc=False).alias("u"))
    fold = F.expr(
        "aggregate(u, struct(room AS room, transform(slice(u, 1, 0), x -> struct(x.words AS words, x.n AS take)) AS got), (a, x) -> "
        "IF(x.words <= a.room, struct(a.room - x.words * least(x.n, floor(a.room / x.words)) AS room, "
        "concat(a.got, array(struct(x.words AS words, least(x.n, floor(a.room / x.words)) AS take))) AS got), a), a -> a.got)"
    )
    wanted = written(of_size.select("source_no", F.explode(fold).alias("x")).select("source_no", "x.words", "x.take"), "mix-wanted")
    in_turn = Window.partitionBy("source_no", "words").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    due = counts.join(small(wanted), ["source_no", "words"]).withColumn("due", F.col("take") - F.coalesce(F.sum("n").over(in_turn), F.lit(0)))
    due = written(due.filter("due > 0").select("source_no", "words", "block", "due"), "mix-due")
    in_block = Window.partitionBy("source_no", "words", "block").orderBy(F.xxhash64("doc_id", "alt", F.lit(seed + 1)), "doc_id", "alt")
    chosen = units.join(small(due), ["source_no", "words", "block"]).withColumn("nth", F.row_number().over(in_block)).filter("nth <= due")
    chosen = written(chosen.select("source_no", "doc_id", "alt"), "mix-boundary")

    plan = targets.join(edge, "source_no", "left").select("*", (F.col("passes") * F.col("n_blocks") + F.coalesce(F.col("edge_block") + 1, F.when(F.col("rest") > 0, F.col("n_blocks")), F.lit(0))).alias("quota"))
    quotas = [(r["source_no"], r["quota"]) for r in plan.select("source_no", "quota").orderBy("source_no").collect()]
    ends = np.cumsum(np.asarray(split_quotas([q for _, q in quotas], shards, seed)).reshape(shards, -1), axis=0)
    if quotas:
        lines = ", ".join(f"({no}, array({', '.join(f'{e}L' for e in ends[:, k])}))" for k, (no, _) in enumerate(quotas))
        tree = spark.sql(f"SELECT * FROM VALUES {lines} AS t(source_no, shard_ends)")
    else:
        tree = spark.sql("SELECT 0 AS source_no, array(0L) AS shard_ends WHERE false")

    extra = chosen.withColumn("chosen", F.lit(True))
    out = blocked.join(small(edge.select("source_no", "edge_block")), "source_no", "left").join(small(tree), "source_no")
    out = out.join(small(extra), (out["source_no"] == extra["source_no"]) & out["doc_id"].eqNullSafe(extra["doc_id"]) & out["alt"].eqNullSafe(extra["alt"]) & (out["block"] >= out["edge_block"]), "left").drop(extra["source_no"]).drop(extra["doc_id"]).drop(extra["alt"])
    last = F.when(F.col("edge_block").isNull(), F.col("rest") > 0).otherwise((F.col("block") < F.col("edge_block")) | F.coalesce("chosen", F.lit(False)))
    out = out.withColumn("copies", (F.col("passes") + last.cast("int")).cast("int"))
    shard = F.expr(
        "transform(IF(copies > 0, sequence(0, copies - 1), array()), i -> size(filter(shard_ends, e -> e <= "
        "i * n_blocks + IF(i < passes, pmod(block + pmod(xxhash64(source_no, i), n_blocks), n_blocks), least(block, edge_block)))))"
    )
    return out.select(
        "doc_id", "size", "source", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", shard.alias("shards"),
        F.xxhash64("doc_id", "alt", "source", F.lit(seed + 2)).alias("shuffle_key"), "alt",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: dropped, kept or repeated, each shard in its own shuffled order.

    All columns, whatever their names, come back as they were. Rows of null
    ids, null sources and repeated rows are taken as ``mix_sources`` says; an
    empty table gives an empty table.
    """
    mix = mix_sources(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("alt").alias("_alt"), F.col("source").alias("_source"), F.col("shards").alias("_shards"), F.col("shuffle_key").alias("_order"))
    mix = mix.dropDuplicates(["_id", "_alt", "_source"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own_id"), _text_key("doc_id", "text").alias("_own_alt"), F.col("source").alias("_own_source"))
    out = rows.join(mix, F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_alt").eqNullSafe(F.col("_alt")) & F.col("_own_source").eqNullSafe(F.col("_source")))
    out = out.select("_row", F.posexplode("_shards").alias("_copy", "_shard"), "_order")
    out = out.repartition(F.col("_shard"), F.pmod("_order", F.lit(8))).sortWithinPartitions("_shard", F.xxhash64("_order", "_copy"))
    return out.select("_row.*")
