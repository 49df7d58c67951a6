"""A written inverted index: postings in blocks with bounds, so that a search reads its tokens' files and skips blocks.

A token's postings in a group are dealt into levels by their share of a score,
and each level into blocks of some 128 postings; a block is a row with its
best share. A search takes a first threshold from the best blocks, and then
reads only blocks whose bound, with the best that the query's other tokens can
add, reaches it. That loses nothing: a document at or above the threshold has
all its blocks at or above it.

Documents are added as segments beside what is there; ``merge`` deals all anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

from .search import K1, B, counted_postings, tokenized, top_per_query
from .snapshots import Snapshots

#: Postings of a block, levels of shares, and what rounding may take from a score.
BLOCK, LEVELS, MARGIN = 128, 16, 1e-5


def share(tf: Column, length: Column, mean: Column) -> Column:
    """What a posting's score is of its token's weight: below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class WrittenIndex:
    """The index in the folder ``path``; ``buckets`` counts only where it is made."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.store, self.buckets = Snapshots(spark, path), buckets

    # --- writing

    def _tables(self, docs: DataFrame, text: Column) -> dict[str, DataFrame]:
        words = tokenized(docs, text)
        return {"postings": blocks(counted_postings(words)), "lengths": words.select("group_id", "uuid", "len")}

    def create(self, docs: DataFrame, text: Column) -> WrittenIndex:
        """An index of ``docs`` (group_id, uuid) in place of what is there."""
        made = self._tables(docs, text)
        self.store.create("lengths", made["lengths"], ["group_id", "uuid"], self.buckets)
        self.store.create("postings", made["postings"], ["token"], self.buckets)
        return self

    def append(self, docs: DataFrame, text: Column) -> WrittenIndex:
        """A segment of new documents; an error if one is there already."""
        there = self.store.read("lengths", self.store.buckets_of("lengths", docs)).select("group_id", "uuid")
        twice = docs.select("group_id", "uuid").join(there, ["group_id", "uuid"], "left_semi").limit(1).collect()
        if twice:
            raise ValueError(f"document {twice[0]['uuid']} is in the index already")
        self.store.append(self._tables(docs, text))
        return self

    def merge(self) -> WrittenIndex:
        """All segments as one: full blocks, and bounds by the mean length of today."""
        rows = self.store.read("postings").select("token", "group_id", F.inline("members"))
        self.store.create("postings", blocks(rows), ["token"], self.buckets)
        self.store.create("lengths", self.store.read("lengths"), ["group_id", "uuid"], self.buckets)
        return self

    # --- searching

    def plan(self, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """The blocks that the queries' tokens have in their groups (with bound and least), and those of them that a search reads."""
        wanted = queries.select("query_id", "group_id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("token"))
        found = self.store.read("postings", self.store.buckets_of("postings", wanted))
        totals = self.store.read("lengths").agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
        asked = wanted.select("token").distinct()
        weights = found.select("token", "n").join(asked, "token").groupBy("token").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(totals))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = weights.select("token", idf.alias("idf"), "mean_len")
        bound = F.col("idf") * F.col("best") * F.greatest(F.lit(1.0), F.col("mean_len") / F.col("mean"))
        own = found.join(wanted, ["group_id", "token"]).join(weights, "token").withColumn("bound", bound)

        # The best levels that hold enough postings, and of each level a few blocks.
        levels = own.groupBy("query_id", "token", "level").agg(F.max("bound").alias("top"), F.sum("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("top"), "token", "level").rowsBetween(Window.unboundedPreceding, -1)
        lead = levels.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("_before") < 2 * limit)
        few = -(-2 * limit // BLOCK) + 1
        first = own.filter(F.col("block") < few).join(lead.select("query_id", "token", "level"), ["query_id", "token", "level"])
        reached = scores(first)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = reached.withColumn("_place", place).filter(F.col("_place") == limit).select("query_id", F.col("score").alias("least"))

        best = levels.groupBy("query_id", "token").agg(F.max("top").alias("best_of_token"))
        others = best.withColumn("others", F.sum("best_of_token").over(Window.partitionBy("query_id")) - F.col("best_of_token"))
        own = own.join(others.select("query_id", "token", "others"), ["query_id", "token"]).join(least, "query_id", "left")
        read = own.filter(F.col("bound") + F.col("others") >= F.coalesce("least", F.lit(0.0)) - MARGIN)
        return own, read

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """The ``limit`` best documents of each query's group by BM25: query_id, group_id, uuid, fulltext_score, rank. Exact."""
        _, read = self.plan(queries, limit)
        found = scores(read).withColumn("fulltext_score", F.round("score", 6)).drop("score")
        return top_per_query(found, "fulltext_score", limit)


def blocks(postings: DataFrame) -> DataFrame:
    """Postings (token, group_id, uuid, tf, len) as blocks: token, group_id, level, block, n, best, mean, members.

    The number of blocks of a level is by its count, and a posting's block by
    its document's hash, so that a token that a third of all documents hold is
    dealt like many small ones.
    """
    mean = postings.select("group_id", "uuid", "len").distinct().agg(F.avg("len").alias("mean"))
    rows = postings.crossJoin(F.broadcast(mean)).withColumn("share", share(F.col("tf"), F.col("len"), F.col("mean")))
    rows = rows.withColumn("level", F.least(F.floor(F.col("share") * (LEVELS / (K1 + 1))), F.lit(LEVELS - 1)).cast("int"))
    key = ["token", "group_id", "level"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    rows = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("uuid"), F.col("_blocks")).cast("int"))
    return rows.groupBy(*key, "block").agg(
        F.count("*").alias("n"), F.max("share").alias("best"), F.first("mean").alias("mean"), F.collect_list(F.struct("uuid", "tf", "len")).alias("members")
    )


def scores(found: DataFrame) -> DataFrame:
    """The summed scores of the documents in ``found`` blocks: query_id, group_id, uuid, score."""
    flat = found.select("query_id", "group_id", "idf", "mean_len", F.inline("members"))
    return flat.groupBy("query_id", "group_id", "uuid").agg(F.sum(F.col("idf") * share(F.col("tf"), F.col("len"), F.col("mean_len"))).alias("score"))
