"""The driver's tables as a memory graph, in Spark and in DuckDB SQL.

Episodes are conversation turns in ten groups; entities are tokens of six or
more characters that two or more episodes of a group hold; a fact joins two
entities that follow each other in an episode. Regions, nations and customers
are a ready-made hierarchy of layers 2, 1 and 0, with orders as episodes and
customer-supplier pairs as facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stable_id, tokens
from tessera.stages import Stages


#: The key of a turn, and turns that a task takes.
TURN, TURNS = ("conv_id", "turn"), 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(registry: dict, sql: str | None = None, prelude: str = "") -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Callable) -> Callable:
        registry[f.__name__] = (f, prelude + sql if sql else None)
        return f

    return keep


def with_ids(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the ids and times of their episode."""
    c = turns.withColumn("group_id", F.concat(F.lit("g"), (F.col("conv_id") % 10).cast("string")))
    c = c.withColumn("source_id", F.concat_ws(":", "group_id", "conv_id", "turn"))
    valid_at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("conv_id").cast("int"))
    return c.withColumns({"uuid": stable_id("episode", F.col("group_id"), F.col("source_id")), "valid_at": valid_at, "seq": F.col("conv_id") * 1000 + F.col("turn")})


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "conversations")).select(
        "group_id", "uuid", "source_id", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("content"), "valid_at",
        "seq", (F.col("conv_id") % 3 != 0).alias("ingestion_complete"), "conv_id", "turn",
    )


def first_places(turns: DataFrame) -> DataFrame:
    """conv_id, turn, name, pos: first place of each long token in a turn."""
    words = turns.select(*TURN, F.posexplode(tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("pos", "name"))
    return words.filter(F.length("name") >= 6).groupBy(*TURN, "name").agg(F.min("pos").alias("pos"))


def dealt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` dealt by turn into tasks of about ``TURNS`` rows, however many there are, so that no task grows with the table."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(*TURN, "text").repartition(max(spark.sparkContext.defaultParallelism, -(-turns.count() // TURNS)), *TURN)


def episode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, episode_uuid, seq, name, pos: first place of each long token in an episode."""
    # A turn's numbers stand for it until its tokens are counted; its ids are made of them afterwards.
    return with_ids(first_places(table(spark, sf_dir, "conversations"))).select("group_id", F.col("uuid").alias("episode_uuid"), "seq", "valid_at", "name", "pos")


def entity_id() -> Column:
    return stable_id("entity", F.col("group_id"), F.col("name"))


class GraphTables(dict):
    """The graph's tables by name. Each is planned when it is asked for; those that others are made of are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.stages = spark, sf_dir, Stages(spark, "graph")

    def __missing__(self, name: str) -> DataFrame:
        made = getattr(self, f"_{name}")()
        self[name] = made if name in ("episodes", "mentions") else self.stages.keep(name, made)
        return self[name]

    def _episodes(self) -> DataFrame:
        return episodes(self.spark, self.sf_dir)

    def _words(self) -> DataFrame:
        return episode_tokens(self.spark, self.sf_dir)

    def _entities(self) -> DataFrame:
        found = self["words"].groupBy("group_id", "name").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).filter("n >= 2")
        return found.select("group_id", entity_id().alias("uuid"), "name", F.concat("name", F.lit(" seen in "), F.col("n").cast("string")).alias("summary"), F.array(F.substring("name", 1, 1)).alias("tag"), (F.col("n") % 5 == 0).alias("is_speaker"), F.col("first_seq").alias("seq"))

    def _known(self) -> DataFrame:
        return self["words"].join(self["entities"].select("group_id", "name"), ["group_id", "name"])

    def _mentions(self) -> DataFrame:
        return self._known().select("group_id", entity_id().alias("entity_uuid"), "episode_uuid")

    def _edges(self) -> DataFrame:
        chains = self._known().groupBy("group_id", "episode_uuid", "valid_at").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("m"))
        pairs = chains.select("group_id", "valid_at", F.explode(F.expr("transform(sequence(1, greatest(size(m) - 1, 1)), i -> struct(get(m, i - 1).name AS a, get(m, i).name AS b))")).alias("p")).filter("p.b IS NOT NULL")
        pairs = pairs.groupBy("group_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max("valid_at").alias("valid_at"))
        ends = {"source_uuid": stable_id("entity", F.col("group_id"), F.col("a")), "target_uuid": stable_id("entity", F.col("group_id"), F.col("b")), "fact": F.concat("a", F.lit(" with "), "b")}
        return pairs.withColumns(ends).select("group_id", stable_id("fact", F.col("source_uuid"), F.col("target_uuid"), F.col("fact")).alias("uuid"), "source_uuid", "target_uuid", "fact", "valid_at", F.lit(None).cast("timestamp").alias("invalid_at"))


def graph_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """episodes, entities, mentions and edges of the conversations, as ``GraphTables``."""
    return GraphTables(spark, sf_dir)


def tree_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Region - nation - customer, with group_id ``tpch``."""
    g = F.lit("tpch").alias("group_id")
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    one = lambda c: F.array(c)
    categories = nation.select(g, F.concat(F.lit("n"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), one(F.substring("n_name", 1, 1)).alias("tag"), F.lit(1).alias("layer"))
    categories = categories.unionByName(region.select(g, F.concat(F.lit("r"), "r_regionkey").alias("uuid"), F.col("r_name").alias("name"), one(F.substring("r_name", 1, 1)).alias("tag"), F.lit(2).alias("layer")))
    entities = customer.select(g, F.concat(F.lit("c"), "c_custkey").alias("uuid"), F.col("c_name").alias("name"), one(F.col("c_mktsegment")).alias("tag"), F.col("c_mktsegment").alias("summary"), F.col("c_custkey").alias("seq"))
    links = nation.select(g, F.concat(F.lit("r"), "n_regionkey").alias("parent_uuid"), F.concat(F.lit("n"), "n_nationkey").alias("child_uuid"))
    links = links.unionByName(customer.select(g, F.concat(F.lit("n"), "c_nationkey").alias("parent_uuid"), F.concat(F.lit("c"), "c_custkey").alias("child_uuid")))
    orders = table(spark, sf_dir, "orders")
    mentions = orders.select(g, F.concat(F.lit("c"), "o_custkey").alias("entity_uuid"), F.concat(F.lit("o"), "o_orderkey").alias("episode_uuid"))
    turns = orders.select(g, F.concat(F.lit("o"), "o_orderkey").alias("uuid"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").cast("timestamp").alias("valid_at"), F.col("o_orderkey").cast("string").alias("source_id"))
    return {"categories": categories, "entities": entities, "categorizes": links, "mentions": mentions, "episodes": turns}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with vectors: one group, uuid ``v<vec_id>``."""
    return table(spark, sf_dir, "embeddings").select(F.lit("vec").alias("group_id"), F.concat(F.lit("v"), "vec_id").alias("uuid"), F.col("embedding").alias("summary_embedding"), "vec_id", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20, as queries."""
    v = vectors(spark, sf_dir).filter("vec_id % 20 = 0")
    return v.select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "group_id", F.col("summary_embedding").alias("vector"))


#: Text queries over the episodes of every group.
ASKED = ("the and of with", "que de la", "der und in")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = episodes(spark, sf_dir).select("group_id").distinct()
    return groups.select("group_id", F.posexplode(F.array(*map(F.lit, ASKED))).alias("n", "text")).select(F.concat_ws("-", "group_id", "n").alias("query_id"), "group_id", "text")


GRAPH = """
WITH ep AS (
  SELECT group_id, md5('episode|' || group_id || '|' || source_id) AS uuid, source_id, speaker, content, valid_at, seq, ingestion_complete, conv_id, turn
  FROM (SELECT 'g' || (conv_id % 10) AS group_id, 'g' || (conv_id % 10) || ':' || conv_id || ':' || turn AS source_id, role AS speaker, coalesce(text, '') AS content,
               TIMESTAMP '2024-01-01' + to_days(conv_id::INT) AS valid_at, conv_id * 1000 + turn AS seq, conv_id % 3 <> 0 AS ingestion_complete, conv_id, turn FROM conversations)
), tok AS (
  SELECT group_id, uuid AS episode_uuid, seq, valid_at, name, min(pos) AS pos
  FROM (SELECT group_id, uuid, seq, valid_at, unnest(t) AS name, generate_subscripts(t, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_-]+') AS t FROM ep))
  WHERE length(name) >= 6 GROUP BY ALL
), ent AS (
  SELECT group_id, md5('entity|' || group_id || '|' || name) AS uuid, name, name || ' seen in ' || count(*) AS summary, name[1] AS tag, count(*) % 5 = 0 AS is_speaker, min(seq) AS seq
  FROM tok GROUP BY group_id, name HAVING count(*) >= 2
), men AS (
  SELECT t.group_id, e.uuid AS entity_uuid, t.episode_uuid, t.pos, t.name, t.valid_at FROM tok t JOIN ent e USING (group_id, name)
), rel AS (
  SELECT group_id, md5('fact|' || source_uuid || '|' || target_uuid || '|' || fact) AS uuid, source_uuid, target_uuid, fact, max(valid_at) AS valid_at
  FROM (SELECT group_id, valid_at, entity_uuid AS source_uuid, lead(entity_uuid) OVER w AS target_uuid, name || ' with ' || lead(name) OVER w AS fact
        FROM men WINDOW w AS (PARTITION BY episode_uuid ORDER BY pos))
  WHERE target_uuid IS NOT NULL GROUP BY ALL
)
"""

TREE = """
WITH RECURSIVE node AS (
  SELECT 'c' || c_custkey AS uuid, c_name AS name, c_mktsegment AS tag, 0 AS layer FROM customer
  UNION ALL SELECT 'n' || n_nationkey, n_name, n_name[1], 1 FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, r_name[1], 2 FROM region
), link AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
)
"""

#: The vector of ``providers.LetterEmbedder`` of a text.
LETTERS = "list_transform(range(97, 123), lambda k: (length({0}) - length(replace({0}, chr(k::INT), '')))::DOUBLE)"

COSINE = "coalesce(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 0)"
