"""Steps that need a model, behind interfaces with deterministic offline defaults.

A provider works on DataFrames, so that a default can be plain columns and a
remote model a ``mapInPandas`` over batches. ``remote_map`` adapts a function
that calls a service: batches of fixed size, tries with back-off, and an error
if the count of answers is not that of the questions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, tokens

#: HTTP states after which a call is tried again, besides those of 500 and more.
RETRIED_STATES = {408, 409, 429}


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Extractor(Protocol):
    """Finds names and facts. One that can reflect also has ``reflect_names`` and ``reflect_edges`` (see ``operators.reflection``)."""

    def names(self, episodes: DataFrame) -> DataFrame: ...

    def edges(self, episodes: DataFrame, mentions: DataFrame) -> DataFrame:
        """Facts between mentions of one turn and batch: pairs do not span batches (``batch_id``)."""
        ...


class EntityDetailer(Protocol):
    def entity_details(self, mentions: DataFrame) -> DataFrame:
        """Summaries and tags of mentions in batches (``batch_id``): group_id, key, summary, tag."""
        ...


class Categorizer(Protocol):
    def assign(self, nodes: DataFrame, layer: int) -> DataFrame: ...


class BatchCategorizer(Protocol):
    """Assigns one batch of a group's nodes at a time, and is told the categories that earlier batches made."""

    def assign_batch(self, nodes: list[dict], existing: list[str], layer: int) -> list[tuple[str, list[int]]]:
        """nodes: index, name, tag of a batch. existing: names so far, sorted. Gives categories with the indexes of their nodes."""
        ...


class Detailer(Protocol):
    def details(self, categories: DataFrame, layer: int) -> DataFrame: ...


class LayerSelector(Protocol):
    def select(self, candidates: DataFrame, queries: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    def scores(self, items: DataFrame, queries: DataFrame) -> DataFrame: ...


class Answerer(Protocol):
    def answer(self, context: Column, query: Column) -> Column: ...


class Judge(Protocol):
    def judge(self, reference: Column, predicted: Column) -> Column: ...


class LetterEmbedder:
    """A vector of letter counts, a to z: names of nearly the same spelling have a similarity near 1."""

    dimensions = 26

    def embed(self, text: Column) -> Column:
        low = F.lower(text)
        return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(chr(97 + k))))).cast("float") for k in range(self.dimensions)])


class HashEmbedder:
    """A vector of token hashes: component k counts the tokens whose hash is k."""

    def __init__(self, dimensions: int = 128):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        hashed = F.transform(tokens(F.lower(text)), lambda t: F.xxhash64(t))
        place = F.transform(hashed, lambda h: F.pmod(h, F.lit(self.dimensions)))
        return F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda k: F.size(F.filter(place, lambda p: p == k)).cast("float"))


class RemoteEmbedder:
    """An embedding service or model: ``load`` gives, once per worker, a function from texts to vectors.

    Texts go in batches of ``batch``, with tries; an answer of another length, or a vector of another size, is an error.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimensions: int, batch: int = 32, tries: int = 3):
        self.load, self.dimensions, self.batch, self.tries = load, dimensions, batch, tries

    def embed(self, text: Column) -> Column:
        load, dimensions, batch, tries = self.load, self.dimensions, self.batch, self.tries

        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ask = load()
            for values in series:
                texts, found = values.dropna(), []
                for k in range(0, len(texts), batch):
                    part = texts.iloc[k : k + batch].tolist()
                    got = with_tries(lambda: ask(part), tries)
                    if len(got) != len(part) or any(len(v) != dimensions for v in got):
                        raise ValueError(f"not {len(part)} vectors of {dimensions} components for {len(part)} texts")
                    found += got
                yield pd.Series(found, index=texts.index, dtype="object").reindex(values.index).replace({float("nan"): None})

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<float>")(text)


class TokenExtractor:
    """Names are long tokens; a fact joins two names that follow each other in a turn."""

    def __init__(self, least: int = 6):
        self.least = least

    def names(self, episodes: DataFrame) -> DataFrame:
        words = episodes.select("group_id", F.col("uuid").alias("episode_uuid"), F.posexplode(tokens("content")).alias("pos", "name"))
        return words.filter(F.length("name") >= self.least)

    def edges(self, episodes: DataFrame, mentions: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
        batch = F.col("batch_id") if "batch_id" in mentions.columns else F.lit(0)
        chains = mentions.filter("pos >= 0").groupBy("group_id", "episode_uuid", batch.alias("_batch")).agg(ordered.alias("m")).filter(F.size("m") >= 2)
        pairs = chains.select("group_id", "episode_uuid", F.explode(F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1].pos AS pos, m[i - 1].name AS source, m[i].name AS target))")).alias("p"))
        return pairs.select("group_id", "episode_uuid", F.lit(0).alias("round"), "p.pos", "p.source", "p.target", F.concat_ws(" with ", "p.source", "p.target").alias("fact"))


class TagCategorizer:
    """Nodes with the same first tag share a category named after it."""

    def assign(self, nodes: DataFrame, layer: int) -> DataFrame:
        first = F.coalesce(F.get("tag", F.lit(0)), F.lit("untagged"))
        rows = nodes.groupBy("group_id", F.concat(F.lit(f"Layer {layer} "), first).alias("category")).agg(F.array_sort(F.collect_list("index")).alias("indexes"))
        return rows.withColumn("row_no", F.xxhash64("category"))


class ReusingCategorizer:
    """A batch categoriser by first tags that takes a category there is, whatever its case, before it makes one."""

    def assign_batch(self, nodes: list[dict], existing: list[str], layer: int) -> list[tuple[str, list[int]]]:
        names = {name.lower(): name for name in existing}
        found: dict[str, list[int]] = {}
        for node in nodes:
            tag = (list(node["tag"]) or ["untagged"])[0]
            found.setdefault(names.setdefault(f"layer {layer} {tag}".lower(), f"Layer {layer} {tag}"), []).append(node["index"])
        return list(found.items())


def assigned_in_order(nodes: DataFrame, layer: int, categorizer: BatchCategorizer) -> DataFrame:
    """The assignments (group_id, row_no, category, indexes) of nodes in batches (``batch_id``), each batch seeing the names of those before it.

    A fold over each group's batches as a stream over sorted rows: a task holds
    one batch, and the names of its group so far.
    """
    sorted_rows = nodes.select("group_id", "batch_id", F.col("index").alias("place"), "name", "tag").repartition("group_id").sortWithinPartitions("group_id", "batch_id", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, names = None, [], set()

        def answered() -> pd.DataFrame:
            rows = [(at[0], (int(at[1]) << 32) + k, category, [int(i) for i in indexes]) for k, (category, indexes) in enumerate(categorizer.assign_batch(batch, sorted(names), layer))]
            names.update(category for _, _, category, _ in rows)
            return pd.DataFrame(rows, columns=["group_id", "row_no", "category", "indexes"])

        for frame in frames:
            for r in frame.itertuples():
                if at is not None and (r.group_id, r.batch_id) != at:
                    yield answered()
                    batch, names = [], names if r.group_id == at[0] else set()
                at = (r.group_id, r.batch_id)
                batch.append({"index": r.place, "name": r.name, "tag": [] if r.tag is None else list(r.tag)})
        if batch:
            yield answered()

    return sorted_rows.mapInPandas(run, "group_id string, row_no long, category string, indexes array<int>")


class LexicalSelector:
    """Selects candidates whose name shares a token with the query; an exact name takes all children."""

    def select(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.array_distinct(tokens(F.lower("text"))).alias("_asked"), normalize_text(F.col("text")).alias("_text"))
        rows = candidates.join(asked, "query_id").filter(F.arrays_overlap(tokens(F.lower("name")), F.col("_asked")))
        return rows.withColumn("get_all_children", normalize_text(F.col("name")) == F.col("_text")).drop("_asked", "_text")


class LexicalReranker:
    """Scores 0 to 100 by the share of the query's tokens that a candidate's text holds."""

    def scores(self, items: DataFrame, queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.array_distinct(tokens(F.lower("text"))).alias("_asked"))
        shared = F.size(F.array_intersect(F.array_distinct(tokens(F.lower("candidate_text"))), F.col("_asked")))
        return items.join(asked, "query_id").select("query_id", "uuid", (F.lit(100.0) * shared / F.greatest(F.size("_asked"), F.lit(1))).alias("rerank_score"))


def indexed_scores(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores that a service gave by place, as query_id, uuid, rerank_score.

    items: query_id, uuid, index. answers: query_id, index, score. Places that
    the items do not have and null scores are ignored; of repeated places the
    highest score counts. A query whose items got no score at all is an error,
    raised when the rows are computed.
    """
    best = answers.filter("score IS NOT NULL").groupBy("query_id", "index").agg(F.max("score").alias("rerank_score"))
    rows = items.select("query_id", "uuid", "index").join(best, ["query_id", "index"], "left")
    scored = rows.groupBy("query_id").agg(F.count("rerank_score").alias("_scored"))
    rows = rows.join(scored, "query_id")
    message = F.concat(F.lit("no usable rerank scores for query "), F.col("query_id").cast("string"))
    checked = F.when(F.col("_scored") == 0, F.raise_error(message)).otherwise(F.col("rerank_score")).cast("double")
    return rows.select("query_id", "uuid", checked.alias("rerank_score")).filter("rerank_score IS NOT NULL")


class RoutedReranker:
    """A primary reranker and its fallback. Modes: auto, true_reranker, llm_scoring.

    In auto mode the first failure of the primary switches to the fallback for good; ``reason`` says why.
    Plans are lazy, so in that mode the primary's scores are computed at once, kept, and only then returned.
    """

    def __init__(self, primary: Reranker, fallback: Reranker, mode: str = "auto"):
        if mode not in ("auto", "true_reranker", "llm_scoring"):
            raise ValueError(f"unknown rerank mode {mode!r}")
        self.primary, self.fallback, self.mode, self.reason = primary, fallback, mode, None

    def scores(self, items: DataFrame, queries: DataFrame) -> DataFrame:
        if self.mode == "llm_scoring" or self.reason:
            return self.fallback.scores(items, queries)
        if self.mode == "true_reranker":
            return self.primary.scores(items, queries)
        try:
            scores = self.primary.scores(items, queries).persist()
            scores.count()
            return scores
        except Exception as error:
            self.reason = f"{type(error).__name__}: {error}"
            return self.fallback.scores(items, queries)


class EchoAnswerer:
    """The first line of the context that is not a section mark."""

    def answer(self, context: Column, query: Column) -> Column:
        lines = F.filter(F.split(context, "\n"), lambda x: ~F.startswith(x, F.lit("<")))
        return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


class ContainmentJudge:
    """Correct if the prediction holds every token of the reference."""

    def judge(self, reference: Column, predicted: Column) -> Column:
        return F.size(F.array_except(tokens(F.lower(reference)), tokens(F.lower(predicted)))) == 0


def by_query(rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], ask: Callable[[str, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``ask(text, rows)`` once for each query over its rows in order, as a stream over sorted rows: query_id and the columns of ``schema``.

    rows: query_id, text, columns. A task holds one query's rows.
    """
    dealt = rows.select("query_id", "text", *columns).repartition("query_id").sortWithinPartitions("query_id", *order)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, text, held = None, None, []

        def answered() -> pd.DataFrame:
            return pd.DataFrame([(query, *row) for row in ask(text, held)], columns=["query_id", *names])

        for frame in frames:
            for row in frame.to_dict("records"):
                if held and row["query_id"] != query:
                    yield answered()
                    held = []
                query, text = row["query_id"], row["text"]
                held.append({c: row[c] for c in columns})
        if held:
            yield answered()

    return dealt.mapInPandas(run, f"query_id string, {schema}")


class ServiceReranker:
    """A reranking service: ``ask(query, texts)`` gives (index, score) pairs, with tries. See ``indexed_scores`` for what counts."""

    def __init__(self, ask: Callable[[str, list[str]], list[tuple[int, float]]], tries: int = 3):
        self.ask, self.tries = ask, tries

    def scores(self, items: DataFrame, queries: DataFrame) -> DataFrame:
        ask, tries = self.ask, self.tries
        rows = items.join(queries.select("query_id", "text"), "query_id").select("query_id", "text", "uuid", "candidate_text")
        call = lambda text, held: with_tries(lambda: ask(text, [h["candidate_text"] for h in held]), tries)
        answers = by_query(rows, ("uuid", "candidate_text"), ("uuid",), call, "index int, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("uuid")) - 1
        return indexed_scores(items.select("query_id", "uuid", place.alias("index")), answers)


class ServiceSelector:
    """A model that selects nodes: ``ask(query, nodes)`` gives (uuid or None, name, get_all_children), with tries.

    Selections become nodes by uuid, else by name. Those that match none are
    left out; where all of a query's match none that is an error if ``strict``.
    """

    def __init__(self, ask: Callable[[str, list[dict]], list[tuple]], strict: bool = True, tries: int = 3):
        self.ask, self.strict, self.tries = ask, strict, tries

    def select(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        from tessera.operators.graph import matched_selections, resolve_selections

        ask, tries = self.ask, self.tries
        rows = candidates.join(queries.select("query_id", "text"), "query_id")
        call = lambda text, held: with_tries(lambda: ask(text, held), tries)
        told = by_query(rows, ("uuid", "name", "tag"), ("name", "uuid"), call, "uuid string, name string, get_all_children boolean")
        # Candidates are a query's own, so they are resolved with the query in place of the group.
        nodes = candidates.select(F.col("query_id").alias("group_id"), "uuid", "name", F.struct("name", "uuid").alias("seq"))
        found = resolve_selections(told.withColumn("group_id", F.col("query_id")), nodes)
        found = matched_selections(found) if self.strict else found.filter("node_uuid IS NOT NULL")
        chosen = found.groupBy("query_id", F.col("node_uuid").alias("uuid")).agg(F.max("get_all_children").alias("get_all_children"))
        return candidates.join(chosen, ["query_id", "uuid"]).select(*candidates.columns, "get_all_children")


def is_retried(error: Exception) -> bool:
    state = getattr(error, "status_code", None)
    return isinstance(error, (TimeoutError, ConnectionError)) or (state is not None and (state in RETRIED_STATES or state >= 500))


def with_tries(call: Callable, tries: int = 3, wait: float = 0.5, retried: Callable[[Exception], bool] = is_retried):
    """``call`` again after an error that may pass, waiting longer each time."""
    for k in range(1, tries + 1):
        try:
            return call()
        except Exception as error:
            if k == tries or not retried(error):
                raise
            time.sleep(wait * k)


def remote_map(rows: DataFrame, question: str, answer: str, kind: str, ask: Callable[[list], list], batch: int = 32, tries: int = 3) -> DataFrame:
    """Adds ``answer`` of SQL type ``kind``: ``ask`` over batches of the values of ``question``."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, `{answer}` {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, found = frame[question].tolist(), []
            for k in range(0, len(values), batch):
                part = values[k : k + batch]
                got = with_tries(lambda: ask(part), tries)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} answers to {len(part)} questions")
                found += got
            yield frame.assign(**{answer: found})

    return rows.mapInPandas(run, schema)


def ask_json(ask: Callable[[str], str], prompt: str, check: Callable, tries: int = 3):
    """An answer that ``check`` accepts (it returns a value or raises ValueError); each failure is told to the next try."""
    from tessera.functions.payload import salvage

    told, error = prompt, None
    for _ in range(tries):
        value = salvage(ask(told))
        try:
            if value is None:
                raise ValueError("no JSON in the answer")
            return check(value)
        except ValueError as e:
            error = e
            told = f"{prompt}\n\nThe last answer was not accepted: {e}"
    raise ValueError(f"no accepted answer in {tries} tries: {error}")
