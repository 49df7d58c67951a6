"""Toxicity scores of text that a noisy channel may have disguised.

Tokens with signs of disguise (symbols or digits among letters, a letter three
times in a row, letters set apart by spaces) are decoded: a lattice offers for
each character itself, the letters it may stand for, nothing (a repetition or a
separator) or the end of a word (a separator), for two or more characters also
the letter that they draw or sound like, and Viterbi finds the likeliest words
under a character trigram model. Any other token is its own only reading.
The restored words and their beginnings, hashed to a fixed number of slots, are
the features of a logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_of, small, written

# The letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
SEPARATORS = set(".-_*~'`,/\\^:;=#&%\"<>[]{})?" + "+|!(")
# Characters that together are written for one letter.
DRAWN_AS = {"|-|": "h", "\\/\\/": "w", "|\\|": "n", "|_|": "u", "\\/": "v", "/\\": "a", "()": "o", "|<": "k", "|)": "d", "|3": "b", "vv": "w", "ph": "f"}
#: Log probabilities of the channel: a sign for a letter, several characters for one, a separator put in (in a word or between two), a letter repeated, a sign kept as it is.
SIGN, DRAWN, SEPARATOR, REPEAT, KEPT = (math.log(x) for x in (0.05, 0.005, 0.05, 0.1, 0.001))
#: A character that may stand for a letter is this one of the separators, or the second of a pair, not a repetition, more seldom.
SIGN_AS_SEPARATOR, SIGN_TWICE = SEPARATOR - math.log(len(SEPARATORS)), math.log(0.002)
#: Characters after which the decoder writes down what all surviving readings share (it bounds memory, never results).
SETTLE = 256
#: Beginnings of words that are features.
BEGINNINGS = (4, 5)
#: Slots that features are hashed to; a slot's least number of toxic training documents; examples that the regression is fitted to.
SLOTS, LEAST_DOCS, SAMPLE = 1 << 21, 3, 45_000
#: Labels (an id and a mark, some 32 MB) up to which they are broadcast to the texts; beyond, texts are joined by a shuffle.
SENT_LABELS = 1_000_000
REMEMBERED = 300_000
OTHER, EDGE, SIGN_KEPT = "?", "^", "#"

_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|])(?: (?:[^\W_]|[@$!|])){2,}(?!\S)")
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER, _DIGIT, _SYMBOL = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[^\w\s]")
_SIGN_BEFORE, _SIGN_AFTER, _TRIPLE = re.compile(r"[@$!|(+€£¡µ]|\\/|/\\"), re.compile(r"[^\W\d_][@$|(+€£]"), re.compile(r"([^\W\d_])\1\1|vv")
_DRAWN = re.compile("|".join(f"(?={re.escape(x)})" for x in DRAWN_AS))


class CharacterModel:
    """Trigrams of a-z, one class for all other letters, and the word's edges."""

    ALPHABET = "abcdefghijklmnopqrstuvwxyz" + OTHER + EDGE + SIGN_KEPT

    def __init__(self, counts: dict[str, int]):
        pairs: Counter = Counter()
        for gram, n in counts.items():
            pairs[gram[:2]] += n
        singles = Counter()
        for gram, n in counts.items():
            singles[gram[2]] += n
        total, size = sum(singles.values()), len(self.ALPHABET)
        base = {c: (singles[c] + 1) / (total + size) for c in self.ALPHABET}
        self.log = {a + b: {c: math.log((counts.get(a + b + c, 0) + 2 * base[c]) / (pairs[a + b] + 2)) for c in self.ALPHABET} for a in self.ALPHABET for b in self.ALPHABET}

    @staticmethod
    def grams(word: str) -> Iterator[str]:
        plain = EDGE * 2 + "".join(c if "a" <= c <= "z" else OTHER for c in word) + EDGE
        return (plain[k : k + 3] for k in range(len(plain) - 2))


def disguised(token: str) -> bool:
    """Whether a token has signs of disguise; each test reads it once."""
    if token.isalpha():
        return bool(_TRIPLE.search(token))
    first = _LETTER.search(token)
    if not first:
        return "_" in token
    last = next(k for k in range(len(token) - 1, -1, -1) if _LETTER.match(token, k))
    return bool("_" in token or _DIGIT.search(token) or _SYMBOL.search(token, first.end(), last) or _SIGN_BEFORE.search(token, 0, last) or _SIGN_AFTER.search(token) or _TRIPLE.search(token))


def restore(token: str, model: CharacterModel) -> str:
    """The likeliest words behind a token of any length in lower case, by Viterbi with back-pointers."""
    best, before, done = {EDGE * 2: (0.0, 0)}, "", []
    ahead: dict[int, dict[str, tuple[float, int]]] = {}  # states of readings that end beyond the next character
    steps: list[tuple[int, str]] = [(-1, "")]  # (step before, what is written)

    def written_at(k: int) -> str:
        shown = []
        while k >= 0:
            k, piece = steps[k]
            shown.append(piece)
        return "".join(reversed(shown))

    def reach(column: dict[str, tuple[float, int]], readings: list[tuple[str, str, float]]) -> None:
        following: dict[str, tuple[float, int, str]] = {}
        for state, (score, step) in best.items():
            row = model.log[state]
            for kind, shown, gain in readings:
                new, value = (EDGE * 2 if kind == EDGE else state[1] + kind, score + gain + row[kind]) if kind else (state, score + gain)
                if new not in following or value > following[new][0]:
                    following[new] = (value, step, shown)
        for state, (score, step, shown) in following.items():
            if state not in column or score > column[state][0]:
                if shown:
                    steps.append((step, shown))
                    step = len(steps) - 1
                column[state] = (score, step)

    drawn: dict[int, list[str]] = {}
    if _DRAWN.search(token):
        for sign in DRAWN_AS:
            for m in re.finditer(f"(?={re.escape(sign)})", token):
                drawn.setdefault(m.start(), []).append(sign)
    run = 0
    for at, c in enumerate(token):
        run = run + 1 if c == before else 1
        readings: list[tuple[str, str, float]] = []  # (class, what is written, log probability)
        if c.isalpha():
            readings.append((c if "a" <= c <= "z" else OTHER, c, 0.0))
            if c == before:
                readings.append(("", "", REPEAT))
        else:
            letters = STANDS_FOR.get(c, "")
            readings += [(x, x, SIGN) for x in letters]
            if c == before:
                pair = letters and run == 2 and token[at + 1 : at + 2] != c
                readings.append(("", "", SIGN_TWICE if pair else SEPARATOR))
            elif c in SEPARATORS:
                readings.append(("", "", SIGN_AS_SEPARATOR if letters else SEPARATOR))
            if c in SEPARATORS:
                readings.append((EDGE, " ", SIGN_AS_SEPARATOR if letters else SEPARATOR))
            readings.append((SIGN_KEPT, " ", KEPT))
        for sign in drawn.get(at, ()):
            reach(ahead.setdefault(at + len(sign), {}), [(DRAWN_AS[sign], DRAWN_AS[sign], DRAWN)])
        column = ahead.pop(at + 1, {})
        reach(column, readings)
        best, before = column, c
        if at % SETTLE == SETTLE - 1:
            columns = [best, *ahead.values()]
            texts = [written_at(step) for states in columns for _, step in states.values()]
            shared = len(commonprefix(texts))
            done.append(texts[0][:shared])
            steps, number = [(-1, text[shared:]) for text in texts], iter(range(len(texts)))
            for states in columns:
                states.update({state: (score, next(number)) for state, (score, _) in states.items()})
    return "".join(done) + max((score + model.log[state][EDGE], written_at(step)) for state, (score, step) in best.items())[1]


def readings(text: str) -> list[str]:
    """The tokens of a text in lower case; letters set apart by single spaces are one more token."""
    text = text.lower()
    tokens = text.split()
    spaced = [m.group().replace(" ", ".") for m in _SPACED.finditer(text)]
    return tokens + spaced if spaced else tokens


def token_features(token: str, model: CharacterModel) -> list[str]:
    """The restored words of a token (``word``) and their beginnings (``begin-``)."""
    core = token if token.isalpha() else token.rstrip(".,;:?\"')]}")
    if disguised(core):
        core = restore(core, model)
    found = []
    for word in _WORDS.findall(core):
        found.append(word)
        found += [word[:n] + "-" for n in BEGINNINGS if len(word) > n]
    return found


class _Features(dict):
    """token -> the slots of its features; with ``places`` (the chosen slots' numbers, else -1) the numbers of those that are chosen."""

    def __init__(self, model: CharacterModel, places: np.ndarray | None = None):
        self.model, self.places = model, places

    def __missing__(self, token: str) -> tuple:
        out = {xxhash.xxh3_64_intdigest(f) % SLOTS for f in token_features(token, self.model)}
        if self.places is not None:
            out = {int(self.places[s]) for s in out if self.places[s] >= 0}
        if len(token) <= 100:
            self[token] = tuple(out)
        return tuple(out)

    def of(self, text: str | None) -> set:
        if len(self) > REMEMBERED:
            self.clear()
        return set(chain.from_iterable(map(self.__getitem__, readings(text)))) if text else set()


def train_character_model(training: DataFrame) -> CharacterModel:
    """Trigram counts of the letter-only words of ``training`` (column text); at most 29³ counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("toxicity")
        grams: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(text.lower().split())
            for word, n in words.items():
                if word.isalpha():
                    for g in CharacterModel.grams(word):
                        grams[g] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    rows = training.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharacterModel({r["gram"]: r["n"] for r in rows.collect()})


def choose_slots(training: DataFrame, model: CharacterModel) -> np.ndarray:
    """By slot its number if the presence of its features tells of a label of 1 over all training documents, else -1.

    The driver gets a row per chosen slot, at most ``SLOTS``. Features that meet in a slot count together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("toxicity")
        features, counts = _Features(model), np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := features.of(text):
                    counts[1 if toxic else 0, list(found)] += 1
        seen = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["slot", "clean", "toxic"])

    rows = training.select("text", "toxic").mapInArrow(count, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {bool(r["toxic"]): r["count"] for r in training.groupBy("toxic").count().collect()}
    ratio = (F.col("toxic") + 0.5) / (n.get(True, 0) + 1) / ((F.col("clean") + 0.5) / (n.get(False, 0) + 1))
    chosen = sorted(r["slot"] for r in rows.filter((F.col("toxic") >= LEAST_DOCS) & (ratio > 2)).select("slot").collect())
    places = np.full(SLOTS, -1, np.int32)
    places[chosen] = np.arange(len(chosen))
    return places


def fit(examples: list[tuple[int, list[int]]], size: int, rounds: int = 1000, penalty: float = 0.03) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on sets of present features; penalty on the squares."""
    y = np.array([label for label, _ in examples], np.float64)
    row = np.repeat(np.arange(len(examples)), [len(f) for _, f in examples])
    column = np.fromiter(chain.from_iterable(f for _, f in examples), np.int64, len(row))
    w, square = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        z = np.bincount(row, w[column], len(y)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        gradient = np.append(np.bincount(column, error[row], size) + penalty * w[:-1], error.sum())
        square += gradient**2
        w -= 0.5 * gradient / np.sqrt(square)
    return w


class Judge:
    """What is learned: a character model, the numbers of the slots that count, and their weights (the last is the constant)."""

    def __init__(self, model: CharacterModel, places: np.ndarray, weights: np.ndarray):
        self.model, self.places, self.weights = model, places, weights

    def start(self) -> None:
        memory_of("toxicity")
        self.features = _Features(self.model, self.places)

    def stop(self) -> None:
        del self.features

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(self.weights[k] for k in sorted(self.features.of(text)))
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Learn from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks.

    Trigrams and the documents of each feature are counted over all of them;
    only the regression is fitted to a sample of about ``SAMPLE`` at most, by a
    hash of the text. Copies of a text with the same label count once, under
    the least id, so nothing depends on how the tables are dealt. Labels
    that are null teach nothing; of several for an id, the largest counts.
    """
    marks = labels.filter("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    training = slim.join(small(marks, SENT_LABELS), "_id").groupBy(F.sha2("text", 256).alias("_sha"), "toxic").agg(F.min("_id").alias("_id"), F.first("text").alias("text"))
    training = written(training.select("_id", "text", "toxic", "_sha"), "toxicity-training")
    share = min(1.0, SAMPLE / max(1, training.count()))
    sample = training.filter(F.pmod(F.xxhash64("_sha", F.lit(10)), F.lit(1 << 20)) < int((1 << 20) * share)).drop("_sha")
    model = train_character_model(training)
    places = choose_slots(training, model)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_of("toxicity")
        features = _Features(model, places)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sorted(features.of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["_id", "toxic", "f"])

    id_type = dict(training.dtypes)["_id"]
    rows = sample.mapInArrow(number, f"_id {id_type}, toxic int, f array<int>").collect()
    examples = [(int(bool(r["toxic"])), r["f"]) for r in sorted(rows, key=lambda r: (r["_id"], r["toxic"], r["f"]))]
    return Judge(model, places, fit(examples, int(places.max()) + 1) if examples else np.array([-math.log(99)]))


def score_documents(docs: DataFrame, judge: Judge, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns one row per input row: doc_id, score (0 to 1, higher for likelier
    toxic), predicted (1 at the threshold or above).

    * A null or empty text has the score of a document without any known feature.
    * Texts of any length are read whole. Repeated rows and null ids give a row each.
    * An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.start()
        for batch in batches:
            scores = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])
        own.stop()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double, predicted int")


def keep_clean(docs: DataFrame, judge: Judge, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose text scores below the threshold.

    Null and empty texts have the score of a document without any known
    feature. Repeated rows stay or go together, null ids are kept as they are,
    and an empty table gives an empty table.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(judge), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        own.start()
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))
        own.stop()

    return docs.mapInArrow(run, docs.schema)
