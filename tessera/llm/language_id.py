"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all ways to cut it into pieces, of
the product of their probabilities, which the forward algorithm gives in one
pass. Probabilities come from the training words of the language: first from
all occurrences of the pieces in them, then from one round of expectation
maximisation (forward-backward) over the same words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .pieces import SPACE, Vocabulary, default_model

#: Words of up to this many characters go on together; longer ones one by one, in logarithms (it decides speed, never results).
TOGETHER_LETTERS = 24
#: Distinct words that a worker remembers, and that it counts before it passes them on.
REMEMBERED, COUNTED = 300_000, 200_000
#: Characters of text whose new words are scored together.
TOGETHER = 500_000
#: Added to every piece's count; probability of a character that no piece holds.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Expected counts are kept as whole numbers of this fraction, so that their sums do not depend on an order.
FRACTION = 1 << 10

#: Letters that have a column in the dense table of children.
FREQUENT = 63

_LETTERS = regex.compile(r"\p{L}+")


def marked_words(token: str) -> list[str]:
    """The runs of letters of a token in lower case, marked as words."""
    return [SPACE + token] if token.isalpha() else [SPACE + w for w in _LETTERS.findall(token)]


class Lattice:
    """All occurrences of pieces in words. The pieces are a trie, which many words walk at once.

    Words are in lower case, so pieces that are not stay out of the trie. The
    children by frequent letters are a dense table, those by others sorted keys.
    """

    def __init__(self, model_file: str):
        self.names = sorted(Vocabulary(model_file).id_of)
        child: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        for k, piece in enumerate(self.names):
            if piece != piece.lower():
                continue
            node = 0
            for letter in piece:
                node = child.setdefault((node, letter), len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = k
        self.piece_at = np.array(piece_at, np.int64)
        frequent = [letter for letter, _ in Counter(letter for _, letter in child).most_common(FREQUENT)]
        # Letters by number: 0 is in no piece, the next are frequent, the rest have no column in the dense table.
        self.number = np.zeros(0x110000, np.int64)
        for k, letter in enumerate([*frequent, *sorted({letter for _, letter in child} - set(frequent))]):
            self.number[ord(letter)] = k + 1
        self.dense = np.zeros((len(piece_at), FREQUENT + 1), np.int32)
        keys, to = [], []
        for (node, letter), below in child.items():
            column = int(self.number[ord(letter)])
            if column <= FREQUENT:
                self.dense[node, column] = below
            else:
                keys.append(node << 21 | column)
                to.append(below)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.below = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by each letter's number; 0 where there is none."""
        common = letter <= FREQUENT
        if common.all():
            return self.dense.ravel()[node * (FREQUENT + 1) + letter]
        found = np.where(common, self.dense[node, np.where(common, letter, 0)], 0)
        if len(self.keys):
            rare = np.nonzero(~common)[0]
            key = node[rare].astype(np.int64) << 21 | letter[rare]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[rare] = np.where(self.keys[edge] == key, self.below[edge], 0)
        return found

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word number, start, end and piece of every occurrence, by growing end."""
        text = self.number[np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32)]
        size = np.array([len(w) + 1 for w in words])
        word_no = np.repeat(np.arange(len(words)), size)
        start = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        # The line feed after each word is in no piece, so every walk ends there.
        at, node, depth, found = np.arange(len(text)), np.zeros(len(text), np.int64), 0, []
        while len(at):
            node = self.step(node, text[at + depth])
            hit = np.nonzero(node)[0]
            at, node, depth = at[hit], node[hit], depth + 1
            whole = self.piece_at[node] >= 0
            found.append((at[whole], self.piece_at[node[whole]], np.full(int(whole.sum()), depth)))
        at, piece, length = (np.concatenate(c) for c in zip(*found))
        end = start[at] + length
        order = np.argsort(end.astype(np.uint16) if size.max() < 1 << 16 else end, kind="stable")
        at, end = at[order], end[order]
        return word_no[at], start[at], end, piece[order]

    def forward(self, words: list[str], arcs: tuple, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of the first t characters of each word, by t, word and language, and where no piece ends.

        All words go on together, one position at a time.
        """
        word_no, start, end, piece = arcs
        sums = np.zeros((max(map(len, words)) + 1, table.shape[1], len(words)))
        sums[0] = 1.0
        stuck = np.zeros((len(sums), len(words)), bool)
        bounds = np.searchsorted(end, np.arange(len(sums) + 1))
        for t in range(1, len(sums)):
            here = slice(bounds[t], bounds[t + 1])
            w, s, p = word_no[here], start[here], piece[here]
            for k in range(table.shape[1]):
                sums[t, k] = np.bincount(w, sums[s, k, w] * table[p, k], len(words))
            stuck[t] = np.bincount(w, minlength=len(words)) == 0
            sums[t][:, stuck[t]] = sums[t - 1][:, stuck[t]] * UNKNOWN
        return sums, stuck

    def long_forward(self, word: str, arcs: tuple, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``forward`` for one word of any length: log sums by t and language, and where no piece ends."""
        _, start, end, piece = arcs
        bounds = np.searchsorted(end, np.arange(len(word) + 2))
        sums, stuck = np.zeros((len(word) + 1, logs.shape[1])), bounds[1:] == bounds[:-1]
        for t in range(1, len(sums)):
            here = slice(bounds[t], bounds[t + 1])
            sums[t] = sums[t - 1] + np.log(UNKNOWN) if stuck[t] else np.logaddexp.reduce(sums[start[here]] + logs[piece[here]], axis=0)
        return sums, stuck

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word in every language, a row per word; ``table`` has a row per piece."""
        out = np.empty((len(words), table.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= TOGETHER_LETTERS]
        if short:
            some = [words[k] for k in short]
            sums, _ = self.forward(some, self.arcs(some), table)
            out[short] = np.log(np.maximum(sums[np.array([len(w) for w in some]), :, np.arange(len(some))], 1e-300))
        if len(short) < len(words):
            logs = np.log(table)
            for k, w in enumerate(words):
                if len(w) > TOGETHER_LETTERS:
                    out[k] = self.long_forward(w, self.arcs([w]), logs)[0][-1]
        return out

    def expected(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected uses of pieces in the segmentations of each word: word number, piece, uses."""
        short = np.array([k for k, w in enumerate(words) if len(w) <= TOGETHER_LETTERS], np.int64)
        found = []
        if len(short):
            word_no, piece, share = self.expected_together([words[k] for k in short], p)
            found.append((short[word_no], piece, share))
        if len(short) < len(words):
            logs = np.log(p)
            found += [(np.full(len(piece), k), piece, share) for k, w in enumerate(words) if len(w) > TOGETHER_LETTERS for piece, share in [self.expected_alone(w, logs)]]
        return tuple(np.concatenate(c) for c in zip(*found))

    def expected_alone(self, word: str, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and expected uses of every occurrence in one word of any length (forward-backward in logarithms)."""
        arcs = _, start, end, piece = self.arcs([word])
        sums, stuck = self.long_forward(word, arcs, logs[:, None])
        back = np.full(len(sums), -np.inf)
        back[-1] = 0.0
        bounds = np.searchsorted(end, np.arange(len(sums) + 1))
        for t in range(len(sums) - 1, 0, -1):
            here = slice(bounds[t], bounds[t + 1])
            np.logaddexp.at(back, start[here], back[t] + logs[piece[here]])
            if stuck[t]:
                back[t - 1] = np.logaddexp(back[t - 1], back[t] + np.log(UNKNOWN))
        return piece, np.minimum(np.exp(sums[start, 0] + logs[piece] + back[end] - sums[-1, 0]), 1.0)

    def expected_together(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``expected`` for short words, all at once (forward-backward)."""
        arcs = word_no, start, end, piece = self.arcs(words)
        sums, stuck = self.forward(words, arcs, p[:, None])
        length = np.array([len(w) for w in words])
        back = np.zeros((len(sums), len(words)))
        back[length, np.arange(len(words))] = 1.0
        bounds = np.searchsorted(end, np.arange(len(sums) + 1))
        for t in range(len(sums) - 1, 0, -1):
            here = slice(bounds[t], bounds[t + 1])
            w = word_no[here]
            np.add.at(back, (start[here], w), back[t, w] * p[piece[here]])
            back[t - 1, stuck[t]] += back[t, stuck[t]] * UNKNOWN
        total = sums[length, 0, np.arange(len(words))]
        share = sums[start, 0, word_no] * p[piece] * back[end, word_no] / np.maximum(total, 1e-300)[word_no]
        return word_no, piece, np.minimum(share, 1.0)


_LATTICES: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    if model_file not in _LATTICES:
        _LATTICES[model_file] = Lattice(model_file)
    return _LATTICES[model_file]


class _Scores(dict):
    """token -> row of ``table``, which holds its log probability in every language; -1 where it has no letter."""

    def __init__(self, own: Lattice, probabilities: np.ndarray):
        self.own, self.probabilities = own, probabilities
        self.start()

    def start(self) -> None:
        self.clear()
        self.table, self.used = np.zeros((4096, self.probabilities.shape[1])), 0

    def learn(self, tokens: set[str]) -> None:
        """Scores the tokens that are new, all at once."""
        parts: list[str] = []
        first: list[int] = []
        new: list[str] = []
        for token in tokens.difference(self):
            found = marked_words(token)
            if found:
                new.append(token)
                first.append(len(parts))
                parts += found
            else:
                self[token] = -1
        if not new:
            return
        log = np.add.reduceat(self.own.log_probabilities(parts, self.probabilities), first)
        while self.used + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used : self.used + len(new)] = log
        self.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)


def piece_probabilities(training: DataFrame, model_file: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, table of probabilities with a row per piece, log share of documents) from rows of text and lang.

    The driver gets at most a count per piece of the vocabulary and language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tokens in counts.items():
                words: Counter = Counter()
                for token, n in tokens.items():
                    for part in marked_words(token):
                        words[part] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, counts.values())) >= COUNTED:
                yield from flush()
        yield from flush()

    def uses(batches: Iterator[pd.DataFrame], table: np.ndarray | None) -> Iterator[pd.DataFrame]:
        own = lattice(model_file)
        total = np.zeros((len(languages), len(own.names)), np.int64)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                words, n, k = rows["word"].tolist(), rows["n"].to_numpy(), languages.index(lang)
                if table is None:
                    word_no, _, _, piece = own.arcs(words)
                    share = np.ones(len(piece))
                else:
                    word_no, piece, share = own.expected(words, table[:, k])
                np.add.at(total[k], piece, np.round(share * n[word_no] * FRACTION).astype(np.int64))
        for k, lang in enumerate(languages):
            at = np.nonzero(total[k])[0]
            yield pd.DataFrame({"lang": lang, "piece": at, "uses": total[k][at]})

    def gathered(rows: DataFrame, languages: list[str]) -> np.ndarray:
        own = lattice(model_file)
        sums = np.zeros((len(own.names), len(languages)))
        found = rows.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        sums[found["piece"].to_numpy(), found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy()] = found["uses"] / FRACTION
        return (sums + SMOOTHING) / (sums + SMOOTHING).sum(axis=0)

    shares = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    languages = sorted(shares)
    if not languages:
        return [], np.zeros((0, 0)), np.zeros(0)
    words = training.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    kind = "lang string, piece int, uses long"
    first = gathered(words.mapInPandas(lambda batches: uses(batches, None), kind), languages)
    sent = words.sparkSession.sparkContext.broadcast(first)
    again = gathered(words.mapInPandas(lambda batches: uses(batches, sent.value), kind), languages)
    prior = np.log(np.array([shares[x] for x in languages], np.float64) / sum(shares.values()))
    return languages, again, prior


def _token_lists(texts: pa.Array) -> Iterator[list[list[str]]]:
    """The tokens of texts, a few texts at a time, so that no more than about ``TOGETHER`` characters are split at once."""
    lists, size = [], 0
    for text in texts:
        text = text.as_py() or ""
        lists.append(text.lower().split())
        size += len(text)
        if size >= TOGETHER:
            yield lists
            lists, size = [], 0
    if lists:
        yield lists


def identify(docs: DataFrame, training: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every text with what ``training`` (columns text, lang) teaches.

    Returns one row per input row: doc_id, lang_pred, score (posterior
    probability of the prediction among the learned languages).

    * A null text, or one without a letter, is ``und`` with score 0. So is every text if there is nothing to learn from.
    * Training rows with a null text or lang teach nothing.
    * Ties go to the first language by code point. Texts of any length are scored whole.
    * Repeated rows and null ids give a row each. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.
    """
    model = model_file or default_model()
    usable = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    languages, probabilities, prior = piece_probabilities(usable, model)
    sent = docs.sparkSession.sparkContext.broadcast(probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(lattice(model), sent.value) if languages else None
        for batch in batches:
            names, sure = [], []
            for tokens in _token_lists(batch.column(1)):
                if languages:
                    if len(scores) > REMEMBERED:
                        scores.start()
                    scores.learn(set().union(*tokens))
                for found in tokens:
                    rows = np.fromiter(map(scores.__getitem__, found), np.int64, len(found)) if languages else np.empty(0, np.int64)
                    rows = rows[rows >= 0]
                    if len(rows):
                        log = scores.table[rows].sum(axis=0) + prior
                        best = int(log.argmax())
                        names.append(languages[best])
                        sure.append(float(1 / np.exp(log - log[best]).sum()))
                    else:
                        names.append("und")
                        sure.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, lang_pred string, score double")
