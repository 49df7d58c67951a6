"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and an end. The most frequent training words
are symbols of their own; all others share the symbols of their endings. A
symbol is a path in a Huffman tree, so the model only predicts bits. For each
bit several predictors see different contexts, hashed with the tree's node to a
slot of a table that has the counts of both bits in training: none, the last
function word, the last two, and the symbol before. A mixer adds the
predictors' log odds with weights; a gate, how well the longer contexts are
known, selects the set of weights. Along a text the weights are refined by
gradient steps on what was just read, after every fourth word at first and in
longer steps later. The weights at the start fit a fold of the training data
that the tables of that step have not seen (Newton's method on sums of whole
numbers, so that no partitioning changes them).

Within its symbol a word has the probability of its count in training; the
counts of all words are a Spark table that grows with the corpus. A word that
was never seen is the unknown word of its symbol: as in the base score, it is
one event. Only ``bits_per_byte`` adds the bits that spell it, by a second set
of predictors over bytes: the last one, two and three, and the word so far.

Texts are scored many at a time, all at the same step, each with weights of its
own: the probability of a text depends on its own words and the model only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The symbol of a text's end, and the byte that ends a spelled word (white space, so never part of one).
END, STOP = 0, 10
#: Words that are symbols of their own, and those of them that serve as function words; symbols of endings, and their bytes.
HEAD_WORDS, FUNCTION_WORDS, ENDINGS, ENDING_BYTES = 1_024, 128, 256, 3
#: Words that are sent with their counts, and their longest; all others meet their counts by a join.
SENT_WORDS, SENT_LENGTH = 200_000, 64
#: log2 of the slots of each predictor's table, for symbols and for bytes.
WORD_TABLES, BYTE_TABLES = (12, 19, 20, 20), (16, 18, 20, 20)
#: Slots of a table that are summed together; partial tables that one task adds up.
CHUNK, FAN_IN = 1 << 16, 64
#: Symbols that are turned into arrays at a time.
SEGMENT = 1 << 16
#: (words, from this one on): a step of refinement.
STEPS = ((4, 0), (16, 64), (64, 320))
#: Refinement per step; shrinkage of counts; gates; rounds of Newton's method and its ridge.
RATE, SHRINK, GATES, ROUNDS, RIDGE = 1.5, 0.2, 16, 1, 20.0
#: Sums that must not depend on an order are of whole numbers of these fractions.
FRACTION, BIT_FRACTION, LOG_FRACTION = 1 << 8, 1 << 20, 1 << 36

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_R = 0x100000001B3
#: The remainders of CRC-32 by its last byte.
_CRC = np.array([crc32(bytes([k])) ^ crc32(b"\0") for k in range(256)], np.uint32)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of some texts (none null), one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an edge gives an empty word
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[offsets[1:]] - before[offsets[:-1]]


class Code:
    """A Huffman code of symbols: for each, the nodes on its path and the bits taken there."""

    def __init__(self, counts: list[int]):
        size = len(counts)
        queue = [(n + 1, k) for k, n in enumerate(counts)]
        heapq.heapify(queue)
        children: list[tuple[int, int]] = []
        while len(queue) > 1:
            (n, a), (m, b) = heapq.heappop(queue), heapq.heappop(queue)
            heapq.heappush(queue, (n + m, size + len(children)))
            children.append((a, b))
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        below = [(queue[0][1], [])]
        while below:
            symbol, path = below.pop()
            if symbol < size:
                paths[symbol] = path
            else:
                below += [(child, path + [(symbol - size, bit)]) for bit, child in enumerate(children[symbol - size])]
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([n for path in paths for n, _ in path], np.int32)
        self.bit = np.array([b for path in paths for _, b in path], np.int8)
        self.sign = (1 - 2 * self.bit).astype(np.float32)
        self.hashed = (self.node.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)

    def expand(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of bits of each of the symbols ``x``, and the place in the code of every bit."""
        length = self.length[x]
        before = np.cumsum(length) - length
        return length, np.repeat(self.start[x] - before, length) + np.arange(length.sum())


def word_contexts(x: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """What is before each symbol of texts one after another: nothing, the last function word, the last two, the symbol before.

    ``start`` has the place of the first symbol of each symbol's text; every text ends with END.
    """
    before = np.concatenate(([END], x[:-1])).astype(np.uint64)
    place = np.arange(len(x))
    place = np.maximum.accumulate(np.where((before > END) & (before <= FUNCTION_WORDS), place, -1))
    last = np.where(place >= start, before[place], 0).astype(np.uint64)
    again = np.where(place > start, last[np.maximum(place - 1, 0)], 0).astype(np.uint64)
    return [np.zeros(len(x), np.uint64), last, last * np.uint64(1000) + again + np.uint64(1), before + np.uint64(1 << 40)]


def byte_contexts(parts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bytes of spelled words, and what is before each: one, two, three bytes, the whole word so far."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    length = np.array([len(p) for p in parts], np.int64)
    start = np.repeat(np.cumsum(length) - length, length)
    place = np.arange(len(data)) - start
    back = [np.where(place >= k, data[np.maximum(np.arange(len(data)) - k, 0)], 0).astype(np.uint64) for k in (1, 2, 3)]
    # Hashes of a word so far: differences of one running sum of byte * R^position.
    n = len(data)
    power, inverse, running = (np.ones(n + 1, np.uint64) for _ in range(3))
    power[1:], inverse[1:], running[0] = _R, pow(_R, -1, 1 << 64), 0
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    running[1:] = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)
    word = (running[:-1] - running[start]) * inverse[start] + place.astype(np.uint64) * _C
    two = back[0] | back[1] << np.uint64(8)
    return data, [back[0], two, two | back[2] << np.uint64(16), word]


def slots(code: Code, contexts: list[np.ndarray], table_bits: tuple[int, ...], length: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """By predictor, the table slots of every bit: of a symbol's context together with the node of its path."""
    step = code.hashed[place]
    for k, (context, bits) in enumerate(zip(contexts, table_bits)):
        yield slots_of(k, code, context, bits, length, place, step)


def slots_of(k: int, code: Code, context: np.ndarray, bits: int, length: np.ndarray, place: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The slots of predictor ``k``. A context is mixed to a random place, from which its nodes spread in golden steps."""
    if k == 0 and not context.any():
        return code.node[place] & (1 << bits) - 1
    mixed = (context + np.uint64(k + 1)) * _A
    mixed ^= mixed >> np.uint64(29)
    at = np.repeat((mixed * _B >> np.uint64(32)).astype(np.uint32), length)
    at += step
    at >>= np.uint32(32 - bits)
    return at


class Tables:
    """Log odds and how well they are known, of each predictor, packed in 16 bits."""

    def __init__(self, counts: list[np.ndarray]):
        self.packed = []
        for c in counts:
            zero, one = c[0::2].astype(np.float64), c[1::2].astype(np.float64)
            odds = np.log((one + SHRINK) / (zero + SHRINK)).clip(-11, 11)
            known = np.digitize(zero + one, (1, 8, 128))
            self.packed.append((np.round(odds * 512).astype(np.int16) << 2 | known.astype(np.int16)).astype(np.int16))


class Scorer:
    """Scores bits; ``weights`` has a row of weights per gate."""

    def __init__(self, code: Code, table_bits: tuple[int, ...], tables: Tables, weights: np.ndarray):
        self.code, self.table_bits, self.tables, self.weights = code, table_bits, tables, weights

    def inputs(self, x: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log odds (a row per predictor and one for the bias), gate and sign (1 for a 0, -1 for a 1) of every bit of the symbols ``x``; bits by symbol."""
        length, place = self.code.expand(x)
        found = np.empty((len(contexts), len(place)), np.int16)
        for k, at in enumerate(slots(self.code, contexts, self.table_bits, length, place)):
            np.take(self.tables.packed[k], at, out=found[k], mode="clip")
        odds = np.empty((len(found) + 1, len(place)), np.float32)
        np.multiply(found >> 2, np.float32(1 / 512), out=odds[:-1])
        odds[-1] = 0.3
        return odds, (found[3] & 3) * 4 + (found[2] & 3), self.code.sign[place], length

    def mixed(self, odds: np.ndarray, sign: np.ndarray, weights: list[np.ndarray], key: np.ndarray) -> np.ndarray:
        """The odds against every bit as it is; ``weights`` has an array per predictor, in which ``key`` finds a bit's own."""
        z = weights[0].take(key)
        z *= odds[0]
        for own, o in zip(weights[1:], odds[1:]):
            z += own.take(key) * o
        z *= sign
        return np.exp(np.minimum(z, np.float32(60), out=z), out=z)

    def fixed(self, x: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """The information in bits of every symbol, with the starting weights."""
        odds, gate, sign, length = self.inputs(x, contexts)
        odd = self.mixed(odds, sign, list(self.weights.T.copy()), gate)
        return np.bincount(np.repeat(np.arange(len(x)), length), np.log1p(odd, dtype=np.float64), len(x)) / np.log(2)

    def slopes(self, x: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """By gate, sums over all bits of the gradient and of the upper half of the curvature, in whole numbers of 1 / FRACTION²."""
        odds, gate, sign, _ = self.inputs(x, contexts)
        odd = self.mixed(odds, sign, list(self.weights.T.copy()), gate)
        wrong = odd / (1 + odd)
        error, curve = -sign * wrong, wrong * (1 - wrong)
        upper, total = np.triu_indices(len(odds)), np.zeros((GATES, len(odds) * (len(odds) + 3) // 2), np.int64)
        order = np.argsort(gate.astype(np.int8), kind="stable")
        edges = np.searchsorted(gate[order], np.arange(GATES + 1))
        own, root, error = np.take(odds, order, axis=1), np.sqrt(curve)[order], np.rint(error[order] * FRACTION).astype(np.float64)
        # Products of whole numbers: exact in doubles, so their sums have no order.
        whole, bent = np.rint(own * FRACTION).astype(np.float64), np.rint(own * (root * FRACTION)).astype(np.float64)
        for k in range(GATES):
            at = slice(edges[k], edges[k + 1])
            total[k, : len(odds)] = whole[:, at] @ error[at]
            total[k, len(odds) :] = (bent[:, at] @ bent[:, at].T)[upper]
        return total


    def refined(self, x: np.ndarray, contexts: list[np.ndarray], text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """The information of each of ``n`` texts in whole numbers of 1 / BIT_FRACTION bits.

        ``text`` and ``place`` are the number of every symbol's text and the
        symbol's place there. All texts take a step together; then each
        refines weights of its own.
        """
        step, ended = np.zeros(len(x), np.int64), 0
        for k, (words, first) in enumerate(STEPS):
            inside = np.maximum(place - first, 0)
            if k + 1 < len(STEPS):
                inside = np.minimum(inside, STEPS[k + 1][1] - first)
            step += inside // words
        # The longest texts come first, so that those that take a step have the first weights.
        rank = np.empty(n, np.int64)
        rank[np.argsort(-np.bincount(text, minlength=n), kind="stable")] = np.arange(n)
        text = rank[text]
        order = np.argsort(step, kind="stable")
        x, text, step, contexts = x[order], text[order], step[order], [c[order] for c in contexts]
        ends = np.append(np.nonzero(np.diff(step))[0] + 1, len(x))
        weights = [np.tile(w, n) for w in self.weights.T]
        total = np.zeros(n)
        while ended < len(x):
            # As many whole steps as fit a segment; one at least.
            until = max(int(np.searchsorted(ends, ended + SEGMENT, side="right")) - 1, int(np.searchsorted(ends, ended, side="right")))
            part = slice(ended, int(ends[until]))
            odds, gate, sign, length = self.inputs(x[part], [c[part] for c in contexts])
            owner = np.repeat(text[part], length)
            key = owner * GATES + gate
            odd = np.empty(len(sign), np.float32)
            bits = np.concatenate(([0], np.cumsum(length)))
            at = 0
            for stop in bits[ends[np.searchsorted(ends, ended, side="right") : until + 1] - ended].tolist():
                here = slice(at, stop)
                odd[here] = c = self.mixed(odds[:, here], sign[here], weights, key[here])
                error = sign[here] * c / (np.float32(-1) - c)
                own = key[here]
                size = (int(owner[here].max()) + 1) * GATES
                rate = RATE / (np.bincount(own, minlength=size) + 100.0)
                for w, o in zip(weights, odds):
                    w[:size] += (np.bincount(own, error * o[here], size) * rate).astype(np.float32)
                at = stop
            total += np.bincount(owner, np.rint(np.log(odd + np.float32(1)) * (BIT_FRACTION / math.log(2))), n)
            ended = part.stop
        return total[rank]


def starting_weights(predictors: int) -> np.ndarray:
    """By gate: the better the longer contexts (numbers 2 and 3) are known, the more they count; the weights sum to 1."""
    w = np.zeros((GATES, predictors + 1), np.float32)
    for gate in range(GATES):
        three, two = divmod(gate, 4)
        w[gate, 1:4] = 0.35, 0.05 + 0.1 * two, 0.02 + 0.1 * three
        w[gate, 0] = 1 - w[gate].sum()
    return w


class Lexicon:
    """The words that are sent: their symbols, and what they and the words of an ending add to a score."""

    def __init__(self, words: pa.Array, counts: list[int], endings: dict[int, tuple[int, int]], ends: int):
        """``words`` by falling ``counts``; ``endings`` has by ending the tokens of all its words and how many words occur once."""
        self.words = words.cast(pa.string())
        n, ending = np.array(counts, np.int64), endings_of(words)
        self.head = min(HEAD_WORDS, len(words))
        inside, once = (np.array([endings.get(k, (0, 0))[i] for k in range(ENDINGS)], np.int64) for i in (0, 1))
        np.subtract.at(inside, ending[: self.head], n[: self.head])
        np.subtract.at(once, ending[: self.head], (n[: self.head] == 1).astype(np.int64))
        unseen = (once + 1) / (inside + once + 2)
        self.known = np.log10(1 - unseen) - np.log10(np.maximum(inside, 1))
        self.miss = np.log10(unseen) - self.known
        self.symbol = np.where(np.arange(len(n)) < self.head, np.arange(len(n)) + 1, self.head + 1 + ending)
        self.base = np.log10(n + 1.0)
        self.inside = np.where(np.arange(len(n)) < self.head, 0.0, np.log10(n) + self.known[ending])
        self.sizes = [ends, *counts[: self.head], *inside.tolist()]

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of some texts: all symbols, the number of each word (below -1: the ending of one that was not sent; END is -1), the words not sent, the lengths with ENDs."""
        flat, length = word_lists(pa.array(texts, pa.string()))
        length = length + 1
        found = pc.fill_null(pc.index_in(flat, value_set=self.words), -2).to_numpy().astype(np.int64)
        missing = np.nonzero(found == -2)[0]
        rare = flat.take(pa.array(missing))
        found[missing] = -2 - endings_of(rare)
        number = np.full(length.sum(), -1, np.int64)
        inner = np.ones(len(number), bool)
        inner[np.cumsum(length) - 1] = False
        number[inner] = found
        x = np.where(number == -1, END, self.head - 1 - number)
        sent = np.nonzero(number >= 0)[0]
        x[sent] = self.symbol[number[sent]]
        return x, number, rare, length


def endings_of(words: pa.Array) -> np.ndarray:
    """CRC-32 of the last bytes of each word (none is empty), modulo ``ENDINGS``."""
    words = words.cast(pa.binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in range(ENDING_BYTES, 0, -1):
        at = np.nonzero(ends[1:] - back >= ends[:-1])[0]
        crc[at] = _CRC[(crc[at] ^ data[ends[1:][at] - back]) & 0xFF] ^ crc[at] >> np.uint32(8)
    return (~crc).astype(np.int64) % ENDINGS


def spelled(word: bytes) -> bytes:
    return word + bytes([STOP])


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype(np.uint32).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint32)


def add_to(table: np.ndarray, at: np.ndarray) -> None:
    if len(table) <= CHUNK:
        table += np.bincount(at, minlength=len(table)).astype(np.uint32)
    else:
        np.add.at(table, at, np.uint32(1))


def count_tables(rows: DataFrame, code: Code, table_bits: tuple[int, ...], read: Callable[[list], tuple[np.ndarray, list[np.ndarray]]], weight: Callable[[object], int], dense: dict[int, tuple[int, int]]) -> dict[bool, list[np.ndarray]]:
    """Counts of both bits in every slot, for rows (value, late) with late false and true apart.

    ``read`` gives the symbols and contexts of some values, ``weight`` about
    how many symbols a value has. ``dense`` has, for predictors of few contexts, the
    first one and their number: there a task counts contexts with symbols, and
    takes the bits of each pair once at its end. Each task sums its own tables; partial
    tables are added in groups of at most ``FAN_IN`` until one is left, and the
    driver gets that one, whose size is fixed by ``table_bits``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bool, list[np.ndarray]] = {}
        pairs: dict[bool, dict[int, np.ndarray]] = {}
        symbols = len(code.length)
        waiting: dict[bool, list] = {True: [], False: []}
        held = {True: 0, False: 0}

        def add(late: bool) -> None:
            values, waiting[late], held[late] = waiting[late], [], 0
            if not values:
                return
            if late not in own:
                own[late] = [np.zeros(2 << b, np.uint32) for b in table_bits]
                pairs[late] = {k: np.zeros(n * symbols, np.uint32) for k, (_, n) in dense.items()}
            x, contexts = read(values)
            for k, (first, _) in dense.items():
                add_to(pairs[late][k], (contexts[k] - np.uint64(first)).astype(np.intp) * symbols + x)
            for s in range(0, len(x) if len(dense) < len(table_bits) else 0, 2 * SEGMENT):
                length, place = code.expand(x[s : s + 2 * SEGMENT])
                bit, step = code.bit[place].astype(np.uint32), code.hashed[place]
                for k in range(len(table_bits)):
                    if k not in dense:
                        at = slots_of(k, code, contexts[k][s : s + 2 * SEGMENT], table_bits[k], length, place, step)
                        add_to(own[late][k], (at.astype(np.uint32) << 1 | bit).astype(np.intp))

        def add_pairs(late: bool) -> None:
            for k, counts in pairs.get(late, {}).items():
                found = np.nonzero(counts)[0]
                for s in range(0, len(found), SEGMENT):
                    context, x = np.divmod(found[s : s + SEGMENT], symbols)
                    length, place = code.expand(x)
                    at = slots_of(k, code, context.astype(np.uint64) + np.uint64(dense[k][0]), table_bits[k], length, place, code.hashed[place])
                    np.add.at(own[late][k], (at.astype(np.uint32) << 1 | code.bit[place].astype(np.uint32)).astype(np.intp), np.repeat(counts[found[s : s + SEGMENT]], length))

        for batch in batches:
            for value, late in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting[late].append(value)
                held[late] += weight(value)
                if held[late] >= 2 * SEGMENT:
                    add(late)
        for late in (True, False):
            add(late)
            add_pairs(late)
        part = TaskContext.get().partitionId()
        for late, tables in own.items():
            for k, table in enumerate(tables):
                for j in range(0, len(table), 2 * CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([late]), pa.array([k]), pa.array([j]), pa.array([_packed(table[j : j + 2 * CHUNK])], pa.binary())], names=["part", "late", "k", "j", "counts"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        summed = np.zeros(len(_unpacked(group["counts"].iat[0])), np.uint64)
        for c in group["counts"]:
            summed += _unpacked(c)
        while summed.max(initial=0) > 0xFFFFFFF0:
            summed >>= np.uint64(1)
        return group.head(1).assign(counts=[_packed(summed)])

    kind = "part long, late boolean, k long, j long, counts binary"
    found = rows.mapInArrow(count, kind)
    left = rows.rdd.getNumPartitions()
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "late", "k", "j").applyInPandas(total, kind)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    out = {late: [np.zeros(2 << b, np.uint32) for b in table_bits] for late in (True, False)}
    for r in found.toLocalIterator():
        counts = _unpacked(bytes(r["counts"]))
        out[r["late"]][r["k"]][r["j"] : r["j"] + len(counts)] = counts
    return out


def fitted_weights(rows: DataFrame, scorer: Scorer, read: Callable[[list], tuple[np.ndarray, list[np.ndarray]]]) -> np.ndarray:
    """The weights, without refinement, that fit the values of ``rows`` best: Newton's method on sums over all their bits."""
    size = scorer.weights.shape[1]
    upper = np.triu_indices(size)
    for _ in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(scorer)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, size + len(upper[0])), np.int64)
            for batch in batches:
                values = batch.column(0).to_pylist()
                for k in range(0, len(values), 256):
                    x, contexts = read(values[k : k + 256])
                    for j in range(0, len(x), SEGMENT // 8):
                        total += sent.value.slopes(x[j : j + SEGMENT // 8], [c[j : j + SEGMENT // 8] for c in contexts])
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "total"])

        total = np.zeros(GATES * (size + len(upper[0])))
        for r in rows.select("value").mapInArrow(run, "k int, total long").groupBy("k").agg(F.sum("total").alias("total")).collect():
            total[r["k"]] = r["total"] / FRACTION**2
        sent.unpersist()
        weights = scorer.weights.astype(np.float64)
        for gate, own in enumerate(total.reshape(GATES, -1)):
            curve = np.zeros((size, size))
            curve[upper] = own[size:]
            curve += np.triu(curve, 1).T
            weights[gate] += np.linalg.solve(curve + RIDGE * np.eye(size), own[:size]).clip(-1, 1)
        scorer = Scorer(scorer.code, scorer.table_bits, scorer.tables, np.round(weights, 4).astype(np.float32))
    return scorer.weights


def train(rows: DataFrame, code: Code, table_bits: tuple[int, ...], read: Callable, weight: Callable, dense: dict[int, tuple[int, int]]) -> Scorer:
    """A scorer from rows (value, late)."""
    counts = count_tables(rows, code, table_bits, read, weight, dense)
    early = Scorer(code, table_bits, Tables(counts[False]), starting_weights(len(table_bits)))
    weights = fitted_weights(rows.filter("late"), early, read)
    return Scorer(code, table_bits, Tables([a + b for a, b in zip(counts[False], counts[True])]), weights)


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary), n: the words of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(word_lists(batch.column(0).cast(pa.string()))[0])
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"])

    rows = training.select("text").mapInArrow(count, "word binary, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def byte_counts(words: DataFrame) -> list[int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            _, offsets, data = batch.column(0).buffers()
            ends = np.frombuffer(offsets, np.int32)[batch.column(0).offset :][: batch.num_rows + 1]
            total += np.bincount(np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], minlength=256)
            total[STOP] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    found = {r["byte"]: r["n"] for r in words.select("word").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(256)]


def score_documents(docs: DataFrame, trains: str, late: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text with a model of the rows for which the SQL condition ``trains`` holds.

    ``late`` is a condition too: training rows for which it holds set the
    starting weights, before their counts join the tables.

    Returns one row per input row: doc_id, n_tokens (words and the end),
    n_known (tokens seen in training), train_tokens, base_score (add-one
    unigrams, log10), score (the model's log10 probability of the tokens, an
    unknown word being one event as in the base), n_bytes (of the text in
    UTF-8), bits_per_byte (of the score and the spelling of unknown words).

    * A null text is the empty text: one token, the end. Its bits are given for one byte.
    * Texts of any length are scored whole, in segments of bounded memory.
    * Repeated rows and null ids give a row each; copies count in training as often as they occur.
    * With nothing to train on, train_tokens is 0, every word is unknown, and the score is that of the untrained model.
    * An empty table gives an empty result. Other columns, whatever their names, are not read.
    * No partitioning of the rows changes a score.

    The driver gets tables of fixed size and the ``SENT_WORDS`` most frequent words; all other counts meet by a join.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.expr(trains).alias("_trains"), F.expr(late).alias("late"))
    training = slim.filter("_trains").select(F.col("text").alias("value"), F.coalesce("late", F.lit(False)).alias("late"))

    words = word_counts(training.withColumnRenamed("value", "text"))
    ends = training.count()
    ending = (F.crc32(F.expr(f"substring(word, -{ENDING_BYTES}, {ENDING_BYTES})")) % ENDINGS).alias("ending")
    endings = words.groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.expr("count_if(n = 1)").alias("once")).collect()
    all_tokens, kinds = sum(r["n"] for r in endings) + ends, sum(r["kinds"] for r in endings) + (1 if ends else 0)
    top = words.filter(F.octet_length("word") <= SENT_LENGTH).orderBy(F.col("n").desc(), "word").limit(SENT_WORDS).toArrow()
    lexicon = Lexicon(top["word"].combine_chunks(), top["n"].to_pylist(), {r["ending"]: (r["n"], r["once"]) for r in endings}, ends)
    sent_lexicon = spark.sparkContext.broadcast(lexicon)

    def read_texts(texts: list) -> tuple[np.ndarray, list[np.ndarray]]:
        x, _, _, length = sent_lexicon.value.read(texts)
        return x, word_contexts(x, np.repeat(np.cumsum(length) - length, length))

    def read_words(values: list) -> tuple[np.ndarray, list[np.ndarray]]:
        return byte_contexts([spelled(v) for v in values])

    word_pairs = {0: (0, 1), 1: (0, FUNCTION_WORDS + 1), 3: (1 << 40, len(lexicon.sizes))}
    of_words = train(training, Code(lexicon.sizes), WORD_TABLES, read_texts, lambda t: len(t) // 4, word_pairs)
    kinds_of_words = words.select(F.col("word").alias("value"), (F.pmod(F.xxhash64("word"), F.lit(7)) == 6).alias("late"))
    of_bytes = train(kinds_of_words, Code(byte_counts(words)), BYTE_TABLES, read_words, len, {})
    sent, sent_speller = spark.sparkContext.broadcast(of_words), spark.sparkContext.broadcast(of_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, lexicon = sent.value, sent_lexicon.value
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                until, held = at, 0
                while until < len(texts) and (until == at or held < 4 * SEGMENT):
                    held += len(texts[until]) // 4 + 1
                    until += 1
                x, number, rare_words, length = lexicon.read(texts[at:until])
                text = np.repeat(np.arange(len(length)), length)
                start = np.repeat(np.cumsum(length) - length, length)
                bits = scorer.refined(x, word_contexts(x, start), text, np.arange(len(x)) - start, len(length)) / BIT_FRACTION
                sure, rare = number >= 0, number < -1
                inside, base = np.zeros(len(x)), np.zeros(len(x))
                inside[sure], base[sure] = lexicon.inside[number[sure]], lexicon.base[number[sure]]
                base[number == -1] = math.log10(ends + 1)
                inside[rare] = lexicon.known[-2 - number[rare]]
                score = np.bincount(text, inside, len(length)) - bits * math.log10(2)
                known = np.bincount(text, sure | ((number == -1) & (ends > 0)), len(length)).astype(np.int64)
                kinds_here = rare_words.dictionary_encode()
                own = text[rare] * max(1, len(kinds_here.dictionary)) + kinds_here.indices.to_numpy()
                own, times = np.unique(own, return_counts=True)
                owner, kind = np.divmod(own, max(1, len(kinds_here.dictionary)))
                columns = [kinds_here.dictionary.take(pa.array(kind)).cast(pa.binary()), pa.array(times), pa.array(lexicon.miss[endings_of(kinds_here.dictionary)][kind])]
                edges = np.searchsorted(owner, np.arange(len(length) + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(columns, ["word", "k", "miss"]))
                n_bytes = pc.binary_length(batch.column(1).slice(at, until - at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, until - at), pa.array(length), pa.array(known), pa.array(np.bincount(text, base, len(length))), pa.array(score), n_bytes.cast(pa.int64()), rest],
                    names=["doc_id", "n_tokens", "head_known", "head_base", "head_score", "n_bytes", "rest"],
                )
                at = until

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent_speller.value
        for batch in batches:
            unseen = np.nonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))[0]
            values = [spelled(w) for w in batch.column(1).take(pa.array(unseen)).to_pylist()]
            bits = np.zeros(batch.num_rows, np.int64)
            for k in range(0, len(values), 4096):
                part = values[k : k + 4096]
                each = own.fixed(*byte_contexts(part))
                bits[unseen[k : k + 4096]] = np.rint(np.add.reduceat(each, np.cumsum([0] + [len(v) for v in part[:-1]])) * BIT_FRACTION)
            times = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(bits * times)], names=["row_no", "known", "base", "score", "spelling"])

    id_type = dict(slim.dtypes)["doc_id"]
    scored = slim.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, head_known long, head_base double, head_score double, n_bytes long, rest array<struct<word: binary, k: long, miss: double>>")
    scored = written(scored.withColumn("row_no", F.monotonically_increasing_id()), "lm-scored")
    for done in (sent, sent_lexicon):
        done.unpersist()
    # Sums of doubles that arrive in any order are of whole numbers. Logarithms are taken once per word of the training data.
    whole = lambda c: F.rint(c * LOG_FRACTION).cast("long")
    logs = words.select("word", whole(F.log10(F.col("n") + 1)).alias("add_one"), whole(F.log10("n")).alias("inside"))
    tail = scored.select("row_no", F.explode("rest").alias("x")).select("row_no", "x.word", "x.k", whole(F.col("x.miss")).alias("miss")).join(logs, "word", "left")
    unseen = F.col("inside").isNull()
    tail = tail.select(
        "row_no", F.when(unseen, F.col("word")).alias("unseen"), "k",
        F.when(unseen, 0).otherwise(F.col("k")).cast("long").alias("known"),
        (F.col("k") * F.coalesce("add_one", F.lit(0))).alias("base"),
        (F.col("k") * F.coalesce("inside", "miss")).alias("score"),
    )
    tail = tail.mapInArrow(spell, "row_no long, known long, base long, score long, spelling long")
    sums = tail.groupBy("row_no").agg(*(F.sum(c).alias(f"tail_{c}") for c in ("known", "base", "score", "spelling")))
    part = lambda name: F.coalesce(name, F.lit(0)) / LOG_FRACTION
    found = scored.drop("rest").join(sums, "row_no", "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + part("tail_base") - F.col("n_tokens") * F.log10(F.lit(float(all_tokens + kinds + 1)))).alias("base_score"),
        (F.col("head_score") + part("tail_score")).alias("score"), "n_bytes",
        (F.coalesce("tail_spelling", F.lit(0)) / BIT_FRACTION).alias("spelling"),
    )
    bits = F.col("spelling") - F.col("score") / math.log10(2)
    return found.withColumn("bits_per_byte", bits / F.greatest("n_bytes", F.lit(1))).drop("spelling")
