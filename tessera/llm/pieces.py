"""SentencePiece encoding and decoding with a merge-type (BPE) model, by backtracking.

Encoding a word: an Aho-Corasick automaton lists every piece at every
position; the longest one is tried first. A piece may follow another only if
re-merging their joined characters gives back the same two pieces. Where no
piece fits, the last one is taken back and its position is marked in a
bitfield of failed positions, so no position is left twice. The first sequence
that reaches the end is the one that the merges would make.

No piece holds a space mark after another character, so merges never cross
from a character to a space mark: words are encoded apart and remembered.
Runs of space marks have pieces of equal rank, for which the leftmost merge
goes first; these runs are merged directly.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_of

SPACE = "▁"
#: Entries that a worker remembers before it starts anew; bounds its memory.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 600_000, 300_000
#: Up to so many characters are merged without a queue; the rank of two symbols that no piece joins.
SHORT, NONE = 32, float("-inf")


class Vocabulary:
    """The pieces of a model file and their ranks; read with the library, which is used for nothing else here."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.size = len(ids)
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.id_of.items()}
        self.silent = {i for i in ids if model.is_control(i)}


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, model_file: str):
        self.vocabulary = v = Vocabulary(model_file)
        self.id_of, self.score = v.id_of, v.score
        self.letters = {c for p in v.id_of for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in v.id_of):
            raise ValueError("a piece holds a space mark after another character: words cannot be encoded apart")
        self.automaton = ahocorasick.Automaton()
        for piece in v.id_of:
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        unknown = "".join(re.escape(chr(c)) for c in sorted(map(ord, self.letters)) if c > 127)
        ascii_known = "".join(re.escape(chr(c)) for c in range(128) if chr(c) in self.letters)
        self.known_runs = re.compile(f"[{ascii_known}{unknown}]+|[^{ascii_known}{unknown}]")
        self.words = _Words(self)
        self.shown = _Shown(v)

    def merged(self, text: str) -> list[str]:
        """The pieces of ``text`` by repeated merging of the best pair, the leftmost of equals first."""
        if len(text) <= SHORT:
            return self.merged_short(text)
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and (whole := symbols[i] + symbols[j]) in self.score:
                heapq.heappush(queue, (-self.score[whole], i, whole))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if symbols[i] is not None else len(symbols)
            if j >= len(symbols) or symbols[i] + symbols[j] != whole:
                continue
            symbols[i], symbols[j] = whole, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def merged_short(self, text: str) -> list[str]:
        """As ``merged``; without a queue, which is faster for few characters."""
        symbols, rank = list(text), self.score.get
        ranks = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = max(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], NONE)
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """True if re-merging the characters of both gives the two pieces again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a run of known characters."""
        lengths: list[list[int]] = [[] for _ in text]
        for end, length in self.automaton.iter(text):
            lengths[end + 1 - length].append(length)  # by growing length: the end grows
        failed = 0
        pieces: list[str] = []
        starts: list[int] = []
        at, choice = 0, -1
        while at < len(text):
            options = lengths[at]
            choice = len(options) - 1 if choice < 0 else choice - 1
            while choice >= 0:
                end = at + options[choice]
                if not failed >> end & 1 and (not pieces or self.compatible(pieces[-1], text[at:end])):
                    break
                choice -= 1
            if choice >= 0:
                pieces.append(text[at:end])
                starts.append(at)
                at, choice = end, -1
                continue
            failed |= 1 << at
            if not pieces:
                raise ValueError(f"no sequence of pieces for {text[:80]!r}")
            at = starts.pop()
            choice = lengths[at].index(len(pieces.pop()))
            if choice == 0:
                choice = -2  # nothing shorter is left here
                lengths[at] = []
        return pieces

    def pieces(self, word: str) -> list[int]:
        """The ids of one word with its space marks; unknown characters fall back to bytes."""
        ids: list[int] = []
        for run in self.known_runs.findall(word):
            if run[0] in self.letters:
                for piece in self.merged(run) if SPACE * 2 in run else self.backtracked(run):
                    i = self.id_of.get(piece)
                    ids += [i] if i is not None else self.fallback(piece)
            else:
                ids += self.fallback(run)
        return ids

    def fallback(self, piece: str) -> list[int]:
        """The ids of a character's UTF-8 bytes."""
        return [self.vocabulary.byte_id.get(b, self.vocabulary.unknown_id) for b in piece.encode()]

    def encode_joined(self, text: str) -> str:
        """The ids of a whole text in decimal, joined by commas; empty for the empty text."""
        if not text:
            return ""
        text = text.replace(SPACE, " ")
        lookup, out = self.words.__getitem__, []
        for k, line in enumerate(text.split("\n")):
            # The text's own first word gets the added space mark; a line's first word has none.
            words = line.split(" ")
            if k:
                out.append(self.words.newline)
                if words[0]:
                    out.append(self.words.bare(words[0]))
                words = words[1:]
            if "" in words:
                words = _with_runs(words)
            out += map(lookup, words)
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(i) for i in joined.split(",")] if joined else []

    def decode_joined(self, joined: str) -> str:
        """The text of ids in decimal joined by commas."""
        if not joined:
            return ""
        ids = joined.split(",")
        shown = list(map(self.shown.__getitem__, ids))
        lead = next((k for k, s in enumerate(shown) if s != ""), None)
        if lead is not None and type(shown[lead]) is str and shown[lead][0] == " " and ids[lead] != self.shown.unknown:
            shown[lead] = shown[lead][1:]
        if self.shown.saw_bytes:
            return _join_bytes(shown)
        return "".join(shown)

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


class _Words(dict):
    """word without its leading space mark -> its ids, joined."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.newline = ",".join(map(str, encoder.pieces("\n")))

    def __missing__(self, word: str) -> str:
        return self.kept(word, SPACE + word)

    def bare(self, word: str) -> str:
        """A word at a line's start. Kept apart by a mark that no word can begin with."""
        return self.get("\n" + word) or self.kept("\n" + word, word)

    def kept(self, key: str, word: str) -> str:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = ",".join(map(str, self.encoder.pieces(word)))
        if len(key) <= 64:
            self[key] = ids
        return ids


class _Shown(dict):
    """id in decimal -> its text; a byte of 128 or more is shown as bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.saw_bytes = True
        for i, text in vocabulary.text_of.items():
            self[str(i)] = text
        for b, i in vocabulary.byte_id.items():
            self[str(i)] = bytes([b]) if b > 127 else chr(b)
        for i in vocabulary.silent:
            self[str(i)] = ""
        self.unknown = str(vocabulary.unknown_id)
        self[self.unknown] = " ⁇ "


codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _join_bytes(shown: list) -> str:
    """Joins texts; runs of bytes are UTF-8, each byte that is not valid there shows as U+FFFD."""
    try:
        return "".join(shown)
    except TypeError:
        pass
    out, run = [], bytearray()
    for s in shown:
        if type(s) is bytes:
            run += s
            continue
        if run:
            out.append(run.decode("utf-8", "each_byte"))
            run.clear()
        out.append(s)
    out.append(run.decode("utf-8", "each_byte"))
    return "".join(out)


def _with_runs(words: list[str]) -> list[str]:
    """Joins the empty words between spaces to the next word as space marks."""
    out, marks = [], 0
    for word in words[:-1]:
        if word:
            out.append(SPACE * marks + word)
            marks = 0
        else:
            marks += 1
    out.append(SPACE * marks + words[-1])
    return out


def encoder(model_file: str) -> Encoder:
    """One encoder per worker and model, until the worker serves another step."""
    known = memory_of("pieces")
    if model_file not in known:
        known[model_file] = Encoder(model_file)
    return known[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode its ids.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the decoded text); with
    ``with_ids`` also ids (array<int>) and decoded.

    * A null text is encoded as the empty text: no ids, the hashes of the empty string.
    * Texts of any length are encoded whole; words are encoded apart, so memory follows the longest text.
    * Repeated rows and null ids give a row each. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.

    ``model_file`` must exist on every executor; it is a merge-type model whose pieces keep words apart.
    """
    model = model_file or default_model()
    id_type = dict(docs.dtypes)[id_col]
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            joined, decoded = [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode_joined(text or "")
                joined.append(ids)
                decoded.append(own.decode_joined(ids))
            out = [
                batch.column(0),
                pa.array([ids.count(",") + 1 if ids else 0 for ids in joined], pa.int64()),
                pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids in joined]),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in decoded]),
            ]
            if with_ids:
                out += [pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids in joined], pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
