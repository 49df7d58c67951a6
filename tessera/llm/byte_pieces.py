"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The library splits a text by a pattern and merges the bytes of each match.
It wants the whole text at once, so long texts are cut beforehand, only where
a match ends in any case, and their parts are encoded one after another. Its
pattern matcher fails on very long runs of white space; what such a run
matches is known, so it is merged as one piece, past the pattern.
Ids are decoded to raw bytes: a token may hold a part of a character.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are cut into parts of at least so many.
PART = 1 << 16
#: Between these characters every match of the pattern ends: a match holds white space only at its start, and
#: letters, digits and signs are never joined in one, but for a sign before letters (as in 's).
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[0-9])")


#: Unicode's White_Space, which the pattern's \\s means; and a run of it that the library does not get to match.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_BLANK = 4_096


def parts(text: str, least: int = PART, blank: int = LONG_BLANK) -> Iterator[tuple[str, bool]]:
    """``text`` in parts, each with True if it is one match of the pattern.

    A part has ``least`` characters and as many more as it takes to the next
    safe place. A run of ``blank`` or more white space is a part: all of it at
    the end of the text, else all but its last character, which the pattern
    leaves to what follows.
    """
    if len(text) <= min(least, blank):
        yield text, False
        return
    at = 0
    for run in re.finditer(f"{BLANK}{{{blank},}}", text):
        yield from ((x, False) for x in cuts(text[at : run.start()], least))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    yield from ((x, False) for x in cuts(text[at:], least))


def cuts(text: str, least: int) -> Iterator[str]:
    at = 0
    while len(text) - at > least:
        found = SAFE.search(text, at + least)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Coder:
    """The library's encoding of a rank file by a pattern, and one without a pattern; there are no special tokens."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of each part of ``text``."""
        for part, whole in parts(text):
            yield (self.whole if whole else self.split).encode_ordinary(part)

    def decode(self, ids: list[int]) -> bytes:
        return self.split.decode_bytes(ids)


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(rank_file: str, pattern: str) -> Coder:
    """One coder per worker, rank file and pattern."""
    if (rank_file, pattern) not in _CODERS:
        _CODERS[rank_file, pattern] = Coder(rank_file, pattern)
    return _CODERS[rank_file, pattern]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode its ids.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit numbers), decoded_sha256 (of the decoded bytes); with
    ``with_ids`` also ids (array<int>).

    * A null text is encoded as the empty text: no ids, the hashes of the empty string.
    * Special tokens in a text are ordinary text. Texts of any length are encoded whole, part by part.
    * Repeated rows and null ids give a row each. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.

    ``rank_file`` must exist on every executor. SAFE holds for patterns whose
    matches keep white space to their start and do not mix letters, digits and
    signs, but for a sign before letters; the public tokenizers' PATTERN is one.
    """
    ranks, split = rank_file or default_ranks(), pattern or default_pattern()
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, split)
        for batch in batches:
            sizes, id_hashes, text_hashes, every = [], [], [], []
            for text in batch.column(1).to_pylist():
                size, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in own.encode(text or ""):
                    size += len(ids)
                    of_ids.update(np.asarray(ids, "<u4").tobytes())
                    of_text.update(own.decode(ids))
                    kept += ids if with_ids else ()
                sizes.append(size)
                id_hashes.append(of_ids.hexdigest())
                text_hashes.append(of_text.hexdigest())
                every.append(kept)
            out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            out += [pa.array(every, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The raw bytes of every row's ids: doc_id, decoded (binary). Null ids give null; an unknown or null id is an error."""
    ranks, split = rank_file or default_ranks(), pattern or default_pattern()
    schema = f"doc_id {dict(encoded.dtypes)[id_col]}, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, split)
        for batch in batches:
            decoded = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)
