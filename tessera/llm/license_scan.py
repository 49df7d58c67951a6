"""License scans by conditional compression.

The surroundings of license cues form candidate blocks. A block is compressed
alone and with each template as a zstandard raw dictionary, which ranks the
licenses by what their templates save. In that order the wordings are held
against the block: the first license that a stretch names, and that differs
from one of its templates in few words, wins its closest stretch. What lies
before and after are candidates again, ranked anew, so that all notices of a
block are named.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of public license texts.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
MIT_CONDITION = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
MIT_WARRANTY = ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC_TEXT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

# Fixed values: (SPDX identifier, phrases of which a stretch must hold one to name the license, wordings).
# Identifiers that hold a version, and names of licenses, are wordings of their own.
TEMPLATES = [
    ("Apache-2.0", ("apache license version 2.0", "apache license 2.0", "apache-2.0", "apache 2.0", "apache software license version 2.0"), (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License, Version 2.0", "Apache License 2.0", "Licensed under Apache 2.0", "Apache-2.0",
    )),
    ("MIT", ("mit license", "mit licence", "under mit", "spdx-license-identifier mit", "this permission notice shall be included"), (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License", "MIT Licence", "Licensed under MIT", "Released under MIT",
        MIT_GRANT + MIT_CONDITION + MIT_WARRANTY,
    )),
    ("MIT-0", ("mit-0", "mit no attribution", "permission is hereby granted free of charge"), (
        "MIT-0", "MIT-0 License", "Licensed under the MIT-0 License.", "MIT No Attribution", "MIT No Attribution License", "SPDX-License-Identifier: MIT-0",
        MIT_GRANT + MIT_WARRANTY,
    )),
    ("ISC", ("isc license", "spdx-license-identifier isc", "this permission notice appear in all copies"), (
        "ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", ISC_TEXT,
    )),
    ("GPL-3.0", ("general public license version 3", "general public license as published by the free software foundation either version 3", "gpl v3", "gpl version 3", "gplv3", "gplv3+", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-3.0+"), (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPL v3 license.",
        "GNU General Public License, version 3", "GPL v3", "GPL version 3", "GPLv3", "GPLv3+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+",
    )),
    ("GPL-2.0", ("general public license version 2", "general public license as published by the free software foundation either version 2", "gpl v2", "gpl version 2", "gplv2", "gplv2+", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0+"), (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "Released under the GPL v2 license.",
        "GNU General Public License, version 2", "GPL v2", "GPL version 2", "GPLv2", "GPLv2+", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+",
    )),
    ("BSD-3-Clause", ("bsd 3-clause", "3-clause bsd", "bsd-3-clause", "the bsd license", "neither the name of"), (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "BSD 3-Clause", "3-Clause BSD", "BSD-3-Clause",
        BSD_TERMS + BSD_NAMES,
    )),
    ("BSD-2-Clause", ("bsd 2-clause", "2-clause bsd", "bsd-2-clause", "simplified bsd license", "redistributions in binary form must reproduce"), (
        "Licensed under the BSD 2-Clause License.",
        "BSD 2-Clause", "2-Clause BSD", "BSD-2-Clause", "Simplified BSD License",
        BSD_TERMS,
    )),
    ("CC-BY-4.0", ("cc by 4.0", "cc-by-4.0", "commons attribution 4.0"), (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0).",
        "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0",
    )),
    ("CC-BY-SA-4.0", ("cc by-sa 4.0", "cc-by-sa-4.0", "commons attribution-sharealike 4.0"), (
        "Licensed under CC BY-SA 4.0.",
        "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0",
    )),
    ("CC-BY-NC-4.0", ("cc by-nc 4.0", "cc-by-nc-4.0", "commons attribution-noncommercial 4.0"), (
        "Licensed under CC BY-NC 4.0.",
        "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0",
    )),
    ("All-Rights-Reserved", ("all rights reserved",), (
        "All rights reserved.",
        "Copyright. All rights reserved.",
    )),
]
# What marks a candidate, and what opens a license text (then a longer part of the text is one).
CUE = r"(?i)licen[sc]|copyright|all rights reserved|spdx|creative commons|gpl|cc[ -]by|apache|mit-0|mit no|bsd|permission is hereby|permission to use|redistribution and use"
OPENING = re.compile(r"(?i)permission|redistribution|free software|compliance", re.ASCII)
#: Characters before and after a cue that belong to its block, and after one that may open a text.
REACH, TEXT_REACH = 200, 2_500
_WORD = re.compile(r"[^\s,;:()\"“”<>\[\]]+")
#: Differing words allowed of 100.
DIFFER = 25
# Words, or parts of words joined by hyphens, that tell licenses of one family apart; words that deny.
NAMING = {"affero", "lesser", "library", "nc", "noncommercial", "nd", "noderivatives", "noderivs", "sa", "sharealike", "0", "2-clause", "3-clause", "4-clause", "two-clause", "four-clause", "attribution"}
DENYING = {"not", "never", "no", "nor", "neither", "without", "cannot"}
#: Words on either side of a stretch that may name the license too, and words before it that may deny it.
AROUND, DENIED_WITHIN = 2, 4


def words(block: str) -> list[str]:
    return [w for w, _ in words_and_sentences(block)]


def words_and_sentences(block: str) -> list[tuple[str, int]]:
    """The lower-cased words, each with the number of its sentence. A sentence ends with its mark, a semicolon or an empty line."""
    found, sentence, end = [], 0, 0
    for m in _WORD.finditer(block):
        between = block[end : m.start()]
        sentence += ";" in between or between.count("\n") > 1
        raw, end = m.group().lower().replace("’", "'").strip("'*#"), m.end()
        word = raw.rstrip(".!?'")
        if word:
            found.append((word, sentence))
        sentence += raw[-1:] in (".", "!", "?")
    return found


def naming_words(found: list[str]) -> set[str]:
    return {p for w in found for p in (w, *w.split("-"))} & NAMING


def denies(word: str) -> bool:
    return word in DENYING or word.endswith("n't")


def holds(phrases: tuple[str, ...], found: list[str]) -> bool:
    text = f" {' '.join(found)} "
    return any(f" {p} " in text for p in phrases)


def likely_stretches(block: list[str], template: list[str], most: int) -> list[int]:
    """Starts of the stretches, as long as the template is, that share all but ``most`` of its words in any order; no other can differ in ``most`` words or less."""
    lacking, missing, found = Counter(template), len(template), []
    for k, word in enumerate(block):
        missing -= lacking[word] > 0
        lacking[word] -= 1
        if k >= len(template):
            gone = block[k - len(template)]
            lacking[gone] += 1
            missing += lacking[gone] > 0
        if missing <= most and (k + 1 >= len(template) or k + 1 == len(block)):
            found.append(max(0, k + 1 - len(template)))
    return found


def word_differences(stretch: list[str], template: list[str]) -> int:
    """Words to insert, delete or replace."""
    codes = difflib.SequenceMatcher(None, stretch, template, autojunk=False).get_opcodes()
    return sum(max(b - a, d - c) for op, a, b, c, d in codes if op != "equal")


class Scanner:
    """Names the licenses of a block."""

    def __init__(self, templates: list = TEMPLATES):
        self.wordings = [(name, phrases, words(text), self._compressor(text)) for name, phrases, texts in templates for text in texts]
        self.plain = zstandard.ZstdCompressor(level=9)

    @staticmethod
    def _compressor(text: str) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(" ".join(words(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=9)
        return zstandard.ZstdCompressor(level=9, dict_data=known)

    def savings(self, own: list[str]) -> list[tuple[float, int]]:
        """(part of the size that a wording saves, its place among the wordings), the largest first; in a tie the longer wording, then the earlier one."""
        data = " ".join(own).encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, k) for k, (_, _, _, c) in enumerate(self.wordings)), key=lambda x: (-x[0], -len(self.wordings[x[1]][2]), x[1]))

    def names(self, block: str) -> tuple[list[tuple[str, int]], float]:
        """([(license, differing words) of each confirmed stretch, in the order of the text], largest part of the block's size that a template saves)."""
        found = words_and_sentences(block)
        own, sentence = [w for w, _ in found], [k for _, k in found]
        won: dict[int, tuple[int, str, int, list[str]]] = {}
        taken, most_saved, ranges = [False] * len(own), 0.0, [(0, len(own))] if own else []
        while ranges:
            a, b = ranges.pop()
            ranked = self.savings(own[a:b])
            most_saved = max(most_saved, ranked[0][0]) if b - a == len(own) else most_saved
            for name in dict.fromkeys(self.wordings[place][0] for _, place in ranked):
                near = [x for n, phrases, template, _ in self.wordings if n == name for x in self._stretches(own, sentence, taken, a, b, phrases, template)]
                if near:
                    _, _, k, end, differing, template = min(near, key=lambda x: x[:3])
                    won[k] = (end, name, differing, template)
                    taken[k:end] = [True] * (end - k)
                    ranges += [r for r in ((end, b), (a, k)) if r[0] < r[1]]
                    break
        confirmed, denied = [], set()
        for k in sorted(won):
            end, name, differing, template = won[k]
            if self._denied(own, sentence, taken, denied, k, end, template):
                denied.update(range(k, end))
            else:
                confirmed.append((name, differing))
        return confirmed, most_saved

    @staticmethod
    def _stretches(own, sentence, taken, a: int, b: int, phrases: tuple[str, ...], template: list[str]) -> Iterator[tuple]:
        """The stretches within [a, b) that name the license and are close to the template, as (part of the words that differ, negative length, start, end, differing words, template)."""
        inside = own[a:b]
        if not holds(phrases, inside):
            return
        most, allowed = DIFFER * len(template) // 100, naming_words(template)
        for k in likely_stretches(inside, template, most):
            k, end = a + k, min(b, a + k + len(template))
            if not holds(phrases, own[k:end]):
                continue
            differing = word_differences(own[k:end], template)
            around = [own[i] for i in range(max(0, k - AROUND), min(len(own), end + AROUND)) if not taken[i] and (k <= i < end or sentence[i] == sentence[k if i < k else end - 1])]
            if differing <= most and not naming_words(around) - allowed:
                yield differing / len(template), -len(template), k, end, differing, template

    @staticmethod
    def _denied(own, sentence, taken, denied: set[int], k: int, end: int, template: list[str]) -> bool:
        """Whether a word of the stretch that its template lacks, or a word shortly before in the same sentence, denies; or a denied stretch comes shortly before."""
        if any(denies(w) for w in Counter(own[k:end]) - Counter(template)):
            return True
        for i in range(k - 1, max(-1, k - 1 - DENIED_WITHIN), -1):
            if sentence[i] != sentence[k] or (taken[i] and i not in denied):
                return False
            if i in denied or denies(own[i]):
                return True
        return False


def blocks(text: str, cue: re.Pattern) -> list[str]:
    """The surroundings of the cues, in whole words; those that meet are one block."""
    found: list[list[int]] = []
    for m in cue.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if OPENING.search(text, m.start(), end):
            end = min(len(text), m.end() + TEXT_REACH)
        if found and start <= found[-1][1]:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([start, end])
    return [_whole_words(text, start, end) for start, end in found]


def _whole_words(text: str, start: int, end: int) -> str:
    cut = text[start:end]
    if start and not text[start - 1].isspace():
        cut = cut[re.match(r"\S*", cut).end() :]
    if end < len(text) and not text[end].isspace():
        cut = cut[: re.search(r"\S*\Z", cut).start()]
    return cut


def scan_licenses(docs: DataFrame, templates: list = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licenses that a document names.

    Returns one row per input row: doc_id, n_blocks (candidate blocks),
    licenses (distinct confirmed names in order), n_unconfirmed (blocks
    without a confirmed name), most_saved (largest size reduction, 0 if no block),
    differences (least number of differing words of a confirmed stretch, else null).

    * A block gives every license that a stretch of it names, unless it is denied ("is not licensed under ...").
      Of overlapping stretches the license whose template saves more counts; in a tie that of the longer template,
      then the earlier in the list. Of a license's stretches the closest counts, then the longer, then the first.
    * A null or empty text has no blocks. Texts of any length are read whole.
    * Repeated rows and null ids give a row each. An empty table gives an empty result.
    * Other columns, whatever their names, are not read.

    Texts without a cue are answered in the JVM and never sent to Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, cue = Scanner(templates), re.compile(CUE, re.ASCII)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                judged = [scanner.names(b) for b in blocks(text, cue)] if text else []
                named = [found for confirmed, _ in judged for found in confirmed]
                rows.append((len(judged), sorted({name for name, _ in named}), sum(not confirmed for confirmed, _ in judged), max((saved for _, saved in judged), default=0.0), min((n for _, n in named), default=None)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_blocks", "licenses", "n_unconfirmed", "most_saved", "differences"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(CUE), text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_blocks long, licenses array<string>, n_unconfirmed long, most_saved double, differences int")
