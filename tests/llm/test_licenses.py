"""License scans: denials, neighbours, wrapped notices, texts, and that compression decides."""

from __future__ import annotations

import re

import pytest

from tessera.llm import license_scan as scan

MIT = scan.MIT_GRANT + scan.MIT_CONDITION + scan.MIT_WARRANTY


def named(text):
    scanner, cue = scan.Scanner(), re.compile(scan.CUE, re.ASCII)
    return [name for block in scan.blocks(text, cue) for name, _ in scanner.names(block)[0]]


@pytest.mark.parametrize(
    "text,licenses",
    [
        ("This file is never licensed under the MIT License.", []),
        ("This isn't licensed under the MIT License.", []),
        ("This isn’t licensed under the MIT License.", []),
        ("It is not licensed under the MIT License or the Apache License, Version 2.0.", []),
        ("This is licensed under the Apache License, Version 2.0 and not under the MIT License.", ["Apache-2.0"]),
        ("A tool. Not a toy. Licensed under the MIT License. No warranty.", ["MIT"]),
        ("MIT-0 License", ["MIT-0"]),
        ("MIT No Attribution License", ["MIT-0"]),
        ("Licensed under MIT No Attribution", ["MIT-0"]),
        ("Licensed under CC BY 4.0 or the MIT License.", ["CC-BY-4.0", "MIT"]),
        ("Dual licensed under the MIT License and the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("Licensed under the Apache License\nVersion 2.0", ["Apache-2.0"]),
        ("licensed under\nthe MIT\nLicense", ["MIT"]),
        ("Licensed under MIT.", ["MIT"]),
        ("GPL-3.0-or-later", ["GPL-3.0"]),
        ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"]),
        ("GNU Lesser General Public License, version 3", []),
        ("GNU Affero General Public License, version 3", []),
        ("LGPL v3 or CC BY-ND 4.0", []),
        ("Released under the 2-clause BSD license.", ["BSD-2-Clause"]),
        ("my driving license is here", []),
        (MIT, ["MIT"]),
        (scan.MIT_GRANT + scan.MIT_WARRANTY, ["MIT-0"]),
        (scan.BSD_TERMS, ["BSD-2-Clause"]),
        (scan.BSD_TERMS + scan.BSD_NAMES, ["BSD-3-Clause"]),
        ("x " * 50_000 + MIT.replace(" ", "\n") + " y" * 50_000, ["MIT"]),
    ],
)
def test_named(text, licenses):
    assert named(text) == licenses


def test_compression_decides_between_close_texts(monkeypatch):
    """The text of BSD-3-Clause holds that of BSD-2-Clause whole: only the savings tell which is meant."""
    text = scan.BSD_TERMS + scan.BSD_NAMES
    assert named(text) == ["BSD-3-Clause"]
    savings = scan.Scanner.savings
    monkeypatch.setattr(scan.Scanner, "savings", lambda self, own: savings(self, own)[::-1])
    assert named(text) == ["BSD-2-Clause"]


def test_stretches_against_all_windows():
    """No window within the allowed differences is missed by the count of words."""
    template = scan.words("This project is licensed under the terms of the MIT license.")
    text = scan.words("we say this small project is licensed under terms of the MIT license and this project was licensed by the terms of MIT license for now")
    most = scan.DIFFER * len(template) // 100
    near = {k for k in range(len(text) - len(template) + 1) if scan.word_differences(text[k : k + len(template)], template) <= most}
    assert near and near <= set(scan.likely_stretches(text, template, most))
