"""Rows that a shortcut would lose."""

import random

import xxhash

from tessera.llm import license_scan, simhash, toxicity


def jaccard_kept(rows, words, share):
    """The ids that stay if every pair is compared by its sets of shingles."""
    sets = {i: set(simhash.shingle_hashes(t, words)) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return sorted(i for i in root if root[i] == i)


def near_rows(seed, groups, lengths):
    """(id, text): pairs with one to six changed words, on both sides of a similarity of 0.8."""
    rng = random.Random(seed)
    rows = []
    for k in range(groups):
        text = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.choice(lengths))]
        other = list(text)
        for at in rng.sample(range(len(text)), min(len(text), rng.randint(1, 6))):
            other[at] = "changed"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other if k % 3 else text[1:]))]
    return rows


def test_near_stage_is_exact_jaccard(spark):
    rows = near_rows(5, 150, [5, 8, 9, 10, 14, 60, 120, 200])
    kept = simhash.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == jaccard_kept(rows, 5, 0.8)


def test_near_stage_is_exact_in_dense_groups(spark):
    """Many copies of one text, some below the threshold to most others: groups that are decided in two steps."""
    rng = random.Random(6)
    text = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    rows = []
    for k in range(120):
        copy = list(text)
        for at in rng.sample(range(150), rng.randint(1, 4)):
            copy[at] = f"w{k}"
        rows.append((k, " ".join(copy)))
    kept = simhash.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == jaccard_kept(rows, 5, 0.8)


def test_near_stage_on_documents(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in found.collect())
    kept = simhash.keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == jaccard_kept(rows, 5, 0.8)


def test_toxic_features_are_counted_over_all_labels(spark, monkeypatch):
    """With a sample of an eighth, a word of 9 toxic documents is still a feature."""
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    rng = random.Random(7)
    plain = ["the", "cat", "went", "home", "with", "some", "bread", "and", "milk", "today"]
    rows = [(k, " ".join(rng.choices(plain, k=12)) + f" n{k}" + (" idiot" if k % 4 == 0 else "") + (" blockhead" if k % 48 == 0 else "")) for k in range(400)]
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda examples, size, fit=toxicity.fit: fitted.append(len(examples)) or fit(examples, size))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    judge = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert all(judge.places[xxhash.xxh3_64_intdigest(word) % toxicity.SLOTS] >= 0 for word in ("idiot", "blockhead"))
    assert 0 < fitted[0] < 100


def test_license_names_are_exact():
    scanner = license_scan.Scanner()
    others = ["GNU Lesser General Public License, version 3", "GNU Affero General Public License, version 3", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0", "BSD 2-Clause License", "BSD 4-Clause License", "Not released under the MIT License."]
    assert all(scanner.names(text)[0] == [] for text in others)
    named = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under the BSD 3-Clause License.": "BSD-3-Clause"}
    assert {text: scanner.names(text)[0] for text in named} == {text: [(name, 0)] for text, name in named.items()}


def test_every_notice_of_a_block_is_named():
    names = lambda block: [name for name, _ in license_scan.Scanner().names(block)[0]]
    assert names("All rights reserved. Released under the MIT License. Licensed under CC BY-SA 4.0.") == ["All-Rights-Reserved", "MIT", "CC-BY-SA-4.0"]
    assert names("Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.") == ["CC-BY-SA-4.0", "CC-BY-4.0"]
    assert names("word " * 5_000 + "Licensed under CC BY 4.0." + " word" * 5_000 + " Licensed under CC BY 4.0.") == ["CC-BY-4.0"] * 2
    assert names("") == [] and names("This work is licensed") == []


def test_likely_stretches_lose_none():
    rng = random.Random(3)
    for _ in range(300):
        block, template = rng.choices("abcde", k=rng.randint(0, 14)), rng.choices("abcdef", k=rng.randint(1, 6))
        most = rng.randint(0, len(template) - 1)
        starts = range(max(1, len(block) - len(template) + 1)) if block else []
        close = [k for k in starts if license_scan.word_differences(block[k : k + len(template)], template) <= most]
        assert set(close) <= set(license_scan.likely_stretches(block, template, most))
