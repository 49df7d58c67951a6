"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tessera.llm import embeddings, exact_dedup, language_id, license_scan, lm_score, mixing, pieces, queries, simhash, toxicity, url_filter
from tessera.llm.common import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("The long text goes on and on. " * 20_000).strip()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)


def awkward(spark):
    """Nulls, empties, a long text, repeated rows, equal texts, odd characters; and columns whose names clash."""
    rows = [(1, None), (2, ""), (3, LONG), (4, "same text here"), (5, "same text here"), (5, "same text here"), (None, "no id"), (6, "  \t\n "), (7, "naïve café 中文 😀\x00 ▁▁ x"), (8, "!!! 123")]
    df = docs(spark, rows)
    for name in ("keep_id", "row_no", "text_sha256", "size", "score", "word", "fp", "late", "_sha", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def collected(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


# --- 1 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return pieces.encoder(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_match_the_library(coder, library):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "▁", "the", "ing", "é", "ñ", "中", "文", "😀", "​", "a", "0", "==", "        ", "<s>", "<unk>", "<0x0A>", "\x00", "…", "ﷺ", "----", "\r\n", "Straße", "́", "Привет", "नमस्ते"]
    vocabulary = list(coder.id_of)
    for _ in range(4000):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(vocabulary).replace("▁", " ") for _ in range(rng.randint(0, 14)))
        ids = library.encode(text)
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids)


def test_backtracking_gives_what_merging_gives(coder):
    rng = random.Random(3)
    letters = sorted(c for c in coder.letters if c.isascii() and c.isalpha())
    for _ in range(2000):
        word = "".join(rng.choices(letters, k=rng.randint(1, 20)))
        assert coder.backtracked(word) == coder.merged(word)


def test_pieces_decode_broken_bytes(coder, library):
    byte = {b: i for b, i in coder.vocabulary.byte_id.items()}
    for ids in ([byte[0xE4], byte[0xB8]], [byte[0xFF], byte[0x41]], [byte[0xE4], byte[0xB8], byte[0xAD]], [1, 2, 0], []):
        assert coder.decode(ids) == library.decode(ids)


def test_encode_documents(spark, library):
    found = collected(pieces.encode_documents(awkward(spark), with_ids=True))
    empty = hashlib.sha256(b"").hexdigest()
    assert (found[1][0]["n_tokens"], found[1][0]["ids_sha256"], found[1][0]["decoded_sha256"]) == (0, empty, empty)
    assert found[3][0]["ids"] == library.encode(LONG) and found[3][0]["decoded"] == LONG
    assert len(found[5]) == 2 and None in found
    assert pieces.encode_documents(awkward(spark).limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------


def test_licenses(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under CC BY-NC 4.0.\nText\nAll rights reserved."), (3, "licensed under the apache license version 2.0 today"), (4, "my driving license is here"), (5, None), (6, ""), (7, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY 4.0."), (8, LONG + "\nReleased under the MIT License.")]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert {k: r["licenses"] for k, r in found.items()} == {1: ["MIT"], 2: ["All-Rights-Reserved", "CC-BY-NC-4.0"], 3: ["Apache-2.0"], 4: [], 5: [], 6: [], 7: ["CC-BY-4.0"], 8: ["MIT"]}
    assert found[1]["differences"] == 0 and found[4]["n_unconfirmed"] == 1 and found[5]["n_blocks"] == 0
    assert license_scan.scan_licenses(awkward(spark)).count() == 10
    assert license_scan.scan_licenses(docs(spark, []).limit(0)).count() == 0


def test_every_template_names_itself():
    scanner = license_scan.Scanner()
    for name, _, wordings in license_scan.TEMPLATES:
        for wording in wordings:
            assert scanner.names(wording)[0] == [(name, 0)]


def test_license_query_against_phrases(spark):
    found = queries.op2_license_scan(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    phrases = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "licensed under the GNU General Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License": "MIT", "All rights reserved.": "All-Rights-Reserved"}
    for r in found:
        assert set(filter(None, r["licenses"].split(","))) == {v for k, v in phrases.items() if k in (texts[r["doc_id"]] or "")}


# --- 3 -------------------------------------------------------------------------


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.EXAMPLE.com/en/7x", "http://com/en/", "https://xcom/en/1", "https://b.net/de/8", "https://example.net/de/8#f", "ftp://x.org?q=/es/", "://org/es/1", "http://x.org/es/?a", "a\nb://q.com/en/1", "http://example.com/en/8", "http://..com/en/", "http://ÄB.com/en/", "x" * 100_000 + "://com/en/"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = collected(url_filter.judge_urls(df, queries.URL_RULES), "page_id")
    for k, u in enumerate(urls):
        r = found[k][0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(u), u
    assert len(found[0]) == 2
    assert url_filter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe():
    listed = {f"in{k}" for k in range(300)}
    universe = [f"out{k}" for k in range(5000)]
    first = url_filter.Bloom(listed, 0.3, 0)
    cascade = url_filter.Cascade(first, listed, {k for k in universe if k in first})
    assert len(cascade.levels) > 2
    assert all(k in cascade for k in listed) and not any(k in cascade for k in universe)


# --- 4 -------------------------------------------------------------------------


def test_exact_dedup(spark):
    df = awkward(spark)
    found = exact_dedup.exact_dedup(df).collect()
    assert len(found) == 10
    by = {}
    for r in found:
        by.setdefault(r["text_sha256"], []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r["doc_id"] for r in by[sha("")]) == [1, 2]
    assert [(r["keep_id"], r["group_size"]) for r in by[sha("same text here")]] == [(5, 3)] * 3
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values())
    assert by[sha("no id")][0]["keep_id"] is None
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    kept = exact_dedup.keep_last_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8]


def test_exact_dedup_heavy_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2))).alias("text"))
    found = exact_dedup.exact_dedup(df, frequent=5, tracked=64).collect()
    groups = Counter(r["text_sha256"] for r in found)
    assert max(groups.values()) == 1000 and all(r["group_size"] == groups[r["text_sha256"]] for r in found)
    assert {r["keep_id"] for r in found if r["group_size"] == 1000} == {2997}


# --- 5 -------------------------------------------------------------------------


def test_language_id_query(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op5_language_id(spark, DATA).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_id_edges(spark):
    teach = spark.createDataFrame([("der hund und die katze", "de"), ("the dog and the cat", "en"), (None, "en"), ("x", None)], "text string, lang string")
    df = awkward(spark).withColumn("lang_pred", F.lit(1))
    found = collected(language_id.identify(df, teach))
    assert {k: found[k][0]["lang_pred"] for k in (1, 2, 6, 8)} == dict.fromkeys((1, 2, 6, 8), "und")
    assert found[3][0]["lang_pred"] == "en" and len(found[5]) == 2
    assert {r["lang_pred"] for r in language_id.identify(df, teach.limit(0)).collect()} == {"und"}
    assert language_id.identify(df.limit(0), teach).count() == 0


def test_forward_sums_all_segmentations():
    own = language_id.lattice(pieces.default_model())
    number = {p: k for k, p in enumerate(own.names)}
    table = np.random.default_rng(1).random((len(own.names), 2))
    table /= table.sum(axis=0)

    def brute(word, k):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            fits = [s for s in range(end) if word[s:end] in number]
            total[end] = sum(total[s] * table[number[word[s:end]], k] for s in fits) if fits else total[end - 1] * language_id.UNKNOWN
        return math.log(total[-1])

    words = ["▁hello", "▁straße", "▁xy", "a"]
    got = own.log_probabilities(words, table)
    assert all(abs(got[i, k] - brute(w, k)) < 1e-9 for i, w in enumerate(words) for k in range(2))
    # The expected uses cover every letter of each word once, unknown letters aside.
    word_no, piece, uses = own.expected(words, table[:, 0])
    covered = np.bincount(word_no, uses * [len(own.names[k]) for k in piece])
    assert np.allclose(covered, [sum(c in number for c in w) for w in words])


def test_hosts_of_many_labels(spark):
    long = ".".join(["a"] * 100_000)
    rows = [(1, f"http://{long}.example.com/en/7x"), (2, f"http://{long}.com/en/"), (3, f"http://{long}/en/"), (4, "http://com/en/"), (5, "http://.com/en/")]
    found = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert found == {1: "example.com/en/7", 2: "com/en/", 3: None, 4: "com/en/", 5: "com/en/"}


def test_long_words_are_not_cut():
    own = language_id.lattice(pieces.default_model())
    rng = np.random.default_rng(1)
    table = rng.random((len(own.names), 3)) + 1e-3
    table /= table.sum(axis=0)
    for n in (23, 24, 25, 40):
        word = pieces.SPACE + "".join(rng.choice(list("aetion"), n - 1))
        sums = own.forward([word], own.arcs([word]), table)[0][n, :, 0]
        assert np.allclose(own.log_probabilities([word, "\u2581a"], table)[0], np.log(sums))
        slow = {}
        for k, piece, share in zip(*own.expected_together([word], table[:, 0])):
            slow[piece] = slow.get(piece, 0) + share
        found = {}
        for k, piece, share in zip(*own.expected(["\u2581a", word], table[:, 0])):
            if k == 1:
                found[piece] = found.get(piece, 0) + share
        assert slow.keys() == found.keys() and all(abs(slow[x] - found[x]) < 1e-9 for x in slow)
    assert np.isfinite(own.log_probabilities([pieces.SPACE + "ab" * 40_000], table)).all()


def test_numbers_are_not_letters(spark):
    found = language_id.identify(docs(spark, [(1, "² ½ 12"), (2, "der")]), spark.createDataFrame([("der die das", "de"), ("the", "en")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {1: "und", 2: "de"}


# --- 6 -------------------------------------------------------------------------


def shares(sizes):
    """Targets by repeated resharing."""
    total, weight = sum(sizes.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed = {}
    while True:
        rest = {s for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


def test_mixing(spark):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        source = ["a", "b", "c", None, "d"][min(4, int(rng.expovariate(1)))]
        rows.append((k, " ".join(["w"] * rng.randint(0, 40)) if k % 50 else None, "en", source, 0))
    df = spark.createDataFrame(rows + rows[:3], DOCS).withColumn("size", F.lit("clash")).withColumn("copies", F.lit("clash"))
    found = mixing.mix_sources(df).collect()
    assert len(found) == 903
    source = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = shares(dict(sizes))
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    assert all(0 <= want[s] - taken[s] <= 40 for s in want)
    again = mixing.mix_sources(df.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["taken"], r["shards"])
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(awkward(spark)).count() == 10
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in found)


def test_mixing_fills_quotas_from_all_blocks(spark):
    """One word is missing after the large documents; of 400 only one has so few, in whichever block."""
    rows = [(k, " ".join(["w"] * 6), "en", "a", 0) for k in range(400)] + [(1000 + k, " ".join(["w"] * n), "en", "b", 0) for k, n in enumerate([50] * 400 + [1, 1, 2, 3, 7, 20])]
    found = mixing.mix_sources(spark.createDataFrame(rows, DOCS), cap=1, weights=(1, 5)).collect()
    taken, target, sizes = Counter(), {}, {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        sizes.setdefault(r["source"], []).append((r["size"], r["copies"]))
    for s in target:
        room = target[s] - taken[s]
        assert 0 <= room and not any(0 < size <= room and copies == 0 for size, copies in sizes[s])
    # The same with more passes: what is left is smaller than every document that the last pass leaves out.
    found = mixing.mix_sources(spark.createDataFrame(rows, DOCS), weights=(5, 1)).collect()
    for s in ("a", "b"):
        mine = [r for r in found if r["source"] == s]
        room, least = mine[0]["target"] - sum(r["taken"] for r in mine), min(r["copies"] for r in mine)
        assert 0 <= room and (max(r["copies"] for r in mine) == least or not any(r["copies"] == least and r["size"] <= room for r in mine))


def test_mixing_query_targets(spark):
    found = queries.op6_mixing(spark, DATA).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = Counter()
    for r in found:
        sizes[source[r["doc_id"]]] += r["size"]
    want = shares(dict(sizes))
    assert all(abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 for r in found)


def test_split_quotas_keeps_sums():
    quotas = [0, 7, 1000, 33]
    shards = mixing.split_quotas(quotas, 12, 1)
    assert len(shards) == 12 and np.sum(shards, axis=0).tolist() == quotas and mixing.split_quotas(quotas, 12, 1) == shards
    assert max(map(sum, shards)) - min(map(sum, shards)) <= 12


# --- 7 -------------------------------------------------------------------------


def test_lm_base_and_counts(spark):
    found = {r["doc_id"]: r for r in queries.op7_lm_score(spark, DATA).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    split = lambda t: t.encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(split(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in texts.items():
        r, w = found[i], split(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_lm_beats_the_base_on_held_out_texts(spark, size):
    held = queries.op7_lm_score(spark, f"/root/testdata/{size}").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_edges(spark):
    found = collected(lm_score.score_documents(awkward(spark), "doc_id IS NOT NULL AND doc_id <> 3", "doc_id = 4"))
    assert found[1][0]["n_tokens"] == 1 and found[1][0]["score"] == found[2][0]["score"] and len(found[5]) == 2
    assert found[3][0]["n_tokens"] == len(LONG.split()) + 1
    none = lm_score.score_documents(awkward(spark), "false", "false").collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}
    assert lm_score.score_documents(awkward(spark).limit(0), "true", "false").count() == 0


def test_probabilities_of_a_step_sum_to_one():
    code = lm_score.Code([3, 1, 4, 1, 5])
    tables = lm_score.Tables([np.random.default_rng(k).integers(0, 9, 2 << b) for k, b in enumerate(lm_score.WORD_TABLES)])
    scorer = lm_score.Scorer(code, lm_score.WORD_TABLES, tables, lm_score.starting_weights(4))
    total = 0.0
    for last in range(5):
        x = np.array([2, 3, 2, last])
        contexts = [c[3:] for c in lm_score.word_contexts(x, np.zeros(4, int))]
        total += 2 ** -float(scorer.fixed(x[3:], contexts)[0])
    assert abs(total - 1) < 1e-5


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_lm_scores_do_not_depend_on_partitions(spark, parts):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    score = lambda df: {r["doc_id"]: (r["score"], r["bits_per_byte"]) for r in lm_score.score_documents(df, "doc_id % 7 <> 2", "doc_id % 7 = 6").collect()}
    assert score(rows.repartition(parts, F.rand(parts))) == score(rows.coalesce(1).orderBy("doc_id"))


def slow_bits(scorer, x):
    """The bits of a text's symbols, one after another, and the weights refined after every step."""
    w = scorer.weights.astype(float)
    contexts = lm_score.word_contexts(x, np.zeros(len(x), int))
    total, seen = 0.0, []
    step = [k // 4 if k < 64 else 16 + (k - 64) // 16 if k < 320 else 32 + (k - 320) // 64 for k in range(len(x))]
    for k, symbol in enumerate(x):
        if k and step[k] != step[k - 1]:
            for gate in {g for g, _, _ in seen}:
                own = [(e, o) for g, e, o in seen if g == gate]
                w[gate] += lm_score.RATE * sum(e * o for e, o in own) / (len(own) + 100)
            seen = []
        code = scorer.code
        for j in range(code.start[symbol], code.start[symbol] + code.length[symbol]):
            found = []
            for n, (context, bits) in enumerate(zip(contexts, scorer.table_bits)):
                slot = int(code.node[j]) & (1 << bits) - 1
                if n:
                    mixed = (int(context[k]) + n + 1) * int(lm_score._A) % (1 << 64)
                    mixed ^= mixed >> 29
                    slot = ((mixed * int(lm_score._B) % (1 << 64) >> 32) + int(code.hashed[j])) % (1 << 32) >> 32 - bits
                found.append(int(scorer.tables.packed[n][slot]))
            odds = np.array([f >> 2 for f in found] + [0.3 * 512]) / 512
            gate, sign = (found[3] & 3) * 4 + (found[2] & 3), 1 - 2 * int(code.bit[j])
            odd = math.exp(sign * float(w[gate] @ odds))
            total += math.log2(1 + odd)
            seen.append((gate, -sign * odd / (1 + odd), odds))
    return total


def test_lm_against_a_slow_scorer():
    rng = np.random.default_rng(5)
    code = lm_score.Code(rng.integers(1, 99, 300).tolist())
    tables = lm_score.Tables([rng.integers(0, 9, 2 << b) * (rng.random(2 << b) < 0.7) for b in lm_score.WORD_TABLES])
    scorer = lm_score.Scorer(code, lm_score.WORD_TABLES, tables, lm_score.starting_weights(4))
    texts = [np.append(rng.integers(1, 300, n), 0) for n in (0, 1, 3, 4, 63, 64, 65, 320, 700)]
    length = np.array([len(t) for t in texts])
    x, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), length)
    start = np.repeat(np.cumsum(length) - length, length)
    found = scorer.refined(x, lm_score.word_contexts(x, start), text, np.arange(len(x)) - start, len(texts)) / lm_score.BIT_FRACTION
    for own, t in zip(found, texts):
        slow = slow_bits(scorer, t)
        assert abs(own - slow) < 1e-4 * max(1, slow)


def test_lm_endings_agree_with_sql(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "é".encode(), "naïveté".encode()]
    rows = spark.createDataFrame([(w,) for w in words], "word binary").selectExpr("word", f"crc32(substring(word, -{lm_score.ENDING_BYTES}, {lm_score.ENDING_BYTES})) % {lm_score.ENDINGS} AS e").collect()
    assert [r["e"] for r in rows] == lm_score.endings_of(pa.array(words)).tolist()


# --- 8 -------------------------------------------------------------------------


def slow_fingerprint(text, n=3):
    w = text.encode().lower().split()
    grams = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2) if h else 0


def classes(ids, prints, bits=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [slow_fingerprint(texts[i]) for i in ids]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_near_dedup(spark, DATA).collect()}
    assert found == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, classes(ids, prints))}


def test_simhash_edges(spark):
    found = collected(simhash.near_duplicates(awkward(spark)))
    assert {found[k][0]["component_id"] for k in (1, 2, 6)} == {1} and found[1][0]["fingerprint"] == "0" * 16
    assert len(found[5]) == 2 and found[5][0]["component_id"] == 4
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_trees_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(3)]
    values = sorted({int(b) for b in base} | set(near))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    got = components(simhash.links(df, 3, leaf_rows=40))
    roots = {r["node"]: r["root"] for r in got.collect()}
    want = classes(list(range(len(values))), values)
    groups = {}
    for k, v in enumerate(signed):
        groups.setdefault(want[k], set()).add(v[0])
    for g in groups.values():
        assert {roots.get(v, v) for v in g} == {min(g)}


def test_near_stage_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    first = [word() for _ in range(300)]
    near, other = [*first], [word() for _ in range(300)]
    near[150] = "changed"
    rows = [(9, " ".join(first)), (4, " ".join(near)), (7, " ".join(other)), (8, None), (3, ""), (None, "alone here"), (2, " ".join(first[:150]) + " " + " ".join(other[:150]))]
    kept = simhash.keep_one_of_near(docs(spark, rows).withColumn("_sha", F.lit(1)).withColumn("wide", F.lit(1)))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 7]


# --- 9 -------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(900):
        v = centres[k % 40] + rng.normal(size=16) * 0.25
        rows.append((k, [float(x) for x in v], k % 3 if k % 11 else None))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 15 + [None], 1), (905, [1.0] * 16, 2), (906, [2.0] * 16, 2), (907, [1.0, 0.0], 2), (0, rows[0][1], rows[0][2]), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row_no", F.lit("clash")).withColumn("unit", F.lit(1))
    old = embeddings.TILE
    embeddings.TILE = 64
    try:
        found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    finally:
        embeddings.TILE = old
    good = [(i, np.float32(v).astype(float), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None]
    n = len(good)
    linked = [[b for b in range(n) if b != a and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / math.sqrt((good[a][1] @ good[a][1]) * (good[b][1] @ good[b][1])) >= 0.93] for a in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *(label[b] for b in linked[a])]) for a in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for a in range(n):
        least[label[a]] = min(good[a][0], least.get(label[a], good[a][0]))
    want = [(good[a][0], len(linked[a]), least[label[a]], least[label[a]] == good[a][0]) for a in range(n)]
    ids = Counter(i for i, *_ in want)
    want += [(i, 0, i, True) for i, v, lab in rows if i not in ids]
    assert found == sorted(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- 10 ------------------------------------------------------------------------


def test_toxicity_query(spark):
    data = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = queries.op10_toxicity(spark, data).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    toxic = [r["score"] for r in held if labels[r["doc_id"]] == 1]
    clean = [r["score"] for r in held if labels[r["doc_id"]] == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) >= 0.8
    assert not any(r["predicted"] for r in held if labels[r["doc_id"]] == 0)


def taught(spark):
    rng = random.Random(3)
    plain = ["the", "cat", "went", "home", "with", "some", "bread", "and", "milk", "today", "house", "garden"]
    rows, marks = [], []
    for k in range(400):
        words = rng.choices(plain, k=12)
        if k % 4 == 0:
            words[3] = ("idiot", "loser")[k // 4 % 2]
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 4 == 0)))
    return toxicity.learn(docs(spark, rows), spark.createDataFrame(marks + [(1, None), (9999, 1)], "doc_id long, toxic int"))


def test_disguises_are_read(spark):
    judge = taught(spark)
    for shown, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot"), ("l0$er", "loser"), ("l*o*s*e*r", "loser"), ("h0me", "home")):
        assert toxicity.restore(shown, judge.model) == word
    rows = [(1, "the cat went home"), (2, "you 1d10t went home"), (3, "you l o s e r went home"), (4, None), (5, ""), (6, "LOOOSER today"), (6, "LOOOSER today"), (7, LONG), (None, "idiot")]
    found = collected(toxicity.score_documents(docs(spark, rows).withColumn("score", F.lit("clash")), judge))
    assert {k: v[0]["predicted"] for k, v in found.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, None: 1}
    assert len(found[6]) == 2
    clean = toxicity.keep_clean(docs(spark, rows), judge)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 4, 5, 7]
    assert toxicity.score_documents(docs(spark, []).limit(0), judge).count() == 0


def every_reading(token, model):
    """All readings of a short token with their log probabilities, one by one, as the lattice offers them."""
    t = toxicity
    open_, done = [(0, t.EDGE * 2, 0.0, "")], []
    while open_:
        at, state, score, text = open_.pop()
        if at == len(token):
            done.append((score + model.log[state][t.EDGE], text))
            continue
        c, letters = token[at], t.STANDS_FOR.get(token[at], "")
        run = len(token[: at + 1]) - len(token[: at + 1].rstrip(c))
        offers = [(len(x), y, y, t.DRAWN) for x, y in t.DRAWN_AS.items() if token.startswith(x, at)]
        if c.isalpha():
            offers += [(1, c if "a" <= c <= "z" else t.OTHER, c, 0.0)] + [(1, "", "", t.REPEAT)] * (run > 1)
        else:
            offers += [(1, x, x, t.SIGN) for x in letters] + [(1, t.SIGN_KEPT, " ", t.KEPT)]
            if run > 1:
                offers.append((1, "", "", t.SIGN_TWICE if letters and run == 2 and token[at + 1 : at + 2] != c else t.SEPARATOR))
            elif c in t.SEPARATORS:
                offers.append((1, "", "", t.SIGN_AS_SEPARATOR if letters else t.SEPARATOR))
            if c in t.SEPARATORS:
                offers.append((1, t.EDGE, " ", t.SIGN_AS_SEPARATOR if letters else t.SEPARATOR))
        for length, kind, shown, gain in offers:
            new = t.EDGE * 2 if kind == t.EDGE else state[1] + kind if kind else state
            open_.append((at + length, new, score + gain + (model.log[state][kind] if kind else 0.0), text + shown))
    return done


def test_the_lattice_finds_the_likeliest_of_all_readings():
    words = "where hate fool word idiot asshole kind hello the cat went home whole loser who"
    model = toxicity.CharacterModel(Counter(g for w in words.split() * 5 for g in toxicity.CharacterModel.grams(w)))
    for shown, word in (("\\/\\/here", "where"), ("|-|ate", "hate"), ("ph00l", "fool"), ("vv0rd", "word"), ("!d!0t", "idiot"), ("a55hole", "asshole"), ("|<ind", "kind"), ("he1l()", "hello")):
        assert toxicity.disguised(shown) and toxicity.restore(shown, model) == word
    rng = random.Random(9)
    for _ in range(300):
        token = "".join(rng.choice(["|-|", "\\/", "()", "vv", "ph", "!", "5", "0", "a", "h", "o", "w", "|", ".", "é"]) for _ in range(rng.randint(1, 5)))
        readings = every_reading(token, model)
        best = max(score for score, _ in readings)
        assert toxicity.restore(token, model) in {text for score, text in readings if score > best - 1e-9}, token


def test_settling_a_long_token_changes_nothing(monkeypatch):
    model = toxicity.CharacterModel(Counter(g for w in ("where", "hate", "fool") * 5 for g in toxicity.CharacterModel.grams(w)))
    token = "\\/\\/here.|-|ate!ph00l|\\|" * 40
    monkeypatch.setattr(toxicity, "SETTLE", 1 << 40)
    whole = toxicity.restore(token, model)
    for settle in (1, 2, 3, 5, 256):
        monkeypatch.setattr(toxicity, "SETTLE", settle)
        assert toxicity.restore(token, model) == whole


def test_nothing_to_learn_from(spark):
    judge = toxicity.learn(docs(spark, [(1, "x")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_documents(docs(spark, [(1, "x")]), judge).collect()] == [0]


def test_no_labels_of_one_kind(spark):
    judge = toxicity.learn(docs(spark, [(1, "x y"), (2, "z")]), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.7 for r in toxicity.score_documents(awkward(spark), judge).collect())


def test_tokens_of_any_length_are_decoded(spark):
    judge = taught(spark)
    for letters in (24, 25, 400):
        run = " ".join("home" * (letters // 4) + "loser")
        assert "loser" in toxicity.restore(toxicity.readings("go " + run)[-1], judge.model)
        assert toxicity.score_documents(docs(spark, [(1, "the cat went " + run)]), judge).first()["predicted"] == 1
    assert toxicity.restore("the.cat.went.h0me", judge.model).split() == ["the", "cat", "went", "home"]
    for token in ("1a" * 3000, "a" * 100_000, "." * 100_000, "a.b" * 3000):
        assert isinstance(toxicity.token_features(token, judge.model), list)
