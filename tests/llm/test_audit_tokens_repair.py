"""Operators 11 to 13 against brute force and the library, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_pieces, conversation, divergence, queries

DATA = "/root/testdata/sf0.001"
CLASHING = ("term", "n", "total", "once", "pos", "p", "item", "value", "rank", "ids", "kind", "copy", "digest", "has_turn", "fault", "first", "ways", "audit")


def with_clashes(df):
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- 11 ------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def audited(rows, least, top=50):
    """The audit over every group and every kept term, as sorted tuples."""
    rows = [tuple(x or "" for x in r) for r in rows]
    plain = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    found = []
    for lang in {r[1] for r in rows}:
        own = [(plain(t), s) for t, name, s in rows if name == lang]
        in_docs = Counter(w for words, _ in own for w in set(words))
        kept = sorted(w for w, n in in_docs.items() if n >= least)
        of = {s: Counter(w for words, t in own if t == s for w in words if w in kept) for s in {s for _, s in own}}
        whole = sum(of.values(), Counter())
        price = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q, prices = price(whole), {s: price(c) for s, c in of.items()}
        for s, p in prices.items():
            pairs = [(sum(abs(p[w] - other[w]) for w in kept), t) for t, other in prices.items() if t != s]
            terms = [(p[w] - q[w], w) for w in kept if of[s][w] and p[w] > q[w]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                found += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(values[:most], 1)]
    return sorted(found)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "The", "ÜBER", "über", "naïve", "x1y", "中文", "😀", "a-b", "__", "q" * 300, "don't"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None, ""])) for _ in range(120)]
    rows += [(None, "en", "no text"), ("", "en", "no text"), ("!!! 12", "fr", "only signs"), (" ".join(["long"] * 50_000), "en", "s1")] + [("same text", "en", "copies")] * 40
    df = with_clashes(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS))
    for least, top in ((1, 50), (5, 3), (30, 50), (10_000, 50)):
        assert audit_rows(divergence.audit_sources(df, least, top)) == audited(rows, least, top)
        assert audit_rows(divergence.audit_sources(df.repartition(7), least, top)) == audited(rows, least, top)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_prices_of_large_counts_are_exact(spark):
    count, total, terms = 10**13 + 7, 10**15 + 3, 123_457
    row = spark.range(1).select(divergence.price(F.lit(count), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


# --- 12 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return byte_pieces.coder(byte_pieces.default_ranks(), byte_pieces.default_pattern())


def test_parts_do_not_change_ids(coder):
    rng = random.Random(12)
    signs = [*" \n\t'stdrelvm09.!?-é中 　\x1c\x85᠎Ab²½٣", "'ll", "'re", "    ", "\r\n"]
    for _ in range(2_000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        want = coder.split.encode_ordinary(text)
        for least, blank in itertools.product((1, 4), (2, 3, 9)):
            got = [i for part, whole in byte_pieces.parts(text, least, blank) for i in (coder.whole if whole else coder.split).encode_ordinary(part)]
            assert got == want, text


def test_very_long_texts(coder):
    for text in ("a" * 300_000, " " * 500_000 + "x", "x" + "\n" * 500_000, "ab1!" * 100_000, "word " * 100_000, "中" * 200_000):
        ids = [i for part in coder.encode(text) for i in part]
        assert coder.decode(ids) == text.encode()


def test_byte_pieces_of_a_table(spark, coder):
    rows = [(1, None), (2, ""), (3, "It's <|endoftext|> naïve 中文 😀"), (3, "It's <|endoftext|> naïve 中文 😀"), (None, "no id"), (4, "The long text goes on. " * 20_000), (5, "\x00\n\n  x")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    encoded = byte_pieces.encode_documents(df, with_ids=True)
    want = []
    for key, text in rows:
        ids = coder.split.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, encoded.collect()), key=repr) == sorted(want, key=repr)
    back = byte_pieces.decode_documents(encoded)
    assert sorted((bytes(r["decoded"]) for r in back.collect())) == sorted((t or "").encode() for _, t in rows)
    assert byte_pieces.encode_documents(df.limit(0)).collect() == []


def test_byte_pieces_query(spark, coder):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op12_byte_bpe(spark, DATA).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = coder.split.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# --- 13 ------------------------------------------------------------------------


def cheapest(turns):
    """Cost and audit by trying every edit of every turn with up to two insertions before each and at the end."""
    best = None
    edits = [[("K", 0), ("R", 2), ("D", 3)]] * len(turns)
    for chosen in itertools.product(*edits):
        for inserts in itertools.product(range(3), repeat=len(turns) + 1):
            cost, audit, roles, possible = 2 * sum(inserts), "", "", True
            for k, (turn, (edit, price)) in enumerate(zip(turns, chosen)):
                audit += "I" * inserts[k] + edit
                roles += "?" * inserts[k] + {"K": turn.initial or "!", "R": "?", "D": ""}[edit]
                cost += price + (edit != "D" and turn.fault == "truncated")
                possible &= edit == "D" or turn.fault not in ("blank", "duplicate")
            roles, audit = roles + "?" * inserts[-1], audit + "I" * inserts[-1]
            if possible and (not roles or re.fullmatch(r"s?([u?][a?])+", roles)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def some_turns(rng, n):
    return [conversation.Turn(rng.choice(["s", "u", "a", "u", "a", "t", " ", ""]), rng.choice(["none", "none", "none", "truncated", "blank", "duplicate"])) for _ in range(n)]


def test_repair_is_cheapest():
    rng = random.Random(13)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(60):
            turns = some_turns(rng, n)
            assert conversation.chained([{conversation.NONE: conversation.priced(turns, conversation.NONE)}]) == cheapest(turns), turns


def test_segments_join_to_the_whole():
    rng = random.Random(14)
    for _ in range(300):
        turns = some_turns(rng, rng.randint(0, 60))
        cuts = sorted(rng.choices(range(len(turns) + 1), k=rng.randint(0, 5)))
        pieces = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        whole = conversation.chained([{conversation.NONE: conversation.priced(turns, conversation.NONE)}])
        assert conversation.chained([{q: conversation.priced(p, q) for q in range(4)} for p in pieces]) == whole


def repaired(rows, damage):
    """The whole contract on lists, with the cheapest edits found turn by turn on strings."""
    found = {key: [] for key, *_ in rows}
    for key, turn, role, text in rows:
        role, text, show = role if role is not None else " ", text if text is not None else " ", lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(key)}:{show(turn)}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[key] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for key, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
            seen.add((role, text))
        after = {"u": "a"}
        ways = {"": (0, "", [])}
        for (_, role, text), fault in zip(kept, faults):
            cands = []
            starts = [(c, a, q, d) for q, (c, a, d) in ways.items()]
            starts += [(c + 2, a + "I", after.get(q, "u"), [*d, {"u": "user:", "a": "assistant:"}[after.get(q, "u")]]) for c, a, q, d in starts]
            for c, a, q, d in starts:
                cands.append((c + 3, a + "D", q, d))
                if fault in ("blank", "duplicate"):
                    continue
                late, follows = fault == "truncated", after.get(q, "u")
                if role[:1] == follows or (role[:1] == "s" and q == ""):
                    cands.append((c + late, a + "K", role[:1], [*d, f"{role}:{text}"]))
                cands.append((c + 2 + late, a + "R", follows, [*d, ("user:" if follows == "u" else "assistant:") + text]))
            ways = {q: min((c, a, d) for c, a, r, d in cands if r == q) for q in {x[2] for x in cands}}
        end = {"": (0, "", []), "a": (0, "", []), "u": (2, "I", ["assistant:"]), "s": (4, "II", ["user:", "assistant:"])}
        cost, audit, done = min((c + end[q][0], a + end[q][1], d + end[q][2]) for q, (c, a, d) in ways.items())
        turns, initials = [t for t, _, _ in kept if t is not None], [r[:1] for _, r, _ in kept]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((key, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


def repair_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark):
    rng = random.Random(15)
    texts = ["Yes.", "Yes. \n", "no end", "", " \t", None, "Why?", "x" * 5_000 + "!", "ü.", "a\nb."]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "umpire"]
    rows = [(rng.choice([*range(12), None]), rng.choice([*range(9), None, 40, -3]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(1_500)] + [(101, 5, "user", "again.")] * 300 + rows[:20]
    df = with_clashes(spark.createDataFrame(rows, CONVERSATIONS))
    for damage in (False, True):
        assert repair_rows(conversation.repair_conversations(df, damage)) == repaired(rows, damage)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:  # The long conversation is dealt to several tasks.
        assert repair_rows(conversation.repair_conversations(df, True)) == repaired(rows, True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_empty_tables(spark):
    assert conversation.repair_conversations(spark.createDataFrame([], CONVERSATIONS), True).collect() == []
    dropped = next(k for k in range(1_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = conversation.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONVERSATIONS), True).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- 10: what is learned does not depend on how the tables are dealt


def test_toxicity_does_not_depend_on_the_partitioning(spark):
    from tessera.llm import toxicity

    rng = random.Random(10)
    plain = ["the", "cat", "went", "home", "with", "bread", "milk", "today"]
    texts = [" ".join(rng.choices(plain, k=8)) + (" idiot" if k % 3 == 0 else "") for k in range(90)]
    rows = [(k, texts[k % 60]) for k in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int((k % 60) % 3 == 0)) for k in range(180)], "doc_id long, toxic int")
    found = []
    for parts in (1, 7):
        dealt = docs.repartition(parts, F.xxhash64("doc_id", F.lit(parts)))
        judge = toxicity.learn(dealt, labels.repartition(parts + 1))
        found.append(sorted(tuple(r) for r in toxicity.score_documents(dealt, judge).collect()))
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, DATA).select(want.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)
