"""Small tests against brute force."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from meshloom.llm import decontaminate, mixing, neardup, pii

DOCS = "doc_id long, text string, source string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    base = " ".join(f"word{i}" for i in range(120))
    texts = [base, base + " more", base.upper(), "other text of few words", None, "", "a b", "É x É y É"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in want]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (want[i] ^ want[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i].component_id for i in range(len(texts))] == root


def test_contamination_plans_agree(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "start " + item.upper() + " end", "s"), (2, None, "s"), (3, "w1 w2 w3", "s"), (4, "Tiny Item!", "s")], DOCS)
    bench = spark.createDataFrame([("b", item), ("t", "tiny item"), ("n", None)], "item_id string, text string")
    rows = []
    for most in (1000, 0):
        found = decontaminate.decontaminate(docs, bench, max_index_words=most)
        rows.append(sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in found.collect()))
    assert rows[0] == rows[1] == [(1, 22, 20, ("b",), True), (2, 0, 0, (), False), (3, 3, 0, (), False), (4, 2, 2, ("t",), True)]


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(900)], DOCS)
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 14 and r.most <= 3 for r in rows)


def test_base_spans(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now, 10.0.0.1 and 4111 1111 1111 1111, +49 30 1234567", "s"), (2, None, "s")], DOCS)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs).collect()}
    text = "mail a.b@c.de now, 10.0.0.1 and 4111 1111 1111 1111, +49 30 1234567"
    for kind, piece in (("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 30 1234567")):
        assert (kind, text.index(piece), text.index(piece) + len(piece)) in got[1]
    assert got[2] == []


def test_patterns_do_not_depend_on_other_documents(spark):
    """Six values after a sure pattern are found beside 14,500 other numbers, too."""
    keys = [f"AKIA{'ABCDEFGH1234567'}{i}" for i in range(5)] + ["zz99999999"]
    few = [(i, f"my key : {k} end", "s") for i, k in enumerate(keys)]
    many = [(100 + i, " ".join(f"number {1000000 + 500 * i + j}" for j in range(500)), "s") for i in range(29)]
    for rows in (few, few + many):
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, DOCS)).collect()}
        for i, k in enumerate(keys):
            assert ("context", 9, 9 + len(k)) in got[i]
        assert all(not got[i] for i in got if i >= 100)


def test_context_spans_of_any_form(spark):
    """Identifiers with separators, short ones, and ones far behind their two lexemes are found; numbers elsewhere are not."""
    mails = [f"code : u{chr(97 + i)}@h.org is known" for i in range(8)]
    forms = ["123-45-6789", "DE89 3704 0044 0532 0130 00", "7", "x/2024/15", "AB_12"]
    rows = [*mails, *[f"code : {f}, thanks" for f in forms], "code" + " " * 300 + ":" + " " * 20_000 + "4711 end", "room 12 of 30", "word" * 30 + " : 55"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: [t for t in (rows[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "context")] for r in pii.find(docs).collect()}
    assert [got[8 + i] for i in range(5)] == [[f] for f in forms] and got[13] == ["4711"]
    assert all(not got[i] for i in (*range(8), 14, 15))


def brute_base(text):
    """Base spans by the contract's patterns."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def test_base_spans_against_patterns(spark):
    rng, parts = random.Random(7), ["a.b@c.de", "x@y", "@", "10.0.0.1", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1 (2)", ".", "-", " ", "é𝄞", "word", "7", "+", "5500 0000 0000 0004", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))), "s") for i in range(600)] + [(600, "z@q.org 1.1.1.1 " * 3000, "s"), (601, "9" * 50_000, "s")]
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind != "context"] for r in pii.find(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, _ in rows:
        assert got[i] == brute_base(text), text[:200]
