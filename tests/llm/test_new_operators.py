"""Operators 11 to 13 against brute force, through every path: several blocks, chunks and cells."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import minhash, repair, runs

# ---- periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdef"[: rng.choice([1, 2, 3, 6])]
        w = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        p = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        yield w + (p * rng.randint(2, 8))[: rng.randint(1, 60)] + [rng.choice(letters) for _ in range(rng.randint(0, 9))]


def test_runs_against_brute_force():
    words = list(periodic_texts(800, 3))
    found = runs.search([" ".join(w).encode() for w in words])
    assert any(len(r) > 1 for _, r, _ in found)
    for w, (n, got, collapsed) in zip(words, found, strict=True):
        want = brute_runs(w)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert n == len(w) and got == want and collapsed.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_compare_words_where_a_hash_lies(monkeypatch):
    """With a hash that calls everything equal, the direct comparison gives the same runs."""

    class Liar(runs.Rolling):
        def spans(self, start, end):
            return np.zeros(len(start), np.uint64)

    words = list(periodic_texts(60, 4))
    texts = [" ".join(w).encode() for w in words]
    want = runs.search(texts)
    monkeypatch.setattr(runs, "Rolling", Liar)
    assert [r for _, r, _ in runs.search(texts)] == [r for _, r, _ in want]


def test_runs_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "so " * 7), (4, "so " * 7), (None, "a\x0bb\x0c" * 5), (6, "x y " * 3), (7, "é ü " * 100_000), (8, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("RUNS", F.lit(1)).withColumn("n_words", F.lit(1))
    out = runs.find_runs(docs)
    assert set(out.columns) == {"doc_id", "text", "n_words", "runs", "collapsed"}
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got.count((4, 7, [(0, 7, 1)], "so")) == 2 and (None, 10, [(0, 10, 2)], "a b") in got and (7, 200_000, [(0, 200_000, 2)], "é ü") in got
    assert (1, 0, [], "") in got and (2, 0, [], "") in got and (3, 0, [], "") in got and (6, 3, [], "x y x y x y") in got
    assert runs.find_runs(docs.limit(0)).collect() == [] and runs.planted(docs.select("doc_id", "text")).count() == len(rows)


# ---- conversation repair


def brute_repair(turns):
    """Dijkstra over (turn, state) with audits; turns in order."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append((role, text, fault))
    step = {("s", ""): "s", ("u", ""): "su", ("u", "s"): "su", ("u", "a"): "ua", ("a", "u"): "ua"}
    states = {"": (0, "", ())}

    def closed(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, lines) in list(out.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if (x, s) in step and (x not in out or (cost + 3, audit + "I") < out[x][:2]):
                        out[x] = (cost + 3, audit + "I", (*lines, f"{role}:"))
        return out

    for role, text, fault in kinds:
        new = {}

        def put(s, value, new=new):
            if s not in new or value[:2] < new[s][:2]:
                new[s] = value

        for s, (cost, audit, lines) in closed(states).items():
            put(s, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (role[:1], s) in step:
                    put(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (x, s) in step:
                        put(x, (cost + 3 + more, audit + "R", (*lines, f"{name}:{text}")))
        states = new
    ends = closed(states)
    cost, audit, lines = min((ends[s] for s in ("", "a") if s in ends), key=lambda e: e[:2])
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}, lines


def conversations(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 3, 8, 30, 200])):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None])
            text = rng.choice(["", " ", "ok.", f"said {turn}.", f"cut {turn}", f"well {rng.random()}! ", None, "x?"])
            rows += [(c, rng.choice([turn, turn, turn, turn + 1, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def in_order(rows):
    fixed = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(fixed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


@pytest.mark.parametrize(("block", "fan"), [(4096, 32), (7, 2), (1, 3)])
def test_repair_against_brute_force(spark, block, fan):
    rows = conversations(block)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("CONV", F.lit(1))
    lonely = spark.createDataFrame([(1,), (None,), (999,)], "conv_id long").unionByName(table.select("conv_id"))
    want = {c: brute_repair([r[1:] for r in own]) for c, own in itertools.groupby(in_order(rows), key=lambda r: r[0])}
    want[999] = ({"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}, ())
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.repair(table, lonely, block=block, fan=fan).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    lines = {}
    for r in repair.repaired_turns(table, block=block, fan=fan).orderBy("conv_id", "pos").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: tuple(x) for c, x in lines.items()} == {c: w for c, (_, w) in want.items() if w}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert repair.repair(empty, empty).collect() == [] and repair.repaired_turns(empty).collect() == []
    (row,) = repair.repair(spark.createDataFrame([(1, 0, "user", "w " * 3_000_000 + "!")], empty.schema)).collect()
    assert (row.cost, row.audit) == (3, "KI")


def test_min_plus_product_is_associative():
    rng = random.Random(8)
    for _ in range(200):
        kinds = "".join(rng.choice("xsSuUaAoO") for _ in range(rng.randint(3, 12)))
        i, j = sorted(rng.sample(range(len(kinds) + 1), 2))
        parts = [repair.scan(k) for k in (kinds[:i], kinds[i:j], kinds[j:])]
        a = repair.product(repair.product(parts[0], parts[1]), parts[2])
        assert a == repair.product(parts[0], repair.product(parts[1], parts[2])) and repair.cheapest(a) == repair.cheapest(repair.scan(kinds))


# ---- MinHash


def copies(seed=1):
    """Families of near copies, of which some reach one another only by others, beside single texts."""
    rng, texts = random.Random(seed), []
    word = lambda: f"w{rng.randrange(5000)}"
    for size in (1, 2, 3, 40, 120):
        for _ in range(3):
            base = [word() for _ in range(rng.randint(20, 150))]
            for _ in range(size):
                own = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 3])):
                    own[rng.randrange(len(own))] = word()
                texts.append(" ".join(own))
                if rng.random() < 0.2:  # a chain: the next copies are made of this one
                    base = own
    return texts


def brute_components(texts, words=5, percent=85):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("chunk", [1 << 20, 2000])
def test_minhash_against_all_pairs(spark, chunk):
    """With small chunks, leaders and their stars are dealt out over many cells."""
    texts = copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, chunk=chunk).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_minhash_edges(spark):
    long = " ".join(f"l{i}" for i in range(150_000))
    rows = [(5, None), (6, ""), (7, " \t"), (1, "A b"), (2, "a B"), (2, "a b"), (None, "a b"), (None, "q r s"), (3, long), (4, long + " end"), (8, "ÀB c d e f g"), (9, "àB c d e f g"), (10, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("K1", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (None, 1, 1, False), (None, 1, None, True), (3, 149_996, 3, True), (4, 149_997, 3, False), (8, 2, 8, True), (9, 2, 9, True), (10, 1, 1, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_texts_without_ids_and_shared_ids(spark):
    """Near copies without ids are verified, too; of rows that share an id each stands for its own text."""
    base = [f"v{i}" for i in range(100)]
    other = [f"o{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (None, " ".join([*base, "x"])), (1, " ".join(other)), (1, " ".join([*base, "y"])), (0, " ".join([*other, "z"]))]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 96, 1), (-1, 97, 1), (0, 97, 0), (1, 96, 0), (1, 97, 1)]


def test_sketches_are_filled_and_concentrated():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 3000):
        sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for _ in range(3)]
        assert (minhash.sketches(sets) != np.iinfo(np.uint64).max).all()
    shared, error = rng.integers(0, 1 << 62, 900).astype(np.uint64), []
    for _ in range(40):
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 1 << 62, 50).astype(np.uint64)))) for _ in range(2))
        s = minhash.sketches([a, b])
        error.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.03
