"""Exact parts of the learned operators against brute force."""

import re
from collections import Counter

import numpy as np

from meshloom.llm import quality, toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    n_terms, share = 300, 1 / np.arange(1, 301)
    vectors = []
    for _ in range(500):
        n = rng.integers(0, 12)
        t, x = np.sort(rng.choice(n_terms, n, replace=False, p=share / share.sum())), rng.integers(1, 4, n).astype(float)
        vectors.append((t, x / np.sqrt((x**2).sum()) if n else x))
    index, dense = toxicity.BlockMaxIndex(vectors, n_terms), np.zeros((500, n_terms))
    for i, (t, x) in enumerate(vectors):
        dense[i, t] = x
    for i, vector in enumerate(vectors):
        for leave in (-1, i):
            rows, scores = index.nearest(*vector, 15, leave)
            cosine = dense @ dense[i]
            if leave >= 0:
                cosine[leave] = 0
            assert np.allclose(scores, np.sort(cosine[cosine > 1e-12])[::-1][:15])
            assert np.allclose(cosine[rows], scores)


def brute_statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_many_searches_at_once_are_exact(monkeypatch):
    """Batches of vectors, whole or split, give what all cosines give; copies tie by number; a block is read once or twice for all of them."""
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(150):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        x = rng.integers(1, 4, len(t)).astype(float)
        vectors += [(t, x / np.sqrt((x**2).sum()) if len(t) else x)] * rng.integers(1, 5)
    vectors = [vectors[i] for i in rng.permutation(len(vectors))]
    index, dense, calls, ranges = toxicity.BlockMaxIndex(vectors, 60), np.zeros((len(vectors), 60)), [], toxicity._ranges
    for i, (t, x) in enumerate(vectors):
        dense[i, t] = x
    monkeypatch.setattr(toxicity, "_ranges", lambda *a: calls.append(1) or ranges(*a))
    for k, at_once in ((15, 1 << 21), (15, 700), (100, 1 << 21)):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        calls.clear()
        found = index.search(vectors, k)
        assert len(found) == len(vectors) and (at_once == 700 or len(calls) < 6 * index.blocks)
        for v, (rows, scores) in zip(dense, found, strict=True):
            cosine = np.cumsum(dense * v, axis=1)[:, -1]
            want = [i for i in np.lexsort((np.arange(len(cosine)), -cosine))[:k] if cosine[i] > 0]
            assert rows.tolist() == want and scores.tolist() == cosine[want].tolist()


def test_quality_statistics(spark):
    run = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \n\t", "a b c", f"{run} x {run}", "so " * 40, f"{run}\n{run}\n\n \n{run} # é𝄞 <b>", "one\ntwo\none\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])


def test_judge_without_labels(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, None), (3, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality.judge(docs, labels)
    assert rules == [] and {r.doc_id: r.kept for r in judged.collect()} == {1: True, 2: False, 3: False}


def test_toxicity_learns_from_rare_words(spark):
    """Each toxic word is in 3 of 144 examples, too few for a high G2; together they tell."""
    rng = np.random.default_rng(3)
    plain, bad = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)], [f"{chr(97 + i)}{chr(105 + i)}zzq" for i in range(14)]
    text = lambda more: " ".join([*rng.choice(plain, 10, replace=False), *more])
    rows = [(i, text([]), 0) for i in range(130)] + [(200 + i, text([bad[(i + j) % 14] for j in range(3)]), 1) for i in range(14)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    docs = spark.createDataFrame([(1, text([bad[2], bad[9]])), (2, text([bad[5], bad[12]])), (3, text([])), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert got[1] >= 0.5 and got[2] >= 0.5 and got[3] < 0.5 and got[4] < 0.5


def test_toxicity_without_examples(spark):
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert toxicity.score(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), model).first().toxicity == 0.5


def planted(spark, n=4000):
    """Poor are texts of many symbols and many capitals together, and those of very short lines; 1 in 50 labels is wrong."""
    rng = np.random.default_rng(5)
    x = rng.random((n, len(quality.FEATURES)))
    at = {f: i for i, f in enumerate(quality.FEATURES)}
    poor = ((x[:, at["symbol_share"]] > 0.7) & (x[:, at["upper_share"]] > 0.6)) | (x[:, at["line_words"]] < 0.1)
    label = poor ^ (rng.random(n) < 0.02)
    names = ", ".join(f"{f} double" for f in quality.FEATURES)
    rows = [(*map(float, r), int(p), bool(i % 2)) for i, (r, p) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, f"{names}, poor int, grow boolean"), x, poor


def test_decision_list_learns_planted_rules(spark):
    examples, x, poor = planted(spark)
    rules = quality.learn(examples)
    assert len(rules) >= 2 and any({c.feature for c in r} >= {"symbol_share", "upper_share"} for r in rules)
    at = {f: i for i, f in enumerate(quality.FEATURES)}
    got = np.zeros(len(x), bool)
    for r in rules:
        hold = np.ones(len(x), bool)
        for c in r:
            hold &= (x[:, at[c.feature]] > c.cut) == c.above
        got |= hold
    assert (got & poor).sum() >= 0.9 * poor.sum() and (got & ~poor).sum() <= 0.02 * len(x)
    told = examples.select(quality.verdict(rules).alias("v")).collect()
    assert [r.v > 0 for r in told] == got.tolist()


def test_best_condition_against_brute_force(spark):
    examples, x, _ = planted(spark, 200)
    y = np.array([r.poor for r in examples.select("poor").collect()])
    best, p, g = quality._best(examples, int(y.sum()), int((1 - y).sum()))
    base, top = np.log2(y.mean()), 0.0
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[:-1] + v[1:]) / 2:
            for hold in (x[:, f] <= cut, x[:, f] > cut):
                a, b = y[hold].sum(), (1 - y)[hold].sum()
                if a >= quality.MIN_COVER and b < (1 - y).sum():
                    top = max(top, a * (np.log2(a / (a + b)) - base))
    assert abs(p * (np.log2(p / (p + g)) - base) - top) < 1e-9
    hold = (x[:, quality.FEATURES.index(best.feature)] > best.cut) == best.above
    assert (y[hold].sum(), (1 - y)[hold].sum()) == (p, g)


def test_toxicity_scores_are_votes_of_all_examples(spark):
    """Every score against the cosines with all examples, one by one; the text bound leaves examples out in the order of the hash."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words[:150] if i % 3 else words[50:], 30))) for i in range(300)] + [(900, ""), (901, None), (902, "unknown things"), (903, "word1 " * 5000), (903, "word1 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(5, None), (None, 1)], "doc_id long, label int")
    picked = toxicity.pick(docs, labels)
    assert picked.count() == 240 and 0 < toxicity.pick(docs, labels, max_bytes=10_000).count() < 60 and toxicity.pick(docs, labels, max_examples=7).count() == 7
    model = toxicity.fit(picked)
    text = dict(rows)
    examples = model.vocabulary.vectors([text[int(i)].encode() for i in model.ids])
    dense = np.zeros((len(examples), len(model.vocabulary.terms)))
    for i, (t, x) in enumerate(examples):
        dense[i, t] = x
    for r in toxicity.score(docs.withColumn("Toxicity", docs.doc_id), model).collect():
        t, x = model.vocabulary.vectors([(r.text or "").encode()])[0]
        cosine = dense[:, t] @ x if len(t) else np.zeros(len(dense))
        best = [i for i in np.lexsort((np.arange(len(cosine)), -cosine))[: toxicity.NEIGHBOURS] if cosine[i] > 0]
        share = (float((cosine[best] * model.labels[best]).sum()) + model.prior) / (float(cosine[best].sum()) + 1)
        assert abs(r.toxicity - model.calibrated(share)) < 1e-9
    nothing = toxicity.fit(toxicity.pick(docs.limit(0), labels))
    assert {r.toxicity for r in toxicity.score(docs, nothing).collect()} == {0.5}
