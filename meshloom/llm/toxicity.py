"""Toxicity by the nearest labelled examples.

Terms are words and the first 4 to 6 letters of longer words. The vocabulary is the terms whose presence
depends on the label by a least log-likelihood ratio G2 over a least number of examples. Which of `SELECTIONS`
(the last of which keeps every term) is taken is decided on one example in HELD_OUT, which neither G2 nor
the index has seen. A text is its TF-IDF vector over the terms. Neighbours are found by exact cosine over a
block-max inverted index: examples lie in blocks, each term keeps its largest weight in each block, and blocks are
searched from the highest bound on until no other bound reaches the k-th best. Votes are weighted by cosine, and
vote shares are mapped to observed rates by a monotone curve from the votes on the held-out examples; then the
vocabulary and the index are made of all examples.

Labels are learned from at most `EXAMPLES` labelled documents with at most `EXAMPLE_BYTES` of text together (those with the
smallest hash of their id), which bounds the broadcast index. All documents are scored, over their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, materialize, text_chunks, without
from .hashing import Rolling, mix
from .langid import Words

EXAMPLES, EXAMPLE_BYTES = 20_000, 64 << 20
#: (least G2, least examples) of a term, each looser than the one before; the last is tried only if the one before it is best.
SELECTIONS = ((15.0, 4), (10.0, 2), (7.0, 2), (5.0, 2), (4.0, 2), (3.0, 2), (0.0, 1))
#: One example in so many judges the selections.
HELD_OUT = 8
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: Blocks of highest bound that are searched before the others are ruled out; numbers in a working array.
FIRST, AT_ONCE = 4, 1 << 21
BINS = 20
EVIDENCE = 3


def doc_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of every term occurrence in a batch of texts."""
    w = Words(texts)
    rolling = Rolling(w.symbols)
    doc = np.repeat(np.arange(len(texts)), w.last - w.first)
    docs, terms = [doc], [rolling.spans(w.start, w.end)]
    for n in PREFIXES:
        long = w.end - w.start > n
        docs.append(doc[long])
        terms.append(mix(rolling.spans(w.start[long], w.start[long] + n) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(terms)


class Vocabulary:
    def __init__(self, terms: np.ndarray, docs: np.ndarray, n: int):
        order = np.argsort(terms)
        self.terms = terms[order]
        self.idf = np.log((n + 1) / (docs[order] + 1)) + 1
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(term numbers, unit weights) of each text; empty ones where no term is known."""
        doc, term = doc_terms(texts)
        live = self.maybe[(term >> np.uint64(44)).astype(np.int64)]
        doc, term = doc[live], term[live]
        empty = (np.zeros(0, np.int64), np.zeros(0))
        if not len(term) or not len(self.terms):
            return [empty] * len(texts)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        live = self.terms[at] == term
        pair, tf = np.unique(doc[live] * len(self.terms) + at[live], return_counts=True)
        d, t = pair // len(self.terms), pair % len(self.terms)
        weight = (1 + np.log(tf)) * self.idf[t]
        cut = np.searchsorted(d, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out.append((t[a:b], weight[a:b] / np.sqrt((weight[a:b] ** 2).sum())) if b > a else empty)
        return out


class BlockMaxIndex:
    """Unit vectors by block of BLOCK vectors and term, with the largest weight of each term in each block.

    Vectors with the same heaviest terms lie side by side, which keeps the bounds of other blocks low.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.blocks, self.n_terms = len(vectors), max(1, -(-len(vectors) // BLOCK)), max(1, n_terms)
        heavy = np.array([int(t[x.argmax()]) if len(t) else n_terms for t, x in vectors], np.int64)
        self.row = np.argsort(heavy, kind="stable")  # the vector at each place
        size = [len(vectors[r][0]) for r in self.row]
        term = np.concatenate([vectors[r][0] for r in self.row] + [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[r][1] for r in self.row] + [np.zeros(0)])
        place = np.repeat(np.arange(self.n), size)
        cell = place // BLOCK * self.n_terms + term  # a cell is a term in a block that holds it
        order = np.argsort(cell, kind="stable")
        self.slot, self.weight, cell = (place % BLOCK).astype(np.uint8)[order], weight[order], cell[order]
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)])
        cell = cell[start]
        self.at = np.append(start, len(term)).astype(np.int32)
        self.term = (cell % self.n_terms).astype(np.int32)
        self.cells = np.searchsorted(cell, np.arange(self.blocks + 1) * self.n_terms).astype(np.int32)
        top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.top = np.nextafter(top.astype(np.float32), np.float32(2))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k vectors of highest cosine above 0, best first, ties by number; `leave` isn't one of them."""
        return self.search([(terms, weights)], k, leave)[0]

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, leave: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """What nearest gives for each vector. A block is compared at once with all vectors that its bound doesn't rule out.

        Products of 32 bits choose; they are off by no more than `slack` of themselves. Cosines of what they choose are
        summed in 64 bits, term by term, so that equal vectors get equal ones.
        """
        n, size = len(vectors), np.array([len(t) for t, _ in vectors], np.int64)
        terms = np.concatenate([t for t, _ in vectors] + [np.zeros(0, np.int64)])
        used = np.unique(terms)
        if n > 1 and n * len(used) > AT_ONCE:
            return self.search(vectors[: n // 2], k, leave) + self.search(vectors[n // 2 :], k, leave)
        number = np.full(self.n_terms, -1, np.int32)
        number[used] = np.arange(len(used))
        exact = np.zeros((len(used), n))
        exact[number[terms], np.repeat(np.arange(n), size)] = np.concatenate([x for _, x in vectors] + [np.zeros(0)])
        rough, slack = exact.astype(np.float32), (size + 8) * 2.0**-22
        cells, bound = [], np.zeros((self.blocks, n), np.float32)
        for b in range(self.blocks):
            c = np.arange(self.cells[b], self.cells[b + 1])
            cells.append(c[number[self.term[c]] >= 0])
            bound[b] = self.top[cells[b]] @ rough[number[self.term[cells[b]]]]
        best = _Best(self, cells, number, exact, slack, k, leave)
        # of each vector first the blocks of highest bound, then all that can still hold one of its k best
        m = min(FIRST, self.blocks)
        high = np.partition(bound, self.blocks - m, axis=0)[self.blocks - m]
        for first in (True, False):
            todo = (bound > 0) & ((bound >= high) == first)
            for b in np.flatnonzero(todo.any(axis=1)).tolist():
                live = np.flatnonzero(todo[b] & (bound[b] >= best.floor))
                if not len(live):
                    continue
                block = self._block(cells[b], np.float32)
                score = block @ np.take(rough[number[self.term[cells[b]]]], live, axis=1)
                floor = best.floor[live]
                if first and k < BLOCK:
                    floor = np.maximum(floor, np.partition(score, BLOCK - k - 1, axis=0)[BLOCK - k - 1] * (1 - 3 * slack[live]).astype(np.float32))
                hit = np.flatnonzero(score >= floor)
                best.add(live[hit % len(live)], b * BLOCK + hit // len(live), score.ravel()[hit])
            best.settle()
        cut = np.searchsorted(best.of, np.arange(n + 1))
        return [(best.row[a:b], best.score[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _block(self, cells: np.ndarray, kind: type) -> np.ndarray:
        """The weights of a block's vectors at these of its cells."""
        out = np.zeros((BLOCK, len(cells)), kind)
        posting, at = _ranges(self.at[cells], self.at[cells + 1], np.arange(len(cells)))
        out[self.slot[posting], at] = self.weight[posting]
        return out


class _Best:
    """The k vectors of highest cosine of each of many, ties by number, and the rough score that others must reach."""

    def __init__(self, index: BlockMaxIndex, cells: list[np.ndarray], number: np.ndarray, exact: np.ndarray, slack: np.ndarray, k: int, leave: int):
        self.index, self.cells, self.number, self.exact, self.slack, self.k, self.leave = index, cells, number, exact, slack, k, leave
        self.floor = np.full(exact.shape[1], np.finfo(np.float32).tiny)
        self.of, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.waiting = [], 0

    def add(self, of: np.ndarray, place: np.ndarray, rough: np.ndarray) -> None:
        self.new.append((of, place, rough))
        self.waiting += len(of)
        if self.waiting > AT_ONCE // 32:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        of, place, rough = (np.concatenate(c) for c in zip(*self.new, strict=True))
        self.new, self.waiting = [], 0
        other = self.index.row[place] != self.leave
        of, place, rough = of[other], place[other], rough[other]
        # the k-th of the new rough scores bounds what may be among the k best
        order = np.lexsort((-rough, of))
        of, place, rough = of[order], place[order], rough[order]
        first = np.searchsorted(of, np.arange(len(self.floor) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], rough[first[full] + self.k - 1] * (1 - 3 * self.slack[full]))
        keep = rough >= self.floor[of]
        of, place = of[keep], place[keep]
        of, row, score = np.concatenate((self.of, of)), np.concatenate((self.row, self.index.row[place])), np.concatenate((self.score, self._cosines(of, place)))
        order = np.lexsort((row, -score, of))
        order = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < self.k]
        self.of, self.row, self.score = of[order], row[order], score[order]
        first = np.searchsorted(self.of, np.arange(len(self.floor) + 1))
        full = np.flatnonzero(np.diff(first) == self.k)
        self.floor[full] = np.maximum(self.floor[full], self.score[first[full] + self.k - 1] * (1 - 2 * self.slack[full]))

    def _cosines(self, of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The cosines of vectors with vectors at these places."""
        out = np.zeros(len(of))
        if not len(of):
            return out
        order = np.argsort(place // BLOCK, kind="stable")
        blocks, start = np.unique(place[order] // BLOCK, return_index=True)
        for b, i in zip(blocks.tolist(), np.split(order, start[1:]), strict=True):
            c = self.cells[b]
            block, local = self.index._block(c, float), self.number[self.index.term[c]]
            step = max(1, AT_ONCE // 16 // max(1, len(c)))
            for lo in range(0, len(i), step):
                j = i[lo : lo + step]
                out[j] = np.cumsum(block[place[j] % BLOCK] * self.exact[local[None, :], of[j][:, None]], axis=1)[:, -1]
        return out


def _ranges(start: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after another, and each range's value at each of its numbers."""
    length = (end - start).astype(np.int64)
    last = np.cumsum(length)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - length), length), np.repeat(values, length)


class Model:
    def __init__(self, vocabulary: Vocabulary, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray):
        self.vocabulary, self.labels, self.ids = vocabulary, labels, ids
        self.index = BlockMaxIndex(vectors, len(vocabulary.terms))
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        self.curve = np.linspace(0, 1, BINS + 1)

    def vote(self, vector: tuple[np.ndarray, np.ndarray], leave: int = -1) -> tuple[float, list[tuple[int, float]]]:
        return self.votes([vector], leave)[0]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], leave: int = -1) -> list[tuple[float, list[tuple[int, float]]]]:
        """Of each vector the share of toxic ones among its neighbours, and the nearest of these with their cosines."""
        out = []
        for rows, cosine in self.index.search(vectors, NEIGHBOURS, leave):
            share = (float((cosine * self.labels[rows]).sum()) + self.prior) / (float(cosine.sum()) + 1)
            out.append((share, list(zip(rows[:EVIDENCE].tolist(), cosine[:EVIDENCE].tolist(), strict=True))))
        return out

    def calibrated(self, share: float) -> float:
        return float(np.interp(share, np.linspace(0, 1, BINS + 1), self.curve))

    def calibrate(self, n: np.ndarray, hits: np.ndarray) -> float:
        """From counts of examples and toxic ones by bin of vote share: a rising curve of observed rates; the squared error of its rates."""
        middle = (np.arange(BINS) + 0.5) / BINS
        groups = [[(h + middle[i]) / (m + 1), m + 1.0, 1] for i, (m, h) in enumerate(zip(n, hits, strict=True))]
        i = 0
        while i + 1 < len(groups):
            if groups[i][0] > groups[i + 1][0]:
                (p, m, c), (q, l, e) = groups[i], groups.pop(i + 1)
                groups[i] = [(p * m + q * l) / (m + l), m + l, c + e]
                i = max(0, i - 1)
            else:
                i += 1
        rate = np.array([p for p, _, c in groups for _ in range(c)])
        self.curve = np.interp(np.linspace(0, 1, BINS + 1), middle, rate)
        return float((hits * (1 - rate) ** 2 + (n - hits) * rate**2).sum())


def _counts(examples: DataFrame) -> tuple[DataFrame, int]:
    """(term, n, g2) of examples (row, label, text): how many hold the term and how it depends on the label; the number of examples."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, texts in text_chunks(batch.column(2)):
                doc, term = doc_terms(texts)
                order = np.lexsort((doc, term))
                doc, term = doc[order], term[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])))[: len(term)]
                term, positive = term[new], label[lo + doc[new]]
                uniq, at = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(at, minlength=len(uniq))), pa.array(np.bincount(at, weights=positive, minlength=len(uniq)).astype(np.int64))], names=["term", "n", "hits"])

    total = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    n, hits = int(total[0]), int(total[1])
    counts = examples.mapInArrow(run, "term long, n long, hits long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    # G2 of the two-by-two table of presence and label
    cells = ((F.col("hits"), F.col("n") * (hits / max(n, 1))), (F.col("n") - F.col("hits"), F.col("n") * (1 - hits / max(n, 1))), (F.lit(hits) - F.col("hits"), (n - F.col("n")) * (hits / max(n, 1))), (n - F.col("n") - hits + F.col("hits"), (n - F.col("n")) * (1 - hits / max(n, 1))))
    g2 = sum((F.when(o > 0, o * F.ln(o / F.greatest(e, F.lit(1e-9)))).otherwise(0.0) for o, e in cells), F.lit(0.0)) * 2
    return counts.select("term", "n", g2.alias("g2")), n


def pick(docs: DataFrame, labels: DataFrame, *, max_examples: int = EXAMPLES, max_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of labelled documents in the order of a hash of their id: at most max_examples, and no more text than max_bytes.

    Rows without label or id are left out; of repeated ids the larger label and text count.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_examples rows
    met = materialize(met.groupBy("doc_id", "label").agg(F.max("text").alias("text")), "toxicity-picked")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # a narrow row an example
    small = met.select("doc_id", F.sum(F.octet_length("text")).over(order).alias("sum")).filter(F.col("sum") <= max_bytes)
    return met.join(F.broadcast(small.select("doc_id")), "doc_id").select("doc_id", "text", "label")


def fit(examples: DataFrame) -> Model:
    """A model from the rows (doc_id, text, label 0 or 1) that pick() gives."""
    examples = materialize(examples.select("doc_id", F.col("label").cast("long").alias("label"), F.col("text").cast("binary").alias("text")), "toxicity-examples")
    judge = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0
    seen, unseen = examples.filter(~judge), examples.filter(judge)
    counts, n = _counts(seen)
    counts = materialize(counts, "toxicity-terms")
    best, least, curve = SELECTIONS[0], np.inf, None
    for tried in (SELECTIONS[:-1], SELECTIONS[-1:]):
        if curve is not None and best != SELECTIONS[-2]:
            break
        found = model = None  # one at a time in memory
        found = _vectors(seen, counts, n, *tried[-1])
        for selection in tried:
            model = None
            model = _selected(found, n, *selection)
            error = _calibrate(model, unseen)
            if error < least:
                best, least, curve = selection, error, model.curve
    found = model = None
    counts, n = _counts(examples)
    model = _selected(_vectors(examples, materialize(counts, "toxicity-terms"), n, *best), n, *best)
    if curve is not None:
        model.curve = curve
    return model


def _selected(found: tuple, n: int, floor: float, least: int) -> Model:
    """The model over the terms of at least this G2 and number of examples."""
    terms, docs, g2, vectors, labels, ids = found
    keep = (g2 >= floor) & (docs >= least)
    number = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
    return Model(Vocabulary(terms[keep], docs[keep], n), [_part(v, number) for v in vectors], labels, ids)


def _vectors(examples: DataFrame, counts: DataFrame, n: int, floor: float, least: int) -> tuple:
    """Terms in order with their examples and G2, and the examples' vectors over them, labels and ids by id.

    All of it comes to the driver: no more terms and weights than the examples have words, which their bytes bound.
    """
    got = counts.filter((F.col("g2") >= floor) & (F.col("n") >= least)).toArrow()
    terms = got.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms, docs, g2 = terms[order], got.column("n").to_numpy()[order], got.column("g2").to_numpy()[order]
    shared = examples.sparkSession.sparkContext.broadcast(Vocabulary(terms, docs, n))

    def run(batches):
        for batch in batches:
            got = []
            for _, texts in text_chunks(batch.column(2)):
                got += shared.value.vectors(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.astype(np.int32) for t, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float64()))], names=["doc_id", "label", "terms", "weights"])

    kind = examples.schema["doc_id"].dataType.simpleString()
    rows = examples.mapInArrow(run, f"doc_id {kind}, label long, terms array<int>, weights array<double>").toArrow().sort_by("doc_id")
    shared.destroy()
    cut = np.concatenate(([0], np.cumsum([len(t) for t in rows.column("terms")]))).tolist()
    flat = [np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks] + [np.zeros(0, kind)]) for name, kind in (("terms", np.int32), ("weights", float))]
    vectors = [(flat[0][a:b], flat[1][a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return terms, docs, g2, vectors, rows.column("label").to_numpy().astype(float), np.array(rows.column("doc_id").to_pylist())


def _part(vector: tuple[np.ndarray, np.ndarray], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector over the terms with a number, in these numbers; the others have -1."""
    t = number[vector[0]]
    t, x = t[t >= 0], vector[1][t >= 0]
    return t, x / np.sqrt((x**2).sum()) if len(x) else x


def _calibrate(model: Model, unseen: DataFrame) -> float:
    """The curve from votes on examples (doc_id, label, text) that the model hasn't seen; their squared error."""
    shared = unseen.sparkSession.sparkContext.broadcast(model)

    def votes(batches):
        n, hits = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for lo, texts in text_chunks(batch.column(1)):
                for i, (share, _) in enumerate(shared.value.votes(shared.value.vocabulary.vectors(texts)), lo):
                    b = min(BINS - 1, int(share * BINS))
                    n[b] += 1
                    hits[b] += int(labels[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(hits)], names=["bin", "n", "hits"])

    got = unseen.select("label", "text").repartition(unseen.sparkSession.sparkContext.defaultParallelism).mapInArrow(votes, "bin long, n long, hits long").groupBy("bin").agg(F.sum("n"), F.sum("hits")).collect()
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for b, x, y in got:
        n[b], hits[b] = x, y
    shared.destroy()
    return model.calibrate(n, hits)


_EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with toxicity (0 to 1) and toxicity_evidence (the nearest examples: id, cosine, label).

    A text without a known term (empty and null texts too) has no neighbours; its score is the calibrated
    share of toxic examples. Ties among neighbours go to the smaller id. Repeated rows each get a row. With no
    examples every score is 0.5. Columns of docs with the added names are replaced.
    """
    docs = without(docs, ["toxicity", "toxicity_evidence"])
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            scores, evidence = [], []
            vectors = [v for _, texts in text_chunks(batch.column(at)) for v in m.vocabulary.vectors(texts)]
            for share, near in m.votes(vectors):
                scores.append(m.calibrated(share))
                evidence.append([{"doc_id": str(m.ids[r]), "cosine": c, "label": int(m.labels[r])} for r, c in near])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=[*(batch.schema.names[i] for i in keep), "toxicity", "toxicity_evidence"])

    fields = [T.StructField("toxicity", T.DoubleType()), T.StructField("toxicity_evidence", _EVIDENCE)]
    return docs.mapInArrow(run, added(T.StructType([docs.schema.fields[i] for i in keep]), fields))
