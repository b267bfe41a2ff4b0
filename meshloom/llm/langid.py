"""Language identification of words, spans and documents.

A word's script (its first letter's range) narrows the languages it can be in to those that use the script in
the labelled texts. Each language scores the word by its letter n-grams; Viterbi over the words, with a
penalty for each switch of language, labels spans of mixed-language text. A document's language is the one
whose spans hold most letters; its score is their share.

The scorer is fitted on a sample of about `DOCS_PER_LANG` labelled documents a language (every document is
in it with a chance that follows its language's count). It is a table of N-gram buckets, so its size is fixed
by BUCKETS, the three orders and the number of languages.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, text_chunks, without
from .hashing import edges

DOCS_PER_LANG = 2000
MAX_LANGS = 500
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SWITCH = 8.0
#: What a language that doesn't use a word's script loses against the best one that does, as log score.
FOREIGN = -30.0
#: A language uses a script if so large a share of its labelled letters is in it.
USES = 0.01
UNKNOWN = "und"
#: Ranges of code points by script; letters outside them are in script 0.
SCRIPTS = ((0x41, 0x24F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x590, 0x5FF, "Hebrew"), (0x600, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xB80, 0xBFF, "Tamil"), (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"))
N_SCRIPTS = len(SCRIPTS) + 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it part of a word, its lower case, its script."""
    n = 0x110000
    word, lower, script = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for c in range(n):
        if unicodedata.category(chr(c))[0] in "LM":
            word[c] = True
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for i, (lo, hi, _) in enumerate(SCRIPTS):
        script[lo : hi + 1] = i + 1
    return word, lower, script


class Words:
    """Words of a batch of texts as arrays over code points."""

    def __init__(self, texts: list[bytes]):
        word, lower, script = _tables()
        parts = [t.decode("utf-8", "replace") for t in texts]
        points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = word[points]
        self.symbols = np.where(inside, lower[points], 0).astype(np.uint64)
        self.start, self.end = edges(inside)
        self.script = script[points[self.start]]
        self.offset = 1 + np.cumsum([0] + [len(p) + 1 for p in parts])
        at = np.searchsorted(self.start, self.offset)
        self.first, self.last = at[:-1], at[1:]

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of the n-gram that ends at each symbol."""
        h = np.zeros(len(self.symbols), np.uint64)
        for j in range(n):
            h[j:] = h[j:] + self.symbols[: len(h) - j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: by language, order and bucket; letters: by language and script."""
        self.langs = langs
        smooth = counts + 0.05
        self.scores = np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.uses = share >= USES  # language, script

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.start), len(self.langs)))
        for i, n in enumerate(ORDERS):
            b = w.buckets(n)
            for k in range(len(self.langs)):
                sums = np.concatenate(([0.0], np.cumsum(self.scores[k, i][b], dtype=np.float64)))
                out[:, k] += sums[w.end + (n > 1)] - sums[w.start]
        known = self.uses[:, w.script].T
        best = np.where(known, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(known | ~known.any(axis=1, keepdims=True), out, best + FOREIGN)

    def labels(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
        """The best language of each word: Viterbi, for many texts of like length at once."""
        out = np.zeros(len(scores), np.int16)
        order = np.argsort(last - first, kind="stable")
        order = order[(last - first)[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * int((last - first)[order[hi]]) <= cells:
                hi += 1
            docs = order[lo:hi][::-1]  # the longest first, so that live ones come first
            length, begin = (last - first)[docs], first[docs]
            steps, n, m = int(length[0]), len(docs), len(self.langs)
            live = np.searchsorted(-length, -np.arange(steps), side="left")  # texts with more words than t
            came = np.zeros((steps, n, m), np.int16)
            best = scores[begin].copy()
            same = np.arange(m, dtype=np.int16)
            for t in range(1, steps):
                k = live[t]
                v = best[:k]
                top = v.argmax(axis=1)
                jump = v[np.arange(k), top] - SWITCH
                stay = v >= jump[:, None]
                came[t, :k] = np.where(stay, same, top[:, None])
                best[:k] = np.where(stay, v, jump[:, None]) + scores[begin[:k] + t]
            state = best.argmax(axis=1).astype(np.int16)
            for t in range(steps - 1, -1, -1):
                k = live[t]
                out[begin[:k] + t] = state[:k]
                if t:
                    state[:k] = came[t, np.arange(k), state[:k]]
            lo = hi
        return out

    def predict(self, texts: list[bytes], spans: bool) -> list[tuple[str, float, list[dict]]]:
        w = Words(texts)
        label = self.labels(self.word_scores(w), w.first, w.last)
        size = w.end - w.start
        doc = np.repeat(np.arange(len(texts)), w.last - w.first)
        m = len(self.langs)
        letters = np.bincount(doc * m + label, weights=size, minlength=len(texts) * m).reshape(-1, m)
        best, total = letters.argmax(axis=1), letters.sum(axis=1)
        out = []
        for d in range(len(texts)):
            if not total[d]:
                out.append((UNKNOWN, 0.0, []))
                continue
            runs, a, b = [], int(w.first[d]), int(w.last[d])
            if spans:
                cut = np.concatenate(([a], a + 1 + np.flatnonzero(label[a + 1 : b] != label[a : b - 1]), [b]))
                runs = [{"start": int(w.start[i] - w.offset[d]), "end": int(w.end[j - 1] - w.offset[d]), "lang": self.langs[label[i]]} for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            out.append((self.langs[best[d]], float(letters[d, best[d]] / total[d]), runs))
        return out


def fit(labelled: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model from labelled rows (doc_id, text, lang); rows without lang are left out."""
    labelled = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = dict(labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(counts)
    if not langs:
        return Model([UNKNOWN], np.zeros((1, len(ORDERS), BUCKETS)), np.zeros((1, N_SCRIPTS)))
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(draw < F.element_at(chance, F.col("lang"))).select("text", "lang")
    index = {k: i for i, k in enumerate(langs)}

    def run(batches):
        seen = np.zeros((len(langs), len(ORDERS), BUCKETS))
        letters = np.zeros((len(langs), N_SCRIPTS))
        for batch in batches:
            of = [index[x] for x in batch.column(1).to_pylist()]
            for lo, texts in text_chunks(batch.column(0)):
                w = Words(texts)
                for d in range(len(texts)):
                    a, b = int(w.offset[d]) - 1, int(w.offset[d + 1])
                    k = of[lo + d]
                    live = (w.symbols[a:b] > 0) | (np.concatenate(([0], w.symbols[a : b - 1])) > 0)
                    for i, n in enumerate(ORDERS):
                        got = w.buckets(n)[a:b] if len(texts) == 1 else _cached(w, n)[a:b]
                        seen[k, i] += np.bincount(got[w.symbols[a:b] > 0 if n == 1 else live], minlength=BUCKETS)
                    x, y = int(w.first[d]), int(w.last[d])
                    letters[k] += np.bincount(w.script[x:y], weights=w.end[x:y] - w.start[x:y], minlength=N_SCRIPTS)
        k, i, b = np.nonzero(seen)
        s, t = np.nonzero(letters)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((k, s))), pa.array(np.concatenate((i, np.full(len(s), -1)))), pa.array(np.concatenate((b, t))), pa.array(np.concatenate((seen[k, i, b], letters[s, t])))], names=["k", "i", "b", "n"])

    parts = sample.select(F.col("text").cast("binary"), "lang").mapInArrow(run, "k long, i long, b long, n double")
    got = parts.groupBy("k", "i", "b").agg(F.sum("n").alias("n")).toArrow()
    k, i, b, n = (got.column(c).to_numpy() for c in ("k", "i", "b", "n"))
    seen, letters = np.zeros((len(langs), len(ORDERS), BUCKETS)), np.zeros((len(langs), N_SCRIPTS))
    gram = i >= 0
    seen[k[gram], i[gram], b[gram]] = n[gram]
    letters[k[~gram], b[~gram]] = n[~gram]
    return Model(langs, seen, letters)


def _cached(w: Words, n: int) -> np.ndarray:
    known = w.__dict__.setdefault("_buckets", {})
    if n not in known:
        known[n] = w.buckets(n)
    return known[n]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, *, text: str = "text", spans: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_spans (code points, end exclusive).

    A null text or one without letters is `und` with score 0 and no spans; ties go to the language that sorts
    first. Texts are labelled whole, however long. Repeated rows each get a row. Columns of docs with the
    added names are replaced.
    """
    docs = without(docs, ["lang_pred", "lang_score", "lang_spans"])
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            found = []
            for _, texts in text_chunks(batch.column(at)):
                found += shared.value.predict(texts, spans)
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=[*(batch.schema.names[i] for i in keep), "lang_pred", "lang_score", "lang_spans"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_spans", _SPANS)]
    return docs.mapInArrow(run, added(T.StructType([docs.schema.fields[i] for i in keep]), fields))


def rejected(pred: Column, score: Column, least: float = 0.5) -> Column:
    """True for documents without a language, or none of whose languages has `least` of the letters."""
    return (pred == UNKNOWN) | (score < least)
