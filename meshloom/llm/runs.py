"""Periodic runs of words: stretches that repeat themselves four times or more, found and collapsed.

1. A run of period q and at least max(6, 4 * q) words holds two copies of itself, q apart, that overlap in at
   least MIN_OVERLAP words. So each of its words is inside a k-gram that the document has twice, for
   k = MIN_OVERLAP. Words outside repeated k-grams are masked; the stretches between them are segments, and no
   run leaves one.
2. Main and Lorentz's divide and conquer goes over the segments alone: a run that crosses the middle of a
   segment has two equal copies of its period next to the middle, on its left or on its right; each such pair
   is extended to both sides as far as the period holds. The halves follow, all segments of a batch level by
   level. Extensions compare spans by rolling hashes; every run found is then compared word by word, and
   where a hash lied the segment is searched again by direct comparison.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, text_chunks, without
from .hashing import Rolling, edges, grams, mix

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
#: The least overlap of a run with itself one period on: LEAST - 1 words at period 1, (EXPONENT - 1) * q beyond.
MIN_OVERLAP = min(LEAST - 1, (EXPONENT - 1) * 2)
#: Pairs of spans compared at once.
AT_ONCE = 1 << 20

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def surviving(ids: np.ndarray, doc: np.ndarray, k: int = MIN_OVERLAP) -> np.ndarray:
    """Which words are inside a k-gram that its document has twice; negative ids separate documents."""
    inside = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= k:
        n = len(ids) - k + 1
        whole = np.cumsum(ids < 0)
        at = np.flatnonzero((whole[k - 1 :] == np.concatenate(([0], whole))[:n]))  # no separator in the gram
        gram = mix(grams(mix(ids.astype(np.uint64)), k)[at] + mix(doc[at].astype(np.uint64)))
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        np.add.at(inside, at, 1)
        np.add.at(inside, at + k, -1)
    return np.cumsum(inside)[:-1] > 0


def _pairs(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, 1 ... counts[node]) of all nodes, in pieces."""
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        i = np.arange(lo, min(int(ends[-1]), lo + AT_ONCE))
        node = np.searchsorted(ends, i, side="right")
        yield node, i - (ends[node] - counts[node]) + 1


def _reach(roll: Rolling, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words, at most `most`, agree from x and y on (way 1) or before x and y (way -1)."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (low < high).any():
        m = (low + high + 1) // 2
        a, b = (x, y) if way > 0 else (x - m, y - m)
        same = roll.spans(a, a + m) == roll.spans(b, b + m)
        low, high = np.where(same, m, low), np.where(same, high, m - 1)
    return low


def _extend(roll: Rolling, at: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(start, end, period) of the stretch around at and at + q, inside lo and hi, that keeps period q."""
    start = at - _reach(roll, at, at + q, at - lo, -1)
    return np.stack((start, at + q + _reach(roll, at, at + q, hi - at - q, 1), q), 1)


def main_lorentz(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs in the segments ids[lo:hi], sorted."""
    roll = Rolling(mix(ids.astype(np.uint64)))
    segment, low, high, found = np.arange(len(lo)), lo, hi, [np.zeros((0, 3), np.int64)]
    while len(low):
        mid, longest = (low + high) // 2, (hi - lo)[segment] // EXPONENT
        for way in (1, -1):
            room = (high - mid if way > 0 else mid - low) // 2
            for node, q in _pairs(np.minimum(room, longest)):
                at = mid[node] if way > 0 else mid[node] - 2 * q
                hit = roll.spans(at, at + q) == roll.spans(at + q, at + 2 * q)
                at, q, of, node = at[hit], q[hit], segment[node[hit]], node[hit]
                # a multiple of the node's smallest period, inside the run of that, only gives that run again
                one = np.concatenate(([True], node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
                runs = _extend(roll, at[one], q[one], lo[of[one]], hi[of[one]])
                own = np.cumsum(one) - 1
                rest = ~one & ((q % runs[own, 2] != 0) | (at < runs[own, 0]) | (at + 2 * q > runs[own, 1]))
                runs = np.concatenate((runs, _extend(roll, at[rest], q[rest], lo[of[rest]], hi[of[rest]])))
                long = runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, EXPONENT * runs[:, 2])
                found.append(np.unique(runs[long], axis=0))
        segment, low, high = np.concatenate((segment, segment)), np.concatenate((low, mid)), np.concatenate((mid, high))
        large = high - low >= LEAST
        segment, low, high = segment[large], low[large], high[large]
    rows = np.unique(np.concatenate(found), axis=0)
    if not len(rows):
        return rows
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))  # of a stretch's periods the smallest
    rows = rows[first]
    wrong = {int(np.searchsorted(lo, s, side="right")) - 1 for s, e, q in rows.tolist() if not np.array_equal(ids[s : e - q], ids[s + q : e])}
    if wrong:
        right = ~np.isin(np.searchsorted(lo, rows[:, 0], side="right") - 1, list(wrong))
        rows = np.concatenate([rows[right], *(direct(ids, int(lo[i]), int(hi[i])) for i in sorted(wrong))])
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def direct(ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """What main_lorentz finds in one segment, by comparing all words at each distance."""
    seen: dict[tuple[int, int], int] = {}
    for q in range(1, (hi - lo) // EXPONENT + 1):
        start, end = edges(ids[lo : hi - q] == ids[lo + q : hi])
        for s, e in zip((start + lo).tolist(), (end + lo + q).tolist(), strict=True):
            if e - s >= max(LEAST, EXPONENT * q):
                seen.setdefault((s, e), q)
    return np.array([(s, e, q) for (s, e), q in seen.items()], np.int64).reshape(-1, 3)


def search(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text: its number of words, its runs (start, length, period) by start and period, and its words outside repeats."""
    code: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # bytes split at ASCII white space only
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # a separator follows each text
    ids = np.full(int((sizes + 1).sum()), -1, np.int64)
    for w, at in zip(words, first.tolist(), strict=True):
        ids[at : at + len(w)] = np.fromiter(map(code.__getitem__, w), np.int64, len(w))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    lo, hi = edges(surviving(ids, doc) & (ids >= 0))
    large = hi - lo >= LEAST
    rows = main_lorentz(ids, lo[large], hi[large])
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
    np.add.at(dropped, rows[:, 1], -1)
    gone = np.cumsum(dropped)[:-1] > 0
    of, out = doc[rows[:, 0]], []
    bound = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, w in enumerate(words):
        own = rows[bound[i] : bound[i + 1]]
        if len(own):
            at = int(first[i])
            w = [w[j] for j in np.flatnonzero(~gone[at : at + len(w)]).tolist()]
            own = np.stack((own[:, 0] - at, own[:, 1] - own[:, 0], own[:, 2]), 1)
        out.append((int(sizes[i]), [tuple(r) for r in own.tolist()], b" ".join(w)))
    return out


def find_runs(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, in words from 0) and collapsed.

    Words are what ASCII white space separates. A run is a stretch with smallest period q and at least
    max(6, 4 * q) words that no neighbouring word extends; runs stand by start, then period. collapsed has, joined
    by single spaces, the words that no run holds beyond its first q.

    Null and empty texts have no words, no runs and an empty collapsed text. Each row is read for itself, so
    repeated rows give equal results. Columns of the same names as those added are replaced, others are carried
    (the text only with keep_text). A batch holds 2 MB of text, or one longer text.
    """
    docs = without(docs, [c for c in ("n_words", "runs", "collapsed") if c != text])
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    at = docs.columns.index(text)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            for lo, texts in text_chunks(batch.column(at)):
                found, part = search(texts), batch.slice(lo, len(texts))
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for _, rows, _ in found]
                cols = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, run_type), pa.array([c for _, _, c in found], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *cols], names=[*(batch.schema.names[i] for i in keep), "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, added(T.StructType([docs.schema.fields[i] for i in keep]), fields))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth document, by crc32 of its id, repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__w").cast("long"))
    n = F.nullif(F.greatest("__n", F.lit(0)), F.lit(0).cast("long"))
    rows = rows.withColumn("__a", g % n).withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + g % 8)))
    a, p = F.col("__a"), F.col("__p")
    said = F.transform("__w", lambda w, i: F.when(i < a, w).otherwise(F.get("__w", (a + F.pmod(i - a, p)).cast("int"))))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(said, " ")).otherwise(F.col("text")).alias("text"))
