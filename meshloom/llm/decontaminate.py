"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of the hashes of k consecutive words (k-grams) each side keeps those that
are the minimum of some run of w = window - k + 1 neighbours. A shared run of `window` words holds w
k-grams, the minimum of which both sides keep, so every shared window has a kept k-gram in common. The
kept k-grams are joined, each hit is extended to the windows of `window` words around it, and those are
looked up among the items' windows and compared word by word.

Items of fewer than `window` words are one window each; for those every k-gram of their length is kept
(w = 1).

Two plans give the same rows. While the items have at most `max_index_words` words, their index is a
broadcast (so its size is bounded) and documents are read once, without a shuffle. Beyond it, kept k-grams
of documents and items meet in a shuffle join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, materialize, text_chunks, without
from .hashing import Rolling, edges, grams

WINDOW, K = 13, 5
#: The share of a document's words that makes it contaminated: one in so many.
SHARE = 20
MAX_INDEX_WORDS = 250_000

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_IS_WORD[list(range(0x41, 0x5B))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


class Words:
    """The words of a batch of texts as arrays: hashes, byte ranges, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts)
        self.buffer = _LOWER[np.frombuffer(joined, np.uint8)]
        self.start, self.end = edges(_IS_WORD[self.buffer])
        self.hash = Rolling(self.buffer).spans(self.start, self.end)
        bound = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.searchsorted(self.start, bound)
        self.first, self.last = at[:-1], at[1:]

    def list(self, lo: int, hi: int) -> list[bytes]:
        raw = self.buffer.tobytes() if hi - lo > 64 else None
        if raw is None:
            return [self.buffer[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]
        return [raw[s:e] for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]

    def room(self) -> np.ndarray:
        """For each word, how many words of its text begin there."""
        of = np.repeat(self.last, self.last - self.first)
        return of - np.arange(len(self.hash))

    def gram(self, k: int, room: np.ndarray) -> np.ndarray:
        """k-gram hashes; the largest number where a text has fewer than k words left."""
        out = np.full(len(self.hash), np.iinfo(np.uint64).max)
        g = grams(self.hash, k)
        out[: len(g)] = g
        out[room < k] = np.iinfo(np.uint64).max
        return out


def winnow(gram: np.ndarray, w: int) -> np.ndarray:
    """Positions of hashes that are the minimum of some run of w neighbours (all positions, on ties)."""
    n = len(gram)
    low = gram.copy()
    for j in range(1, min(w, n)):
        np.minimum(low[: n - j], gram[j:], out=low[: n - j])
    high = low.copy()
    for j in range(1, min(w, n)):
        np.maximum(high[j:], low[: n - j], out=high[j:])
    return np.flatnonzero((gram == high) & (gram != np.iinfo(np.uint64).max))


class Index:
    """Windows of the items by hash, and the kept k-grams that lead to them."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        owners: dict[tuple[int, bytes], set[str]] = {}
        hashes: dict[tuple[int, bytes], int] = {}
        kept = []
        for item_id, text in items:
            w = Words([text or b""])
            n = len(w.hash)
            size = min(window, n)
            if not size:
                continue
            room, words = w.room(), w.list(0, n)
            if n >= window:
                g = w.gram(k, room)
                kept.append(g[winnow(g, window - k + 1)])
            for i, h in enumerate(grams(w.hash, size).tolist()):
                key = (size, b" ".join(words[i : i + size]))
                hashes[key] = h
                owners.setdefault(key, set())
                if item_id is not None:
                    owners[key].add(item_id)
        self.kept = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]))
        self.by_size: dict[int, tuple[np.ndarray, list[list[tuple[bytes, tuple[str, ...]]]]]] = {}
        for size in sorted({s for s, _ in owners}):
            groups: dict[int, list[tuple[bytes, tuple[str, ...]]]] = {}
            for key, ids in owners.items():
                if key[0] == size:
                    groups.setdefault(hashes[key], []).append((key[1], tuple(sorted(ids))))
            order = sorted(groups)
            self.by_size[size] = (np.array(order, np.uint64), [groups[h] for h in order])

    @staticmethod
    def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where x is in the sorted values; -1 if it isn't."""
        if not len(sorted_values):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return np.where(sorted_values[at] == x, at, -1)

    def starts(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window size, word positions, group) of windows whose hash an item has."""
        room = w.room()
        for size, (values, _) in self.by_size.items():
            if size == self.window:
                g = w.gram(self.k, room)
                kept = winnow(g, self.window - self.k + 1)
                kept = kept[self.member(self.kept, g[kept]) >= 0]
                at = np.unique((kept[:, None] - np.arange(self.window - self.k + 1)).ravel()) if len(kept) else kept
                at = at[at >= 0]
            else:
                at = np.arange(len(room))
            at = at[room[at] >= size] if len(at) else at
            if len(at):
                group = self.member(values, w.gram(size, room)[at])
                yield size, at[group >= 0], group[group >= 0]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """For each text: its words, hit words, ids of items with windows in it, runs of hit words."""
        w = Words(texts)
        hit = np.zeros(len(w.hash) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for size, at, group in self.starts(w):
            doc = np.searchsorted(w.last, at, side="right")
            for p, g, d in zip(at.tolist(), group.tolist(), doc.tolist(), strict=True):
                own = b" ".join(w.list(p, p + size))
                for words, ids in self.by_size[size][1][g]:
                    if words == own:
                        hit[p] += 1
                        hit[p + size] -= 1
                        items.setdefault(d, set()).update(ids)
        inside = np.cumsum(hit[:-1]) > 0
        out = []
        for d, (lo, hi) in enumerate(zip(w.first.tolist(), w.last.tolist(), strict=True)):
            if d in items or inside[lo:hi].any():
                s, e = edges(inside[lo:hi])
                out.append((hi - lo, int((e - s).sum()), sorted(items.get(d, ())), list(zip(s.tolist(), e.tolist(), strict=True))))
            else:
                out.append((hi - lo, 0, [], []))
        return out


def _spans(rows: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"start": s, "end": e} for s, e in r] for r in rows]


def _annotated(batch: pa.RecordBatch, found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    new = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.string())), pa.array(_spans([f[3] for f in found]), schema.field("spans").type)]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"])


_SPAN_SCHEMA = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _by_broadcast(docs: DataFrame, benchmark: DataFrame, text: str, window: int, k: int) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).collect()  # bounded by max_index_words
    index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], bytes(r[1]) if r[1] is not None else None) for r in rows], window, k))

    def run(batches):
        for batch in batches:
            found = []
            for _, texts in text_chunks(batch.column(batch.schema.get_field_index(text))):
                found += index.value.search(texts)
            yield _annotated(batch, found, _SPAN_SCHEMA)

    return docs.mapInArrow(run, added(docs.schema, _FOUND.fields))


def _kept_grams(frame: DataFrame, key: str, window: int, k: int, sizes: list[int]) -> DataFrame:
    """(key, gram, pos, size): kept k-grams of long windows, and every k-gram as long as a short item."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, texts in text_chunks(batch.column(1)):
                w = Words(texts)
                room = w.room()
                for size in sizes:
                    g = w.gram(k if size == window else size, room)
                    at = winnow(g, window - k + 1) if size == window else np.flatnonzero(room >= size)
                    doc = np.searchsorted(w.last, at, side="right")
                    for a in range(0, len(at), 100_000):
                        b = slice(a, a + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array([keys[lo + d] for d in doc[b].tolist()], pa.string()), pa.array(g[at[b]].view(np.int64)), pa.array(at[b] - w.first[doc[b]]), pa.array(np.full(len(at[b]), size))], names=["key", "gram", "pos", "size"])

    return frame.select(F.col(key).alias("key"), F.col("text").cast("binary")).mapInArrow(run, "key string, gram long, pos long, size long")


def _windows_at(frame: DataFrame, window: int, k: int) -> DataFrame:
    """(key, start, size, words) of the windows around the hits in columns key, text, hits(pos, size)."""

    def run(batches):
        for batch in batches:
            keys, texts, hits = batch.column(0).to_pylist(), (t for _, part in text_chunks(batch.column(1)) for t in part), batch.column(2).to_pylist()
            for key, text, hit in zip(keys, texts, hits, strict=True):
                words, rows = words_of(text), set()
                for h in hit:
                    for start in range(h["pos"] - (window - k), h["pos"] + 1) if h["size"] == window else (h["pos"],):
                        if start >= 0 and start + h["size"] <= len(words):
                            rows.add((start, h["size"]))
                rows = sorted(rows)
                for a in range(0, len(rows), 50_000):
                    part = rows[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([b" ".join(words[s : s + n]) for s, n in part], pa.binary())], names=["key", "start", "size", "words"])

    return frame.mapInArrow(run, "key string, start long, size long, words binary")


def _item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), (t for _, part in text_chunks(batch.column(1)) for t in part), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                part = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([size] * len(part), pa.int64()), pa.array(part, pa.binary())], names=["item_id", "size", "words"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "item_id string, size long, words binary")


def _by_shuffle(docs: DataFrame, benchmark: DataFrame, text: str, window: int, k: int) -> DataFrame:
    keyed = docs.withColumn("__key", F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))))
    windows = materialize(_item_windows(benchmark, window), "item-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    items = benchmark.withColumn("__key", F.lit("")).select("__key", "text")
    wanted = _kept_grams(items, "__key", window, k, sizes).select("gram", "size").distinct()
    texts = keyed.select(F.col("__key").alias("key"), F.col(text).cast("binary").alias("text")).dropDuplicates(["key"])
    hits = _kept_grams(keyed.select("__key", F.col(text).alias("text")), "__key", window, k, sizes).join(wanted, ["gram", "size"], "left_semi").distinct()
    per = hits.groupBy("key").agg(F.collect_set(F.struct("pos", "size")).alias("hits"))
    at = _windows_at(texts.join(per, "key").select("key", "text", "hits"), window, k)
    met = at.join(windows, ["size", "words"])
    found = met.groupBy("key").agg(F.collect_set("item_id").alias("items"), F.collect_set(F.struct("start", "size")).alias("windows"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))
    found = found.select(F.col("key").alias("__key"), F.array_sort("items").alias("items"), words.alias("__hit"))
    starts = F.filter("__hit", lambda x, i: (i == 0) | (F.element_at("__hit", F.greatest(i, F.lit(1))) < x - 1))
    ends = F.filter("__hit", lambda x, i: (i == F.size("__hit") - 1) | (F.try_element_at(F.col("__hit"), i + 2) > x + 1))
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    joined = keyed.join(found, "__key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], n_words_expr(F.col(text)).alias("n_words"), F.coalesce(F.size("__hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(spans, F.array().cast(_FOUND["spans"].dataType)).alias("spans"))


def n_words_expr(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, k: int = K, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted as strings), spans of hit words, and contaminated.

    Null or wordless texts have no words and aren't contaminated. A null item id makes hits but isn't
    listed; items with the same id count as one. Repeated rows each get the result of their text.
    With no items nothing is hit. Columns of docs with the added names are replaced.
    """
    docs = without(docs, ["n_words", "n_hit", "items", "spans", "contaminated"])
    size = benchmark.agg(F.sum(n_words_expr(F.col("text")))).first()[0] or 0
    plan = _by_broadcast if size <= max_index_words else _by_shuffle
    found = plan(docs, benchmark, text, window, k)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
