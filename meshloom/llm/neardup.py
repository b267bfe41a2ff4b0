"""SimHash near-duplicate detection with Gray-order hierarchical indexes.

1. Each text gets a 64-bit fingerprint from its word shingles; equal fingerprints are one node.
2. Two fingerprints at `distance` <= 4 leave at least two of six blocks of bits untouched, so they meet in
   one of the 15 buckets that two blocks' bits name. Buckets above `max_bucket` rows are dealt out again:
   very large ones by further blocks of the remaining bits, all others by pairs of chunks. Every pair still
   meets.
3. A task sorts its rows by bucket and Gray rank and builds one hierarchy over them: a node holds the buckets
   below it and the bits that all below it share and its parent doesn't hold yet. Every link comes from a
   search of it, which adds up the differences on the way down and leaves a group as soon as they exceed
   `distance`, the group is outside the bucket, or all of it is linked to the searched one already.
4. A bucket gives one link from each member of a connected group to the group's smallest; the links of all
   buckets are then joined to components by alternating large-star and small-star steps.

No pair list is ever made: a bucket of n rows gives fewer than n links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, materialize, text_chunks, without

WORDS, DISTANCE, SEED = 4, 4, 42
#: Bits of the six blocks, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Blocks of the 42 to 44 bits that two blocks leave.
REST_BLOCKS = (7, 7, 7, 7, 7, 9)
MAX_BUCKET = 4096
#: Buckets above so many times MAX_BUCKET are dealt out by further bits first.
GIANT = 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the text's shingles, repeats included; 0 if it has no words."""
    found = text.lower().split()  # ASCII only, on bytes
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        h = np.array([hashed(joined, SEED)], "<u8")
    else:
        start = np.cumsum([0] + [len(w) + 1 for w in found])
        end = (start[words:] - 1).tolist()
        h = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(start.tolist(), end, strict=False)), "<u8", len(end))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(h)).astype(np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, *, text: str = "text", keep_text: bool = True, words: int = WORDS) -> DataFrame:
    """docs with the signed 64-bit column fp."""
    docs = without(docs, ["fp"])
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    at = docs.columns.index(text)
    schema = T.StructType([docs.schema.fields[i] for i in keep])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for _, texts in text_chunks(batch.column(at)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(fp)], names=[*(batch.schema.names[i] for i in keep), "fp"])

    return docs.mapInArrow(run, added(schema, [T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where x stands in Gray order: the number whose Gray code is x."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's connected group."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
        while (label != label[label]).any():
            label = label[label]
    return label


class GrayIndex:
    """The hierarchy over fingerprints sorted by bucket, then Gray rank.

    Level 0 holds the fingerprints, each level above groups of FANOUT nodes: the first and last bucket below,
    and the bits that all below share.
    """

    FANOUT = 8

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), bucket))
        self.bucket, self.fps = bucket[order], fps[order]
        mask, pattern = np.full(len(fps), np.iinfo(np.uint64).max), self.fps
        low = high = self.bucket
        self.levels: list[tuple[np.ndarray, ...]] = []  # bottom up
        while True:
            self.levels.append((low, high, mask, pattern))
            if len(mask) <= self.FANOUT:
                break
            at = np.arange(0, len(mask), self.FANOUT)
            size = np.minimum(self.FANOUT, len(mask) - at)
            first = np.repeat(pattern[at], size)
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at)
            pattern, low, high = pattern[at] & mask, low[at], high[at + size - 1]

    def search(self, query: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of fingerprints of the same bucket within `distance`; label may hide those with the query's own.

        A group is left as soon as it is out of the query's bucket, the differences in the bits that its nodes
        share exceed `distance`, or all of it has the query's label.
        """
        one = [label]  # per level: the label that all below have, or -1
        for _ in self.levels[1:]:
            at = np.arange(0, len(one[-1]), self.FANOUT)
            low, high = np.minimum.reduceat(one[-1], at), np.maximum.reduceat(one[-1], at)
            one.append(np.where(low == high, low, -1))
        top = len(self.levels) - 1
        roots_ = len(self.levels[top][0])
        q, node = np.repeat(query, roots_), np.tile(np.arange(roots_), len(query))
        acc, above = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)
        for level in range(top, -1, -1):
            low, high, mask, pattern = self.levels[level]
            live = (low[node] <= self.bucket[q]) & (self.bucket[q] <= high[node]) & ((one[level][node] != label[q]) | (one[level][node] < 0))
            q, node, acc, above = q[live], node[live], acc[live], above[live]
            acc = acc + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node] & ~above)
            live = acc <= distance
            q, node, acc = q[live], node[live], acc[live]
            if level:
                above = np.repeat(mask[node], self.FANOUT)
                q, acc = np.repeat(q, self.FANOUT), np.repeat(acc, self.FANOUT)
                node = (node[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                real = node < len(self.levels[level - 1][0])
                q, node, acc, above = q[real], node[real], acc[real], above[real]
        return q, node

    def groups(self, distance: int = DISTANCE, block: int = 256) -> np.ndarray:
        """For each place, the first place in its connected group."""
        label = np.arange(len(self.fps))
        for lo in range(0, len(label), block):
            q, node = self.search(np.arange(lo, min(len(label), lo + block)), label, distance)
            if len(q):
                label = roots(len(label), label[q], label[node])[label]
        return label


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smallest fp of its group) inside the buckets of rows sorted by key, all found in one index. Smallness is unsigned."""
    if not len(key):
        return fp, fp
    bucket = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    more = np.bincount(bucket)[bucket] > 1  # a row alone in its bucket has no partner
    index = GrayIndex(bucket[more], fp[more])
    label = index.groups(distance) if more.any() else np.zeros(0, int)
    low = index.fps.copy()
    np.minimum.at(low, label, index.fps)
    low = low[label]
    linked = index.fps != low
    return index.fps[linked], low[linked]


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """Links of rows (key, fp); a bucket is whole in one task and at most about 2 * MAX_BUCKET rows."""

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
            if done:
                a, b = bucket_links(key[:done], fp[:done], distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                key, fp = key[done:], fp[done:]
        a, b = bucket_links(key, fp, distance)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _slices(value: Column, sizes: tuple[int, ...]) -> list[Column]:
    out, at = [], 0
    for s in sizes:
        out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << s) - 1)))
        at += s
    return out


def _pair_keys(value: Column, sizes: tuple[int, ...]) -> Column:
    """An array of (pair number, bits of its two blocks, the other blocks' bits put together)."""
    parts, rows = _slices(value, sizes), []
    for i, (x, y) in enumerate(combinations(range(len(sizes)), 2)):
        bits = F.shiftleft(parts[x], sizes[y]).bitwiseOR(parts[y])
        rest = F.lit(0).cast("long")
        for j in range(len(sizes)):
            if j not in (x, y):
                rest = F.shiftleft(rest, sizes[j]).bitwiseOR(parts[j])
        rows.append(F.struct(F.lit(i).cast("long").alias("pair"), bits.alias("bits"), rest.alias("rest")))
    return F.array(*rows)


def _hot(rows: DataFrame, most: int) -> DataFrame:
    return materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "hot-buckets")


def _split(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot keys; hot keys are broadcast if they are few."""
    side = F.broadcast(hot) if hot.count() <= 100_000 else hot
    return rows.join(side, "key", "left_anti"), rows.join(side, "key")


def _chunk_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, fp, n) dealt to pairs of chunks of their bucket: every two rows meet in one pair."""
    many = F.ceil(F.col("n") / most).cast("long")
    dealt = rows.withColumn("__own", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), many)).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return dealt.select(F.xxhash64("key", F.least("__own", "__other"), F.greatest("__own", "__other")).alias("key"), "fp")


def links(nodes: DataFrame, *, distance: int = DISTANCE, max_bucket: int = MAX_BUCKET, giant: int = GIANT) -> DataFrame:
    """Links (a, b), b the smaller, that connect the distinct fingerprints fp as all pairs within `distance` do."""
    if distance > len(BLOCKS) - 2:
        raise ValueError(f"two of {len(BLOCKS)} blocks stay untouched only up to distance {len(BLOCKS) - 2}")
    rows = nodes.select("fp", F.explode(_pair_keys(F.col("fp"), BLOCKS)).alias("k"))
    rows = rows.select("fp", F.shiftleft("k.pair", 22).bitwiseOR(F.col("k.bits")).alias("key"), "k.rest")
    hot = _hot(rows.select("key"), max_bucket)
    if hot.isEmpty():
        return _links(rows, distance)
    cold, rows = _split(rows, hot)
    parts, dealt = [cold.select("key", "fp")], [rows.filter(F.col("n") <= giant * max_bucket).select("key", "fp", "n")]
    if not hot.filter(F.col("n") > giant * max_bucket).isEmpty():
        fine = rows.filter(F.col("n") > giant * max_bucket).select("fp", "key", F.explode(_pair_keys(F.col("rest"), REST_BLOCKS)).alias("k"))
        fine = fine.select("fp", F.xxhash64("key", "k.pair", "k.bits").alias("key"))
        cold, rows = _split(fine, _hot(fine.select("key"), max_bucket))
        parts.append(cold.select("key", "fp"))
        dealt.append(rows.select("key", "fp", "n"))
    for d in dealt:
        parts.append(_chunk_pairs(d, max_bucket))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _links(out, distance)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node, as signed numbers, in each node's connected group; nodes without links are absent.

    Alternates large-star and small-star steps until the links no longer change. Minima are aggregates, so a
    node with very many links isn't gathered; each round is written to the shared folder.
    """
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, mark = materialize(oriented, "links"), None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = new
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "links")


def _components(docs: DataFrame, text: str, distance: int, words: int, max_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id, linked) of every fingerprint."""
    own = materialize(with_fingerprints(docs.select("doc_id", F.col(text).alias("text")), keep_text=False, words=words), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = components(links(nodes.select("fp"), distance=distance, max_bucket=max_bucket))
    named = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    # written by themselves, so that Spark can split the join of a component with very many fingerprints
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    return own, named.join(least, "root").select("fp", "root", "component_id", "linked")


def near_duplicates(docs: DataFrame, *, text: str = "text", distance: int = DISTANCE, words: int = WORDS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, linked) for each row of docs.

    component_id is the smallest doc_id of all rows whose fingerprints are reachable by links; linked tells
    whether the row's fingerprint has a link to another one. Null and wordless texts have fingerprint zero
    and link like any other. A null doc_id is never the smallest unless all of its component are null.
    Repeated rows each get a row. Of docs only doc_id and the text are read.
    """
    own, of = _components(docs, text, distance, words, max_bucket)
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "linked")


def keep_one(docs: DataFrame, *, text: str = "text", distance: int = DISTANCE, words: int = WORDS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of docs for each group of near duplicates: that with the smallest doc_id.

    Rows that share a doc_id are one document, of which one row stays. Where a group has no doc_id at all, one
    of its rows stays.
    """
    own, of = _components(docs, text, distance, words, max_bucket)
    of = materialize(of, "components")
    stay = own.join(of, "fp").filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    bare = with_fingerprints(docs.filter(F.col("doc_id").isNull()), text=text, words=words)
    bare = bare.join(of.filter(F.col("component_id").isNull()).select("fp", F.col("root").alias("__root")), "fp").dropDuplicates(["__root"])
    return named.select(*docs.columns).unionByName(bare.select(*docs.columns))
