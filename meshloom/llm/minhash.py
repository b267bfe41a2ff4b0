"""MinHash near-duplicate detection: fast similarity sketches, banding, and verification on whole sets.

1. A document's set is its distinct word shingles, as 64-bit hashes; documents with equal sets (128-bit digest)
   are one node. A sketch has COORDINATES bins. In round i each element throws itself into a hashed bin with
   the value i + u, u hashed to [0, 1), and bins keep minima; rounds go on until all bins are filled. After
   COORDINATES rounds, element by element bin i - COORDINATES is filled, so that 2 * COORDINATES rounds fill every coordinate
   of any set. Two sets agree in a coordinate with a chance equal to their similarity, concentrated as for independent draws.
2. BANDS bands of ROWS coordinates name buckets. At similarity 0.85 a pair shares none with a chance of 9e-9.
   Each bucket is led by its member with the most company over all buckets (that from which copies were
   made, mostly); the members of all buckets with one leader are a star. All pairs that share a bucket are in one star.
3. Each node is compared with its best leader on whole sets. Links make components.
4. Stars that still hold more than one component are dealt into cells: the smaller components against all, by chunks of
   bounded size, so that every pair of different components meets in a cell. A cell compares whole sets and
   reports a link only between what its links don't connect yet, fewer than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_chunks
from .hashing import BASE, grams, mix
from .neardup import components

WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS, BANDS = 7, 48
COORDINATES = ROWS * BANDS
#: Shingles in a chunk of a star (8 bytes each).
CHUNK = 1 << 20
#: Documents sketched at once.
AT_ONCE = 1024


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    known, out = _Hashes(), []
    for t in texts:
        found = t.lower().split()  # ASCII only, on bytes
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        out.append(np.unique(grams(h, min(words, len(h)))) if len(h) else h)
    return out


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets, as two signed numbers each."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates for each set; none may be empty. The round stands in the highest bits of a value."""
    out = np.full((len(sets), coordinates), np.iinfo(np.uint64).max)
    flat, t = out.reshape(-1), np.uint64(coordinates)
    size = np.array([len(s) for s in sets])
    element, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    salt = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * BASE)
    for i in range(2 * coordinates):
        h = mix(element ^ salt[i])
        bins = (((h & np.uint64(0xFFFFFFFF)) * t) >> np.uint64(32)).astype(np.int64) if i < coordinates else i - coordinates
        np.minimum.at(flat, of * coordinates + bins, (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10)))
        left = np.flatnonzero(size)
        done = left[(out[left] != np.iinfo(np.uint64).max).all(1)]
        if len(done):
            size[done] = 0
            stay = size[of] > 0
            element, of = element[stay], of[stay]
            if not len(element):
                break
    return out


def bands_of(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The hashes of the bands of each sketch, as signed numbers."""
    banded = sketch.reshape(len(sketch), -1, rows)
    h = np.broadcast_to(np.arange(1, banded.shape[1] + 1, dtype=np.uint64), banded.shape[:2])
    for j in range(rows):
        h = mix(h ^ banded[:, :, j]) + BASE
    return h.view(np.int64)


_OWN = "n_shingles long, k1 long, k2 long, bands array<long>"


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands) of docs (doc_id, text); no bands for empty sets."""

    def run(batches):
        for batch in batches:
            for lo, texts in text_chunks(batch.column(1)):
                for at in range(0, len(texts), AT_ONCE):
                    sets = shingle_sets(texts[at : at + AT_ONCE], words)
                    full = [i for i, s in enumerate(sets) if len(s)]
                    found: list[list[int]] = [[] for _ in sets]
                    if full:
                        for i, b in zip(full, bands_of(sketches([sets[i] for i in full])).tolist(), strict=True):
                            found[i] = b
                    key = keys_of(sets)
                    cols = [batch.column(0).slice(lo + at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(found, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_OWN).fields]))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(reps: DataFrame) -> DataFrame:
    """(leader, node, shared): the nodes of each star but its leader, and in how many buckets they are with it."""
    rows = reps.select("node", F.explode("bands").alias("key"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows.join(crowd, "key"), "bands")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    led = members.select("key", "node").join(company, "node").groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("m"))
    led = materialize(led.select("key", (-F.col("m.node")).alias("leader")), "leaders")  # by itself, so that Spark can split the join of a hot key
    return materialize(members.select("key", "node").join(led, "key").filter("node <> leader").groupBy("leader", "node").agg(F.count("*").alias("shared")), "stars")


def _texts(docs: DataFrame, reps: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Rows (node, at: array of structs) with k1, k2 and a text of each node: (node, k1, k2, text, at)."""
    wanted = rows.join(reps.select("node", "low", "k1", "k2"), "node")
    named = docs.select(F.col("doc_id").alias("low"), "text").join(wanted.filter("low is not null"), "low").select("node", "k1", "k2", "text", "at")
    bare = docs.filter("doc_id is null").select("doc_id", "text")

    def run(batches):  # nodes of which no row has an id are found by their digest
        for batch in batches:
            for lo, texts in text_chunks(batch.column(1)):
                key = keys_of(shingle_sets(texts, words))
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), batch.column(1).slice(lo, len(texts))], names=["k1", "k2", "text"])

    keyed = bare.mapInArrow(run, "k1 long, k2 long, text string").join(wanted.filter("low is null").drop("low"), ["k1", "k2"])
    return named.unionByName(keyed.dropDuplicates(["node"]).select(named.columns))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """The rows of batches (..., k1, k2, text) with the text's set in place of these; rows whose text has another digest go."""
    for batch in batches:
        names = batch.schema.names
        rest = [i for i, n in enumerate(names) if n not in ("k1", "k2", "text")]
        k1, k2 = (batch.column(names.index(c)).to_pylist() for c in ("k1", "k2"))
        for lo, texts in text_chunks(batch.column(names.index("text"))):
            sets = shingle_sets(texts, words)
            key, part = keys_of(sets), batch.slice(lo, len(texts))
            for i, row in enumerate(zip(*(part.column(j).to_pylist() for j in rest), strict=True)):
                if (key[i, 0], key[i, 1]) == (k1[lo + i], k2[lo + i]):  # rows may share a doc_id
                    yield *row, sets[i]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])


def _best_links(docs: DataFrame, reps: DataFrame, stars: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) of nodes with the leader that they share most buckets with."""
    best = stars.groupBy("node").agg(F.max(F.struct("shared", (-F.col("leader")).alias("leader"))).alias("m")).select("node", (-F.col("m.leader")).alias("leader"))
    best = materialize(best, "best-leaders")
    size = best.join(reps.select("node", "n_shingles"), "node").groupBy("leader").agg(F.ceil(F.sum("n_shingles") / chunk).alias("parts"))
    size = materialize(size, "best-sizes")
    own = best.join(size, "leader").select("node", F.struct("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(1).alias("kind")).alias("at"))
    lead = size.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    lead = lead.select(F.col("leader").alias("node"), F.struct("leader", "part", F.lit(0).alias("kind")).alias("at"))
    at = own.unionByName(lead).groupBy("node").agg(F.collect_list("at").alias("at"))  # one a chunk of what the node leads
    rows = _texts(docs, reps, at, words).select("node", "k1", "k2", "text", F.explode("at").alias("at"))

    def run(batches):
        now, led = None, None
        found: list[tuple[int, int]] = []
        for node, leader, part, kind, own in _sets(batches, words):
            if kind == 0:
                now, led = (leader, part), own
            elif now == (leader, part) and similar(own, led, percent):
                found.append((node, leader))
        yield _pairs(found)

    dealt = rows.select("node", "at.leader", "at.part", "at.kind", "k1", "k2", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", "kind")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def cell_links(nodes: list[int], roots: list[int], minor: list[bool], major: list[bool], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between rows that are `minor` and rows that are `major` (a row may be both), of different roots, that connect all linked ones."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    word, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.cumsum(size) - size
    label = np.unique(np.array([roots[i] for i in order]), return_inverse=True)[1].reshape(-1)
    can, flags = np.array([major[i] for i in order]), np.zeros(len(word), bool)
    found = []
    for i in np.flatnonzero([minor[j] for j in order]).tolist():
        lo, hi = np.searchsorted(100 * size, percent * size[i]), np.searchsorted(percent * size, 100 * size[i], side="right")
        if not (can[lo:hi] & (label[lo:hi] != label[i])).any():
            continue
        mine = code[start[i] : start[i] + size[i]]
        flags[mine] = True
        both = np.add.reduceat(flags[code[start[lo] : start[hi - 1] + size[hi - 1]]], start[lo:hi] - start[lo], dtype=np.int64)
        flags[mine] = False
        for j in (lo + np.flatnonzero(can[lo:hi] & (100 * both >= percent * (size[lo:hi] + size[i] - both)))).tolist():
            if label[j] != label[i]:
                found.append((nodes[order[i]], nodes[order[j]]))
                label[label == label[j]] = label[i]
    return found


def _rest_links(docs: DataFrame, reps: DataFrame, stars: DataFrame, named: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) between different components (named: node, root, n_shingles) that share a star."""
    members = stars.select("leader", "node").unionByName(stars.select("leader", F.col("leader").alias("node")).distinct())
    members = members.join(named, "node")
    mixed = members.groupBy("leader").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("leader")
    members = materialize(members.join(mixed, "leader"), "mixed-stars")
    parts = members.groupBy("leader", "root").agg(F.sum("n_shingles").alias("n"))
    top = parts.groupBy("leader").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    count = lambda c: F.greatest(F.ceil(c / chunk), F.lit(1).cast("long"))
    top = materialize(top.select("leader", F.col("top.root").alias("top"), count(F.col("n")).alias("all"), count(F.col("n") - F.col("top.n")).alias("few")), "star-sizes")
    placed = members.join(top, "leader").withColumn("minor", F.col("root") != F.col("top"))

    def dealt(many: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), many)

    zero = F.lit(0).cast("long")
    # every member stands in its chunk of all, once for each chunk of the smaller components; those stand there, too
    across = placed.select("node", "leader", "root", dealt(F.col("all"), 1).alias("i"), F.explode(F.sequence(zero, F.col("few") - 1)).alias("j"), F.lit(True).alias("major"), "minor", dealt(F.col("few"), 2).alias("own"))
    across = across.select("node", "leader", "root", "i", "j", "major", (F.col("minor") & (F.col("j") == F.col("own"))).alias("minor"))
    down = placed.filter("minor").select("node", "leader", "root", F.explode(F.sequence(zero, F.col("all") - 1)).alias("i"), dealt(F.col("few"), 2).alias("j"), dealt(F.col("all"), 1).alias("own"))
    down = down.filter("i <> own").select("node", "leader", "root", "i", "j", F.lit(False).alias("major"), F.lit(True).alias("minor"))
    at = across.unionByName(down).groupBy("node").agg(F.collect_list(F.struct("leader", "i", "j", "root", "major", "minor")).alias("at"))
    rows = _texts(docs, reps, at, words).select("node", "k1", "k2", "text", F.explode("at").alias("at"))

    def run(batches):
        now, held = None, {}

        def links() -> list[tuple[int, int]]:
            return cell_links(list(held), *map(list, zip(*held.values(), strict=True)), percent) if len(held) > 1 else []

        for node, leader, i, j, root, major, minor, own in _sets(batches, words):
            if now != (leader, i, j):
                yield _pairs(links())
                now, held = (leader, i, j), {}
            held[node] = (root, minor, major, own)
        yield _pairs(links())

    rows = rows.select("node", "at.leader", "at.i", "at.j", "at.root", "at.major", "at.minor", "k1", "k2", "text")
    return rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id of a numeric or string type).

    component_id is the smallest doc_id reachable by links, itself included; kept tells whether it is the row's
    own. Texts without words (null and empty ones, too) have an empty set and are linked with nothing: their
    component is their own doc_id. Texts of fewer words than a shingle are one shingle. A null doc_id is never
    the smallest unless its whole component has none (then component_id is null and the rows are kept).
    Repeated rows each get a row, and rows that share a doc_id are kept or not together. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    own = materialize(_sketched(docs, words), "sketches")
    sets = own.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    reps = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    stars = _stars(reps)
    first = materialize(components(_best_links(docs, reps, stars, words, percent, chunk)), "first-components")
    size = reps.select("node", "n_shingles")
    named = materialize(size.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_shingles"), "first-named")
    more = _rest_links(docs, reps, stars, named, words, percent, chunk)
    of = named.select(F.col("node").alias("x"), F.col("root").alias("to"))
    for end in "ab":
        more = more.join(of, F.col(end) == F.col("x")).withColumn(end, F.col("to")).drop("x", "to")
    second = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    roots = named.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    joined = materialize(reps.select("node", "k1", "k2", "low").join(roots, "node"), "named-sets")
    least = materialize(joined.groupBy("root").agg(F.min("low").alias("component_id")), "least-ids")
    named = materialize(joined.join(least, "root").select("k1", "k2", "component_id"), "set-components")
    rows = own.select("doc_id", "n_shingles", "k1", "k2")
    full = rows.filter("n_shingles > 0").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    found = full.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
