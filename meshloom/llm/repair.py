"""Conversation structure repair: the cheapest edits that make roles alternate, by a min-plus matrix scan.

A repaired conversation is empty, or an optional system turn before pairs of user and assistant; the automaton for it has
four states (0 nothing yet, 1 after system, 2 after user, 3 after assistant). Each turn is a 4x4 matrix: entry
(i, j) is the least (cost, audit) that takes state i to state j by edits before the turn (inserted turns: the
closure) and one edit of it. Products of such matrices under (min, +), where audits are joined and ties go
to the ASCII-least audit, are associative, so turns may be grouped in any way. (Two edit sequences with equal
cost from one state are never prefixes of one another, as what follows the prefix would be insertions that
cost more; so order by audit is kept by joining.)

1. Turns are dealt by ranges of (conversation, turn, role, text), so a very long conversation lies in many
   partitions. Each partition cuts its rows into blocks of at most BLOCK turns of one conversation.
2. A block that is sure to hold a whole conversation is settled on the spot. Of the others (the first and last
   of each partition, and those of long conversations), repeated turns are found across blocks by digest,
   each block becomes one matrix with its counts, and a tree of rounds multiplies FAN neighbours at a time.
3. The audit of the whole is cut into the blocks' portions, each block writes its repaired turns, and their
   hash is taken block after block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, materialize

#: Turns and bytes of text in a block at most (one longer text is a block of its own).
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Neighbouring blocks that one round of the tree multiplies.
FAN = 32
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each state; others lead nowhere.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    def entry(i: int, j: int) -> Entry:
        return min(((x[0] + y[0], x[1] + y[1]) for k in range(4) if (x := a[i][k]) and (y := b[k][j])), default=None)

    return tuple(tuple(entry(i, j) for j in range(4)) for i in range(4))


def least(*matrices: Matrix) -> Matrix:
    return tuple(tuple(min((m[i][j] for m in matrices if m[i][j]), default=None) for j in range(4)) for i in range(4))


def steps(moves: dict[int, int], cost: int, letter: str) -> Matrix:
    return tuple(tuple((cost, letter) if moves.get(i) == j else None for j in range(4)) for i in range(4))


IDENTITY = steps({i: i for i in range(4)}, 0, "")
_ANY = STEP["u"] | STEP["a"]  # the only turn that may be inserted, or made of another, at each state
_INSERTED = steps(_ANY, INSERT, "I")
#: Any number of insertions. More than three lead from no state to another more cheaply.
CLOSURE = reduce(lambda c, _: least(IDENTITY, product(_INSERTED, c)), range(3), IDENTITY)


@lru_cache(maxsize=1 << 16)
def scan(kinds: str) -> Matrix:
    """The product over turns. Kinds: x for one that must go, else the role's initial (o for others), in upper case if truncated."""
    if not kinds:
        return IDENTITY
    if len(kinds) > 1:
        half = 1 << ((len(kinds) - 1).bit_length() - 1)
        left, right = kinds[:half], kinds[half:]
        return product(*(scan(k) if len(k) <= 16 else scan.__wrapped__(k) for k in (left, right)))
    gone, more = steps({i: i for i in range(4)}, DELETE, "D"), TRUNCATED * kinds.isupper()
    if kinds == "x":
        return product(CLOSURE, gone)
    return product(CLOSURE, least(gone, steps(STEP.get(kinds.lower(), {}), more, "K"), steps(_ANY, REROLE + more, "R")))


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns multiply to `whole`."""
    done = product(whole, CLOSURE)[START]
    return min(e for e in (done[START], done[ASSISTANT]) if e)


class Element(NamedTuple):
    """What the tree needs of neighbouring turns, in order; turn numbers grow from block to block."""

    n: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    low: int | None
    high: int | None
    distinct: int
    costs: list[int]
    audits: list[str]

    def matrix(self) -> Matrix:
        flat = [(c, a) if c >= 0 else None for c, a in zip(self.costs, self.audits, strict=True)]
        return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


def flat(m: Matrix) -> tuple[list[int], list[str]]:
    entries = [e or (-1, "") for row in m for e in row]
    return [c for c, _ in entries], [a for _, a in entries]


def joined(a: Element, b: Element) -> Element:
    costs, audits = flat(product(a.matrix(), b.matrix()))
    same = a.high is not None and a.high == b.low
    return Element(
        a.n + b.n, a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + ((a.last + b.first) not in ("su", "ua", "au")), a.first, b.last,
        b.low if a.low is None else a.low, a.high if b.high is None else b.high, a.distinct + b.distinct - same, costs, audits,
    )


_ELEMENT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n", "blank", "duplicate", "truncated", "illegal")]
    + [T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("low", "high", "distinct")]
    + [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summary(e: Element) -> dict[str, int | str]:
    cost, audit = cheapest(e.matrix())
    gaps = 0 if e.low is None else e.high - e.low + 1 - e.distinct
    return {"gaps": gaps, "blank": e.blank, "duplicate": e.duplicate, "truncated": e.truncated, "illegal": e.illegal, "cost": cost, "audit": audit}


class Block:
    """Turns of one conversation, in order."""

    def __init__(self):
        self.turns: list[tuple[int | None, str, str]] = []
        self.kinds: list[str] = []
        self.seen: dict[tuple[str, str], int] = {}
        self.blank = self.duplicate = self.bytes = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        said, pos = text.strip(ASCII_SPACE), len(self.turns)
        if not said:
            kind, self.blank = "x", self.blank + 1
        elif self.seen.setdefault((role, text), pos) != pos:
            kind, self.duplicate = "x", self.duplicate + 1
        else:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kind = kind if said[-1] in ".!?" else kind.upper()
        self.turns.append((turn, role, text))
        self.kinds.append(kind)
        self.bytes += len(text)

    def full(self, turns: int) -> bool:
        return len(self.turns) >= turns or self.bytes >= BLOCK_BYTES

    def digests(self) -> tuple[list[int], list[bytes]]:
        """Places and digests of what the block says for the first time."""
        return list(self.seen.values()), [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in self.seen]


def element(kinds: str, roles: list[str], turns: list[int | None], blank: int, duplicate: int) -> Element:
    initials, known = [r[:1] for r in roles], [t for t in turns if t is not None]
    illegal = sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    costs, audits = flat(scan(kinds) if len(kinds) <= 16 else scan.__wrapped__(kinds))
    truncated = sum(k.isupper() for k in kinds)
    return Element(len(kinds), blank, duplicate, truncated, illegal, initials[0], initials[-1], min(known, default=None), max(known, default=None), len(set(known)), costs, audits)


def repaired(audit: str, before: int, system: bool, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves; `before` turns came earlier, of which the first may be a system's."""
    at, k = 0, before - system
    for letter in audit:
        role, text = ("user", "assistant")[k % 2], ""
        if letter != "I":
            text, role = texts[at], roles[at] if letter == "K" else role
            at += 1
        if letter != "D":
            yield role, text, letter
            k += 1


def portions(audit: str, sizes: Iterable[int]) -> Iterator[tuple[str, int, bool]]:
    """Cuts an audit into (portion, turns left before it, whether a system turn leads) for blocks of so many turns."""
    system, at, before, sizes = (len(audit) - audit.count("D")) % 2 == 1, 0, 0, list(sizes)
    for i, n in enumerate(sizes):
        lo, left = at, n
        while left or i == len(sizes) - 1 and at < len(audit):
            left -= audit[at] != "I"
            at += 1
        yield audit[lo:at], before, system
        before += at - lo - audit.count("D", lo, at)


def _rows(batch: pa.RecordBatch, names: Iterable[str]) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as batches of `size`, or fewer where they are long."""
    held, width = [], 0
    for row in rows:
        held.append(row)
        width += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        width += sum(len(t) for x in row if isinstance(x, list) for t in x if isinstance(t, str))
        if len(held) >= size or width > BLOCK_BYTES:
            yield _batch(held, schema)
            held, width = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, fields: T.StructType, work) -> DataFrame:
    """df.mapInArrow over work(rows as tuples), which yields tuples of `fields`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, out = df.columns, to_arrow_schema(fields)

    def run(batches):
        yield from _batches(work(row for b in batches for row in _rows(b, names)), out)

    return df.mapInArrow(run, fields)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of turns: (conv_id, at, open, turns, roles, texts, kinds, blank, duplicate, places, digests); open where others may hold turns of the conversation."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = [("at", "long"), ("open", "boolean"), ("turns", "array<long>"), ("roles", "array<string>"), ("texts", "array<string>"), ("kinds", "string"), ("blank", "long"), ("duplicate", "long"), ("places", "array<long>"), ("digests", "array<binary>")]
    fields = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in kinds)).fields])

    def cut(rows: Iterable[tuple]) -> Iterator[tuple]:
        ready, n = None, 0  # a block is told to be the partition's last only when the rows end
        for g, (conv, own) in enumerate(groupby(rows, key=lambda r: r[0])):
            block, parts = Block(), 0
            for _, part, turn, role, text in own:
                if block.full(size):
                    if ready:
                        yield ready(False)
                    ready, n, parts = _row(conv, part, n, block, True), n + 1, parts + 1
                    block = Block()
                block.add(turn, role, text)
            if ready:
                yield ready(False)
            ready, n = _row(conv, part, n, block, parts > 0 or g == 0), n + 1
        if ready:
            yield ready(True)

    def _row(conv, part: int, n: int, block: Block, is_open: bool):
        def finish(last: bool) -> tuple:
            turns, roles, texts = map(list, zip(*block.turns, strict=True))
            places, digests = block.digests() if is_open or last else (None, None)
            return conv, (part << 32) + n, is_open or last, turns, roles, texts, "".join(block.kinds), block.blank, block.duplicate, places, digests

        return finish

    return _mapped(dealt.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "text"), fields, cut)


_BLOCK = ["conv_id", "turns", "roles", "texts", "kinds", "blank", "duplicate"]


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b joined where the keys agree, null with null; the keys stand once."""
    b = b.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in b.columns])
    return a.join(b, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), how).drop(*(f"__{k}" for k in keys))


def _whole(blocks: DataFrame, *, turns: bool) -> DataFrame:
    """Conversations of one block: their summary with the hash, or their repaired turns."""
    conv = blocks.schema["conv_id"]

    def settle(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, numbers, roles, texts, kinds, blank, duplicate in rows:
            found = summary(element(kinds, roles, numbers, blank, duplicate))
            audit = found["audit"]
            (portion, before, system), = portions(audit, [len(roles)])
            lines = list(repaired(portion, before, system, roles, texts))
            if turns:
                yield from ((conv, i, *line) for i, line in enumerate(lines))
            else:
                yield conv, *(found[c] for c in _COUNTS), audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in lines).encode()).hexdigest()

    fields = _TURNS if turns else _SUMMARY
    return _mapped(blocks.select(*_BLOCK), T.StructType([conv, *fields]), settle)


_TURNS = [T.StructField("pos", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))]
_SUMMARY = [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


def _repeats(blocks: DataFrame) -> DataFrame:
    """(conv_id, at, later): places of turns that an earlier block of the conversation has said."""
    said = blocks.select("conv_id", "at", F.explode(F.arrays_zip("places", "digests")).alias("s")).select("conv_id", "at", F.col("s.places").alias("place"), F.col("s.digests").alias("digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return _met(said, first, ["conv_id", "digest"]).filter("at > first").groupBy("conv_id", "at").agg(F.collect_list("place").alias("later"))  # at most BLOCK of them


def _scanned(blocks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Of open blocks: (conv_id, gaps, ..., audit) of each conversation, and (conv_id, at, i, audit portion, before, system) of each block."""
    conv, names = blocks.schema["conv_id"], _ELEMENT.fieldNames()
    rows = _met(blocks.select("conv_id", "at", "turns", "roles", "kinds", "blank", "duplicate"), _repeats(blocks), ["conv_id", "at"], "left")

    def elements(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, at, numbers, roles, kinds, blank, duplicate, later in rows:
            kinds = list(kinds)
            for i in later or ():
                kinds[i] = "x"
            yield conv, at, *element("".join(kinds), roles, numbers, blank, duplicate + len(later or ()))

    own = materialize(_mapped(rows, T.StructType([conv, T.StructField("at", T.LongType()), *_ELEMENT.fields]), elements), "turn-blocks")
    place = own.select("conv_id", "at", "n", (F.row_number().over(Window.partitionBy("conv_id").orderBy("at")) - 1).cast("long").alias("i"))  # a narrow row a block
    place = materialize(place, "turn-places")
    now = _met(own, place.select("conv_id", "at", "i"), ["conv_id", "at"]).select("conv_id", "i", *names)

    def multiply(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (conv, i), group in groupby(rows, key=lambda r: (r[0], r[1] // fan)):
            yield conv, i, *reduce(joined, (Element(*r[2:]) for r in group))

    blocks_at_most = 1 + (place.agg(F.max("i")).first()[0] or 0)
    while blocks_at_most > 1:
        dealt = now.repartition("conv_id", F.expr(f"i div {fan}")).sortWithinPartitions("conv_id", "i")
        now, blocks_at_most = materialize(_mapped(dealt, T.StructType([conv, T.StructField("i", T.LongType()), *_ELEMENT.fields]), multiply), "turn-tree"), -(-blocks_at_most // fan)

    def settle(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, _, *rest in rows:
            found = summary(Element(*rest))
            yield conv, *(found[c] for c in _COUNTS), found["audit"]

    total = materialize(_mapped(now, T.StructType([conv, *_SUMMARY[:-1]]), settle), "turn-totals")
    order = place.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("of"))  # two numbers a block
    cut = _met(total, order, ["conv_id"]).select("conv_id", "audit", F.col("of.at").alias("at"), F.col("of.n").alias("n"))
    kinds = T._parse_datatype_string("at long, portion string, before long, system boolean").fields

    def share(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, audit, at, n in rows:
            for a, p in zip(at, portions(audit, n), strict=True):
                yield conv, a, *p

    return total, _mapped(cut, T.StructType([conv, *kinds]), share)


def _lines(blocks: DataFrame, shares: DataFrame) -> DataFrame:
    """Open blocks with their portions: (conv_id, at, portion, before, system, roles, texts)."""
    return _met(blocks, shares, ["conv_id", "at"]).select("conv_id", "at", "portion", "before", "system", "roles", "texts")


def _hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): blocks pass one after another, so that no more than one of them is held."""
    conv = lines.schema["conv_id"]

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, key=lambda r: r[0]):
            h, between = hashlib.sha256(), b""
            for _, _, portion, before, system, roles, texts in own:
                for role, text, _ in repaired(portion, before, system, roles, texts):
                    h.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield conv, h.hexdigest()

    return _mapped(lines.repartition("conv_id").sortWithinPartitions("conv_id", "at"), T.StructType([conv, T.StructField("sha", T.StringType())]), run)


def _prepared(rows: DataFrame, size: int) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    return materialize(_blocks(turns, size), "turns")


def repair(rows: DataFrame, conversations: DataFrame | None = None, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role, text).

    Turns stand by number (nulls first), role and text. A turn's first fault counts: blank, a duplicate of an
    earlier role and text, truncated (its last visible character ends no sentence). illegal counts neighbours whose
    initials aren't su, ua or au; gaps are the missing turn numbers. cost and audit are the cheapest edits'
    (K keep, R role, D delete, I insert), the hash that of the repaired `role:text` lines.

    Null roles and texts count as one space; a null conv_id is a conversation like others, null turns come first.
    conv_ids of `conversations` without rows get zeros, an empty audit and the hash of nothing; an empty table
    gives an empty result. Repeated rows are duplicates of the first. Other columns are not read.
    """
    blocks = _prepared(rows, block)
    ends = blocks.filter("open")
    total, shares = _scanned(ends, fan)
    total = _met(total, _hashes(_lines(ends, shares)), ["conv_id"]).withColumnRenamed("sha", "repaired_sha256")
    found = _whole(blocks.filter("not open"), turns=False).unionByName(total)
    if conversations is None:
        return found
    none = dict.fromkeys(_COUNTS, 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return _met(conversations.select("conv_id").distinct(), found, ["conv_id"], "left").fillna(none)


def repaired_turns(rows: DataFrame, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, pos, role, text, edit): the turns of repaired conversations, numbered from 0; edit is K, R or I. Rows as for repair()."""
    blocks = _prepared(rows, block)
    ends = blocks.filter("open")
    lines = _lines(ends, _scanned(ends, fan)[1])

    def write(rows: Iterable[tuple]) -> Iterator[tuple]:
        for conv, _, portion, before, system, roles, texts in rows:
            yield from ((conv, before + i, *line) for i, line in enumerate(repaired(portion, before, system, roles, texts)))

    fields = T.StructType([rows.schema["conv_id"], *_TURNS])
    return _whole(blocks.filter("not open"), turns=True).unionByName(_mapped(lines, fields, write))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with a few turns lost, emptied, cut, repeated or given to the user, by crc32 of `conv_id:turn`; nulls become one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    kept = rows.withColumn("kind", kind).filter("kind <> 0")
    return kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).select("conv_id", "turn", "role", "text")
