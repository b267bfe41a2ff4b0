"""Parts of equal size: along a space-filling curve, along axes of inertia, by swaps over a graph; and boxes of a structured grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrix import eigen
from ..functions.shape import let
from ..functions.vector import Vec
from ..model import MeshError
from ..storage import numbered, written
from .refine import blocks, medians

METHODS = ("one", "jk", "ij square", "jk square", "ijk square")


def hilbert(cells: list[Column], bits: int) -> Column:
    """The place of a grid cell (two or three whole numbers of so many bits) along Hilbert's curve.

    From the highest bit down, the rest of the cell is mirrored or turned as the curve is there; what is left, read
    bit by bit, is the place in Gray order.
    """
    n, names = len(cells), [f"x{i}" for i in range(len(cells))]
    if n not in (2, 3) or n * bits > 63:
        raise MeshError("Hilbert's curve takes two or three numbers of 63 bits together")
    start = F.struct(*[c.cast("long").alias(x) for c, x in zip(cells, names, strict=True)])

    def turned(s: Column, q: Column) -> Column:
        x = [s[name] for name in names]
        for i in range(n):
            here = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(q - 1)
            first = F.when(here, x[0].bitwiseXOR(q - 1)).otherwise(x[0].bitwiseXOR(swap))
            if i:
                x[i] = F.when(here, x[i]).otherwise(x[i].bitwiseXOR(swap))
            x[0] = first
        return F.struct(*[c.alias(name) for c, name in zip(x, names, strict=True)])

    high = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def place(s: Column) -> Column:
        x = [s[names[0]]]
        for i in range(1, n):
            x.append(s[names[i]].bitwiseXOR(x[i - 1]))
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flip = F.when(x[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")).bitwiseXOR(flip)
        return let(F.struct(*[c.bitwiseXOR(flip).alias(name) for c, name in zip(x, names, strict=True)]), woven)

    def woven(s: Column) -> Column:
        key = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for c in (s[name] for name in names):
                key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")))
        return key

    return let(F.aggregate(high, start, turned), place)


def by_curve(rows: DataFrame, coordinates: list[str], parts: int, bits: int = 16) -> DataFrame:
    """rows with part, 0 to parts - 1: runs of the same length along Hilbert's curve through the rows' box; ties by the columns in order."""
    ends = rows.agg(*[f(c).cast("double").alias(n + c) for c in coordinates for n, f in (("lo", F.min), ("hi", F.max))]).first()
    size = max([(ends["hi" + c] or 0.0) - (ends["lo" + c] or 0.0) for c in coordinates] + [0.0]) or 1.0
    top = (1 << bits) - 1
    cells = [F.least(F.floor((F.col(c) - F.lit(ends["lo" + c])) / size * (top + 1)), F.lit(top)) for c in coordinates]
    placed = written(rows.withColumn("__key", hilbert(cells, bits)), "curve")
    return blocks(placed, ["__key", *rows.columns], parts).drop("__key")


def by_inertia(rows: DataFrame, levels: int) -> DataFrame:
    """rows (..., x, y, z) with part, 0 to 2 ** levels - 1: each part is halved at the median along the axis in which it spreads most."""
    rows = written(rows.withColumn("part", F.lit(0).cast("long")), "parts")
    for _ in range(levels):
        m = F.struct(*[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
        axes = rows.groupBy("part").agg(m.alias("m")).select("part", F.get(eigen(F.col("m")), F.lit(0))["axis"].alias("axis"))
        axes = written(axes, "axes")  # a row a part, 2 ** levels at most
        along = rows.join(F.broadcast(axes), "part").withColumn("__t", Vec.of(F.col("axis")).dot(Vec(*[F.col(c) for c in "xyz"])))
        along = written(along.drop("axis"), "along")
        rows = along.join(F.broadcast(medians(along, "__t", "part")), "part").withColumn("part", F.col("part") * 2 + (F.col("__t") > F.col("m")).cast("long"))
        rows = written(rows.select(*[c for c in along.columns if c != "__t"]), "parts")
    return rows


def cut_edges(edges: DataFrame, parts: DataFrame) -> int:
    """How many edges (a, b) run between parts (node, part)."""
    a, b = (parts.select(F.col("node").alias(x), F.col("part").alias("p" + x)) for x in "ab")
    return edges.join(a, "a").join(b, "b").filter("pa <> pb").count()


def swapped(edges: DataFrame, parts: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, part) with fewer edges (a, b) between parts, every part as large as before.

    In each round a node that has more neighbours in another part than in its own wishes to go there, half of
    them at a time; between each two parts as many go one way as the other, those first that gain most. A round that
    cuts more edges than the one before is the last and doesn't count.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = written(parts.select("node", "part"), "graph-parts")
    cut = cut_edges(edges, parts)
    for n in range(rounds):
        seen = both.join(parts.select(F.col("node").alias("b"), F.col("part").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.count("*").alias("n"))
        met = seen.join(parts, "node")
        own = met.groupBy("node", "part").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("part"), F.col("n"))), F.lit(0)).alias("own"), F.max(F.when(F.col("to") != F.col("part"), F.struct("n", (-F.col("to")).alias("to")))).alias("best"))
        half = F.pmod(F.xxhash64("node", F.lit(n)), F.lit(2)) == 0
        wish = own.filter(half & F.col("best").isNotNull() & (F.col("best.n") > F.col("own"))).select("node", "part", (-F.col("best.to")).alias("to"), (F.col("own") - F.col("best.n")).alias("loss"))
        ranked = written(numbered(wish, ["loss", "node"], "rank", 1, ["part", "to"]), "wishes")
        ways = ranked.groupBy("part", "to").agg(F.count("*").alias("n"))
        back = ways.select(F.col("part").alias("to"), F.col("to").alias("part"), F.col("n").alias("m"))
        go = ranked.join(ways.join(back, ["part", "to"]), ["part", "to"]).filter(F.col("rank") <= F.least("n", "m")).select("node", F.col("to").alias("new"))
        new = written(parts.join(go, "node", "left").select("node", F.coalesce("new", "part").alias("part")), "graph-parts")
        now = cut_edges(edges, new)
        if now > cut:
            break
        parts, cut = new, now
    return parts


@dataclass(frozen=True)
class Boxes:
    """A grid of parts over a structured box: so many parts along i, j and k. Part p is i + n_i * (j + n_j * k)."""

    low: tuple[int, int, int]
    high: tuple[int, int, int]
    parts: tuple[int, int, int]
    periodic: tuple[bool, bool, bool] = (False, False, False)

    def _size(self, d: int) -> int:
        return self.high[d] - self.low[d]

    def box(self, spark: SparkSession) -> DataFrame:
        """(part, i0, j0, k0, i1, j1, k1): each part's first element and the one after its last, in each direction."""
        p, rows = F.col("part"), spark.range(math.prod(self.parts)).withColumnRenamed("id", "part")
        step, out = 1, {}
        for d, c in enumerate("ijk"):
            at = F.floor(p / step) % self.parts[d]
            least, more = divmod(self._size(d), self.parts[d])
            out[c + "0"] = self.low[d] + at * least + F.least(at, F.lit(more))
            out[c + "1"] = out[c + "0"] + least + (at < more).cast("long")
            step *= self.parts[d]
        return rows.select("part", *[out[c + e].cast("long").alias(c + e) for e in "01" for c in "ijk"])

    def owner(self, cell: list[Column]) -> Column:
        """The part of an element (i, j, k), by arithmetic alone; null outside the box."""
        step, part, inside = 1, F.lit(0).cast("long"), F.lit(True)
        for d, c in enumerate(cell):
            at = c - self.low[d]
            least, more = divmod(self._size(d), self.parts[d])
            big = more * (least + 1)
            where = F.when(at < big, F.floor(at / (least + 1))).otherwise(more + F.floor((at - big) / max(1, least)))
            part, step, inside = part + where * step, step * self.parts[d], inside & (at >= 0) & (at < self._size(d))
        return F.when(inside, part.cast("long"))

    def neighbour(self, part: Column, offset: tuple[int, int, int]) -> Column:
        """The part beside a part in a direction of steps -1, 0 or 1; null beyond a border that isn't periodic, and for itself."""
        step, out, inside = 1, F.lit(0).cast("long"), F.lit(True)
        for d in range(3):
            at = F.floor(part / step) % self.parts[d] + offset[d]
            if self.periodic[d]:
                at = F.pmod(at, F.lit(self.parts[d]))
            else:
                inside = inside & (at >= 0) & (at < self.parts[d])
            out, step = out + at * step, step * self.parts[d]
        return F.when(inside & (out != part), out.cast("long"))


def structured(method: str, low: tuple[int, int, int], high: tuple[int, int, int], parts: int, periodic: tuple[bool, bool, bool] = (False, False, False)) -> Boxes:
    """How many parts a box of elements gets along each direction.

    one: all along j, else k, else i, whichever first has more elements than parts. jk: k is cut into as
    many slabs as divide both its elements and the parts, fewer than the square form asks for, the rest along j. The
    square forms take the factors of the parts whose ratio is nearest to that of the elements in the two directions, or,
    in three, those that make the pieces' sides most alike.
    """
    if method not in METHODS:
        raise MeshError(f"no method {method!r}")
    size = tuple(h - n for n, h in zip(low, high, strict=True))
    if parts < 1 or min(size) < 0:
        raise MeshError("a box has a positive number of parts")
    factors = [f for f in range(1, parts + 1) if parts % f == 0]
    if parts == 1:
        grid = (1, 1, 1)
    elif method == "one":
        d = next((d for d in (1, 2, 0) if size[d] > parts), None)
        if d is None:
            raise MeshError("no direction has more elements than parts")
        grid = tuple(parts if e == d else 1 for e in range(3))
    elif method == "jk":
        ideal = math.sqrt(parts * max(1, size[1]) / max(1, size[2])) * size[2] / max(1, size[1])
        slabs = max([f for f in factors if size[2] % f == 0 and f < ideal], default=1)
        grid = (1, parts // slabs, slabs)
    elif method == "ijk square":
        alike = lambda g: min(s / n for s, n in zip(size, g, strict=True)) / max(s / n for s, n in zip(size, g, strict=True))
        grid = max(((a, b, parts // (a * b)) for a in factors for b in factors if parts % (a * b) == 0), key=lambda g: (alike(g), g))
    else:
        a, b = (0, 1) if method == "ij square" else (1, 2)
        if size[b] == 0:
            first = parts
        else:
            first = min(factors, key=lambda f: (abs(f * f / parts - size[a] / size[b]), f))
        grid = tuple(first if d == a else parts // first if d == b else 1 for d in range(3))
    if any(n > max(1, s) for n, s in zip(grid, size, strict=True)):
        raise MeshError("more parts than elements in a direction")
    return Boxes(tuple(low), tuple(high), grid, tuple(periodic))
