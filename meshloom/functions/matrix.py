"""Symmetric 3x3 matrices as columns: structs (xx, xy, xz, yy, yz, zz), and affine transforms as arrays of 12 numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import let
from .vector import Vec

#: Sweeps of rotations: off-diagonal parts shrink to rounding in five, as convergence is quadratic.
SWEEPS = 8
_PAIRS = ((0, 1), (0, 2), (1, 2))


def _name(i: int, j: int) -> str:
    return "xyz"[min(i, j)] + "xyz"[max(i, j)]


def eigen(m: Column) -> Column:
    """An array of three structs (value, axis), values falling, axes unit vectors (x, y, z) of a right-handed frame.

    Jacobi's method: a fixed number of sweeps, each of which rotates the three planes in turn so that the part off
    the diagonal vanishes there.
    """
    start = [m[_name(i, j)].cast("double").alias(_name(i, j)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
    start += [F.lit(1.0 if i == j else 0.0).alias(f"v{i}{j}") for i in range(3) for j in range(3)]

    def rotated(s: Column, p: int, q: int) -> Column:
        r = 3 - p - q
        off = s[_name(p, q)]

        def turn(k: Column) -> Column:
            c, t = k["c"], k["t"]
            sine = c * t
            new = {_name(p, p): s[_name(p, p)] - t * off, _name(q, q): s[_name(q, q)] + t * off, _name(p, q): F.lit(0.0), _name(r, r): s[_name(r, r)]}
            new[_name(r, p)] = c * s[_name(r, p)] - sine * s[_name(r, q)]
            new[_name(r, q)] = sine * s[_name(r, p)] + c * s[_name(r, q)]
            for i in range(3):
                new[f"v{i}{p}"] = c * s[f"v{i}{p}"] - sine * s[f"v{i}{q}"]
                new[f"v{i}{q}"] = sine * s[f"v{i}{p}"] + c * s[f"v{i}{q}"]
                new[f"v{i}{r}"] = s[f"v{i}{r}"]
            return F.struct(*[new[n].alias(n) for n in names])

        tau = (s[_name(q, q)] - s[_name(p, p)]) / (2 * off)
        t = F.when(off == 0, 0.0).otherwise(let(tau, lambda x: F.when(x < 0, -1.0).otherwise(1.0) / (F.abs(x) + F.sqrt(1 + x * x))))
        return let(let(t, lambda x: F.struct((1 / F.sqrt(1 + x * x)).alias("c"), x.alias("t"))), turn)

    names = [_name(i, j) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))] + [f"v{i}{j}" for i in range(3) for j in range(3)]
    step = lambda s, k: F.when(k == 0, rotated(s, *_PAIRS[0])).when(k == 1, rotated(s, *_PAIRS[1])).otherwise(rotated(s, *_PAIRS[2]))
    done = F.aggregate(F.array(*[F.lit(k) for _ in range(SWEEPS) for k in range(3)]), F.struct(*start), step)

    def named(s: Column) -> Column:
        pairs = F.array(*[F.struct((-s[_name(i, i)]).alias("falling"), F.lit(i).alias("i"), *[s[f"v{j}{i}"].alias("xyz"[j]) for j in range(3)]) for i in range(3)])

        def frame(e: Column) -> Column:
            a, b = (Vec(*[F.get(e, F.lit(i))[c] for c in "xyz"]) for i in (0, 1))
            axes = [a, b, a.cross(b)]
            return F.array(*[F.struct((-F.get(e, F.lit(i))["falling"]).alias("value"), v.struct().alias("axis")) for i, v in enumerate(axes)])

        return let(F.array_sort(pairs), frame)

    return let(done, named)


def determinant(m: Column) -> Column:
    return m["xx"] * (m["yy"] * m["zz"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])


def affine(rows: list[list[Column | float]]) -> Column:
    """A transform from three rows of four numbers: the linear part, then the shift."""
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for row in rows for x in row])


def after(outer: Column, inner: Column) -> Column:
    """The transform that does the inner one first."""
    at = lambda m, i, j: F.get(m, F.lit(4 * i + j))
    return F.array(*[sum((at(outer, i, k) * at(inner, k, j) for k in range(3)), F.lit(0.0)) + (at(outer, i, 3) if j == 3 else 0.0) for i in range(3) for j in range(4)])


def moved(m: Column, p: Vec) -> Vec:
    at = lambda i, j: F.get(m, F.lit(4 * i + j))
    return Vec(*[at(i, 0) * p.x + at(i, 1) * p.y + at(i, 2) * p.z + at(i, 3) for i in range(3)])
