"""Convex polyhedra as columns: arrays of faces, each an array of points (x, y, z) that run counterclockwise seen from outside.

A half-space is a struct (a, b, c, d) of the points with a * x + b * y + c * z <= d. Cutting keeps the part of
each face inside and closes the hole with a new face. Where an edge meets the plane is computed from its end
inside, so that the two faces at it and the new one share the point exactly. An empty polyhedron has no faces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import let
from .vector import Vec, det

#: Distances from a plane, relative to its normal's length, below which a point lies on it.
TOLERANCE = 1e-12
NONE = "array<array<struct<x:double,y:double,z:double>>>"


def plane(a: Column | float, b: Column | float, c: Column | float, d: Column | float) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for x, n in zip((a, b, c, d), "abcd", strict=True)])


def box(lo: Vec, hi: Vec) -> Column:
    """The faces of an upright box."""
    at = lambda i, j, k: F.struct((hi if i else lo).x.cast("double").alias("x"), (hi if j else lo).y.cast("double").alias("y"), (hi if k else lo).z.cast("double").alias("z"))
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    return F.array(*[F.array(*[at(*corners[int(c)]) for c in face]) for face in "0154 1265 2376 3047 0321 4567".split()])


def of_hull(points: Column, faces: tuple[str, ...]) -> Column:
    """The faces of a solid from its corners and the places of each face's corners, as in the canonical tables."""
    return F.array(*[F.array(*[F.get(points, F.lit(int(c))) for c in face]) for face in faces])


def _height(p: Column, v: Column) -> Column:
    return (p["a"] * v["x"] + p["b"] * v["y"] + p["c"] * v["z"] - p["d"]) / F.sqrt(p["a"] * p["a"] + p["b"] * p["b"] + p["c"] * p["c"])


def _face(face: Column, p: Column, tolerance: float) -> Column:
    """The part of a face inside, as its points."""
    high = F.transform(face, lambda v: F.struct(v.alias("v"), let(_height(p, v), lambda h: F.when(F.abs(h) <= tolerance, 0.0).otherwise(h)).alias("h")))

    def run(all_: Column) -> Column:
        n = F.size(all_)

        def step(x: Column, i: Column) -> Column:
            def pair(y: Column) -> Column:
                # from the end inside to the one outside, whichever way the face runs
                low, top = F.when(x["h"] < 0, x).otherwise(y), F.when(x["h"] < 0, y).otherwise(x)
                k = low["h"] / (low["h"] - top["h"])
                met = F.struct(*[(low["v"][c] + (top["v"][c] - low["v"][c]) * k).alias(c) for c in "xyz"])
                own = F.when(x["h"] <= 0, F.array(x["v"])).otherwise(F.array().cast(NONE[6:-1]))
                return F.when(x["h"] * y["h"] < 0, F.concat(own, F.array(met))).otherwise(own)

            return let(F.get(all_, (i + 1) % n), pair)

        return F.flatten(F.transform(all_, step))

    return let(high, run)


def _cap(points: Column, p: Column) -> Column:
    """Points on a plane as a face that looks along its normal."""
    n = F.size(points)
    total = lambda c: F.aggregate(points, F.lit(0.0), lambda acc, v: acc + v[c])
    mean = F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"), (total("z") / n).alias("z"))
    normal = Vec(p["a"], p["b"], p["c"]).unit()

    def ring(m: Column) -> Column:
        mid = Vec.of(m)
        first = Vec.of(F.get(points, F.lit(0))) - mid
        angle = lambda v: F.atan2(normal.dot(first.cross(Vec.of(v) - mid)), first.dot(Vec.of(v) - mid))
        return F.transform(F.array_sort(F.transform(points, lambda v: F.struct(angle(v).alias("angle"), v.alias("v")))), lambda s: s["v"])

    return let(mean, ring)


def cut(poly: Column, p: Column, tolerance: float = TOLERANCE) -> Column:
    """The part of a polyhedron inside a half-space; the polyhedron itself if nothing of it is outside."""
    heights = lambda q: F.transform(F.flatten(q), lambda v: _height(p, v))

    def inner(q: Column) -> Column:
        def close(faces: Column) -> Column:
            on = F.array_distinct(F.filter(F.flatten(faces), lambda v: F.abs(_height(p, v)) <= 8 * tolerance))
            return let(on, lambda o: F.when(F.size(o) >= 3, F.concat(faces, F.array(_cap(o, p)))).otherwise(faces))

        kept = let(F.filter(F.transform(q, lambda f: _face(f, p, tolerance)), lambda f: F.size(f) >= 3), close)
        return let(heights(q), lambda h: F.when(F.size(h) == 0, q).when(F.array_max(h) <= tolerance, q).when(F.array_min(h) >= -tolerance, F.array().cast(NONE)).otherwise(kept))

    return let(poly, inner)


def cut_all(poly: Column, planes: Column, tolerance: float = TOLERANCE) -> Column:
    """The part of a polyhedron inside all half-spaces of an array."""
    return F.aggregate(planes, poly.cast(NONE), lambda q, p: cut(q, p, tolerance))


def volume(poly: Column) -> Column:
    def total(q: Column) -> Column:
        o = Vec.of(F.get(F.get(q, F.lit(0)), F.lit(0)))

        def fan(f: Column) -> Column:
            part = F.transform(F.sequence(F.lit(1), F.size(f) - 2), lambda i: det(Vec.of(F.get(f, F.lit(0))) - o, Vec.of(F.get(f, i)) - o, Vec.of(F.get(f, i + 1)) - o))
            return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

        return F.when(F.size(q) > 0, F.aggregate(F.transform(q, fan), F.lit(0.0), lambda acc, x: acc + x) / 6).otherwise(0.0)

    return let(poly, total)


def area(poly: Column) -> Column:
    def face(f: Column) -> Column:
        o = Vec.of(F.get(f, F.lit(0)))
        part = F.transform(F.sequence(F.lit(1), F.size(f) - 2), lambda i: (Vec.of(F.get(f, i)) - o).cross(Vec.of(F.get(f, i + 1)) - o).struct())
        total = lambda c: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x[c])
        return Vec(total("x"), total("y"), total("z")).norm() / 2

    return F.aggregate(F.transform(poly, face), F.lit(0.0), lambda acc, x: acc + x)


def holds(poly: Column, p: Vec, tolerance: float = TOLERANCE) -> Column:
    """Whether a point is in the polyhedron or on it; false for an empty one."""

    def behind(f: Column) -> Column:
        o = Vec.of(F.get(f, F.lit(0)))
        normal = lambda c: F.aggregate(F.transform(F.sequence(F.lit(1), F.size(f) - 2), lambda i: getattr((Vec.of(F.get(f, i)) - o).cross(Vec.of(F.get(f, i + 1)) - o), c)), F.lit(0.0), lambda acc, x: acc + x)
        n = Vec(normal("x"), normal("y"), normal("z"))
        return n.dot(p - o) <= tolerance * n.norm()

    return (F.size(poly) > 0) & F.forall(poly, behind)
