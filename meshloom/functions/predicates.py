"""Pure predicates on points, boxes, segments and triangles, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vec


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def _all(values: list[Column]) -> Column:
    return reduce(Column.__and__, values)


def box_holds(lo: Vec, hi: Vec, p: Vec, tolerance: float = 0.0) -> Column:
    return _all([getattr(p, c).between(getattr(lo, c) - tolerance, getattr(hi, c) + tolerance) for c in "xyz"])


def boxes_overlap(lo: Vec, hi: Vec, lo2: Vec, hi2: Vec, tolerance: float = 0.0) -> Column:
    return _all([(getattr(lo, c) <= getattr(hi2, c) + tolerance) & (getattr(lo2, c) <= getattr(hi, c) + tolerance) for c in "xyz"])


def closest_on_box(lo: Vec, hi: Vec, p: Vec) -> Vec:
    return Vec(*[clamp(getattr(p, c), getattr(lo, c), getattr(hi, c)) for c in "xyz"])


def box_distance(lo: Vec, hi: Vec, p: Vec) -> Column:
    return (closest_on_box(lo, hi, p) - p).norm()


def box_diagonal(lo: Vec, hi: Vec) -> Column:
    return (hi - lo).norm()


def ray_in_box(lo: Vec, hi: Vec, o: Vec, d: Vec, length: Column | float) -> Column:
    """(enter, leave): the stretch of a ray or segment inside a box; null if it misses the box."""
    enter, leave = [F.lit(0.0)], [length if isinstance(length, Column) else F.lit(float(length))]
    miss = F.lit(False)
    for c in "xyz":
        q, s = getattr(o, c), getattr(d, c)
        a, b = (getattr(lo, c) - q) / F.nullif(s, F.lit(0.0)), (getattr(hi, c) - q) / F.nullif(s, F.lit(0.0))
        miss = miss | ((s == 0) & ~q.between(getattr(lo, c), getattr(hi, c)))
        enter.append(F.least(a, b))
        leave.append(F.greatest(a, b))
    first, last = F.greatest(*enter), F.least(*leave)  # nulls, of directions along a side, don't count
    return F.when(~miss & (first <= last), F.struct(first.alias("enter"), last.alias("leave")))


def plane_cuts_box(normal: Vec, offset: Column | float, lo: Vec, hi: Vec) -> Column:
    """Whether the plane normal . x + offset = 0 meets the box."""
    mid, half = (lo + hi).scale(0.5), (hi - lo).scale(0.5)
    reach = sum((F.abs(getattr(normal, c)) * getattr(half, c) for c in "xyz"), F.lit(0.0))
    return F.abs(normal.dot(mid) + offset) <= reach


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    d = b - a
    return a + d.scale(F.coalesce(clamp((p - a).dot(d) / F.nullif(d.dot(d), F.lit(0.0)), 0.0, 1.0), F.lit(0.0)))


def closest_on_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """The point (x, y, z) of a triangle nearest to p: the foot of p in its plane if it lies inside, else the nearest edge's."""
    u, v, r = b - a, c - a, p - a
    g, h, k = u.dot(u), u.dot(v), v.dot(v)
    d = F.nullif(g * k - h * h, F.lit(0.0))
    s, t = (r.dot(u) * k - r.dot(v) * h) / d, (r.dot(v) * g - r.dot(u) * h) / d
    foot = a + u.scale(s) + v.scale(t)
    tries = [closest_on_segment(p, x, y) for x, y in ((a, b), (b, c), (c, a))]
    nearest = F.array_min(F.array(*[F.struct((q - p).dot(q - p).alias("d2"), q.struct().alias("q")) for q in tries]))["q"]
    return F.when((s >= 0) & (t >= 0) & (s + t <= 1), foot.struct()).otherwise(nearest)


def solid_angle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """The signed solid angle of a triangle as seen from p: positive from behind its outward side; 0 in its plane."""
    u, v, w = a - p, b - p, c - p
    x, y, z = u.norm(), v.norm(), w.norm()
    return 2 * F.atan2(u.cross(v).dot(w), x * y * z + u.dot(v) * z + u.dot(w) * y + v.dot(w) * x)


def box_meets_triangle(mid: Vec, half: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Whether a box (middle and half widths) meets a triangle: no axis of either, or of two of their edges, parts them."""
    t = [v - mid for v in (a, b, c)]
    edges = [t[1] - t[0], t[2] - t[1], t[0] - t[2]]
    zero, one = F.lit(0.0), F.lit(1.0)
    unit = [Vec(one, zero, zero), Vec(zero, one, zero), Vec(zero, zero, one)]

    def parted(axis: Vec) -> Column:
        spots = [axis.dot(v) for v in t]
        reach = sum((F.abs(getattr(axis, c)) * getattr(half, c) for c in "xyz"), F.lit(0.0))
        return (F.least(*spots) > reach) | (F.greatest(*spots) < -reach)

    axes = [*unit, edges[0].cross(edges[1]), *[u.cross(e) for u in unit for e in edges]]
    return ~reduce(Column.__or__, [parted(x) for x in axes])
