"""Geometry on a sphere round the origin: coordinates, areas, arcs and the gnomonic projection, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MeshError
from .shape import let
from .vector import Vec, arc, det, from_lon_lat

# The planes of the gnomonic projection touch the sphere at +x, +y, -x, -y, -z, +z; the plane's two
# axes as coordinates with their signs.
PLANE_AXES = {1: ("+y", "+z"), 2: ("+z", "+x"), 3: ("-y", "+z"), 4: ("-z", "+x"), 5: ("-x", "+y"), 6: ("+x", "+y")}
PLANE_POLES = {1: "+x", 2: "+y", 3: "-x", 4: "-y", 5: "-z", 6: "+z"}


def _signed(v: Vec, name: str) -> Column:
    value = getattr(v, name[1])
    return value if name[0] == "+" else -value


def to_lon_lat(p: Vec) -> Column:
    """(lon, lat, radius) of a point, angles in radians, lon from 0 to 2 pi; null at the origin."""
    r = p.norm()
    lon = F.atan2(p.y, p.x)
    return F.when(r > 0, F.struct(F.when(lon < 0, lon + 2 * math.pi).otherwise(lon).alias("lon"), F.asin(p.z / r).alias("lat"), r.alias("radius")))


def scaled(p: Vec, radius: float) -> Vec:
    return p.unit().scale(radius)


def distance(a: Vec, b: Vec, radius: float = 1.0) -> Column:
    """The length of the arc between two directions."""
    return arc(a, b) * radius


def great_circle(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    """The angle between two positions, by the half-angle rule."""
    h = F.pow(F.sin((lat2 - lat) / 2), 2) + F.cos(lat) * F.cos(lat2) * F.pow(F.sin((lon2 - lon) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def plane_of(p: Vec) -> Column:
    """The number of the gnomonic plane whose pole has the largest part in the direction; the lower number on ties."""
    big = F.greatest(F.abs(p.x), F.abs(p.y), F.abs(p.z))
    out = None
    for plane, pole in PLANE_POLES.items():
        out = (F.when if out is None else out.when)(_signed(p, pole) >= big, plane)
    return out


def project(p: Vec, plane: Column, radius: float = 1.0) -> Column:
    """(x, y) where the line from the origin through p meets the plane; null if it doesn't."""
    out = None
    for number, (u, v) in PLANE_AXES.items():
        along = _signed(p, PLANE_POLES[number])
        at = F.struct((_signed(p, u) * radius / along).alias("x"), (_signed(p, v) * radius / along).alias("y"))
        out = (F.when if out is None else out.when)((plane == number) & (along > 0), at)
    return out


def unproject(q: Column, plane: Column, radius: float = 1.0) -> Column:
    """The point (x, y, z) of the sphere that project() maps to q."""
    out = None
    for number, (u, v) in PLANE_AXES.items():
        parts = {PLANE_POLES[number][1]: (PLANE_POLES[number][0], F.lit(radius)), u[1]: (u[0], q["x"]), v[1]: (v[0], q["y"])}
        at = Vec(*[value if sign == "+" else -value for sign, value in (parts[c] for c in "xyz")])
        out = (F.when if out is None else out.when)(plane == number, scaled(at, radius).struct())
    return out


def _huilier(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed area of the unit triangle with the given unit corners; its sides are computed once."""
    sides = F.struct(arc(b, c).alias("x"), arc(c, a).alias("y"), arc(a, b).alias("z"), F.when(det(a, b, c) < 0, -1.0).otherwise(1.0).alias("sign"))

    def excess(s: Column) -> Column:
        half = (s["x"] + s["y"] + s["z"]) / 2
        inner = F.tan(half / 2) * F.tan((half - s["x"]) / 2) * F.tan((half - s["y"]) / 2) * F.tan((half - s["z"]) / 2)
        return s["sign"] * 4 * F.atan(F.sqrt(F.greatest(inner, F.lit(0.0))))

    return let(sides, excess)


def _girard(a: Vec, b: Vec, c: Vec) -> Column:
    """The angle at b of a polygon that runs from a over b to c."""
    turn = let(F.struct(b.cross(a).struct().alias("u"), b.cross(c).struct().alias("v")), lambda s: F.atan2(Vec.of(s["u"]).cross(Vec.of(s["v"])).norm(), Vec.of(s["u"]).dot(Vec.of(s["v"]))))
    return let(turn, lambda t: F.when(det(a, b, c) < 0, 2 * math.pi - t).otherwise(t))


def area(poly: Column, radius: float = 1.0, rule: str = "lhuilier") -> Column:
    """Signed area of a polygon of great-circle arcs (an array of points), positive if counterclockwise from outside.

    lhuilier adds the triangles that fan out from the first corner; girard takes the excess of the angles, of
    convex polygons; quadrature integrates over the flat triangles of the fan, for small ones.
    """
    if rule not in ("lhuilier", "girard", "quadrature"):
        raise MeshError("rule is lhuilier, girard or quadrature")
    n = F.size(poly)

    def three(u: Column, i: Column, j: Column, k: Column, f) -> Column:
        at = F.struct(*[F.get(u, F.pmod(x, F.size(u)).cast("int")).alias(c) for x, c in zip((i, j, k), "abc", strict=True)])
        return let(at, lambda t: f(*[Vec.of(t[c]) for c in "abc"]))

    def total(u: Column) -> Column:
        if rule == "girard":
            parts = F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda i: three(u, i - 1, i, i + 1, _girard))
        else:
            parts = F.transform(F.sequence(F.lit(1), F.size(u) - 2), lambda i: three(u, F.lit(0), i, i + 1, _huilier if rule == "lhuilier" else _quadrature))
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)

    whole = let(F.transform(poly, lambda v: Vec.of(v).unit().struct()), total)
    if rule == "girard":
        whole = whole - (n - 2) * math.pi
    return F.when(n >= 3, whole * radius * radius).otherwise(0.0)


# A rule of degree 5 on the triangle: barycentric coordinates and weights.
_A, _B = (6 - math.sqrt(15)) / 21, (6 + math.sqrt(15)) / 21
RULE = [((1 / 3, 1 / 3, 1 / 3), 9 / 40)] + [(tuple(1 - 2 * s if i == j else s for j in range(3)), w) for s, w in ((_A, (155 - math.sqrt(15)) / 1200), (_B, (155 + math.sqrt(15)) / 1200)) for i in range(3)]


def _quadrature(a: Vec, b: Vec, c: Vec) -> Column:
    """The integral over the flat triangle of the solid angle of its points."""
    volume = det(a, b, c)
    total = F.lit(0.0)
    for (u, v, w), weight in RULE:
        r = (a.scale(u) + b.scale(v) + c.scale(w)).norm()
        total = total + weight / (r * r * r)
    return total * volume / 2


def counterclockwise(poly: Column) -> Column:
    """The polygon, turned round if its area is negative."""
    return F.when(area(poly) < 0, F.reverse(poly)).otherwise(poly)


def unpadded(conn: Column) -> Column:
    """conn without the repeats of its last vertex that pad it."""
    n = F.size(conn)
    last = F.get(conn, n - 1)
    keep = F.aggregate(F.reverse(conn), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda acc, v: F.struct((acc["k"] + (acc["on"] & (v == last)).cast("int")).alias("k"), (acc["on"] & (v == last)).alias("on")), lambda acc: acc["k"])
    return F.when(n > 1, F.slice(conn, 1, F.greatest(n - keep + 1, F.lit(1)))).otherwise(conn)


def arcs_meet(a: Vec, b: Vec, c: Vec, d: Vec, tolerance: float = 1e-12) -> Column:
    """The unit point (x, y, z) where arcs ab and cd cross or touch; null if they don't, or lie on one circle."""
    n, m = a.cross(b), c.cross(d)
    line = n.cross(m)
    size = line.norm()

    def holds(p: Vec, x: Vec, y: Vec, normal: Vec) -> Column:
        return (normal.dot(x.cross(p)) >= -tolerance) & (normal.dot(p.cross(y)) >= -tolerance)

    p = line.scale(1 / F.nullif(size, F.lit(0.0)))
    q = p.scale(F.lit(-1.0))
    on = lambda v: holds(v, a, b, n) & holds(v, c, d, m)
    return F.when(size > tolerance, F.when(on(p), p.struct()).when(on(q), q.struct()))


def arc_meets_latitude(a: Vec, b: Vec, lat: Column, tolerance: float = 1e-12) -> Column:
    """An array of the unit points where the arc ab crosses a circle of latitude: none, one or two."""
    n = a.cross(b).unit()
    z = F.sin(lat)
    # on the circle of the arc, points are h * sin(lat) along the vertical's foot and some way across
    flat = n.x * n.x + n.y * n.y
    foot = Vec(-n.x * n.z / F.nullif(flat, F.lit(0.0)) * z, -n.y * n.z / F.nullif(flat, F.lit(0.0)) * z, z)
    rest = 1 - foot.dot(foot)
    across = Vec(-n.y, n.x, F.lit(0.0)).scale(1 / F.sqrt(F.nullif(flat, F.lit(0.0))))
    step = F.sqrt(F.greatest(rest, F.lit(0.0)))
    ends = [foot + across.scale(step), foot - across.scale(step)]
    holds = lambda p: (n.dot(a.cross(p)) >= -tolerance) & (n.dot(p.cross(b)) >= -tolerance)
    found = F.array(*[F.when((rest >= 0) & holds(p), p.struct()) for p in ends])
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def corner_of(lon: Column, lat: Column) -> Column:
    return from_lon_lat(lon, lat).struct()
