"""Quality metrics of elements as columns over their points.

Each function takes an array of points (x, y, z) in canonical order and gives its metrics by name, measures() all
of them as one value; `size` is the
reference size of the metrics that compare sizes. A metric whose formula divides by zero is null. The
triangle's radius ratio depends on its size: it is 1 for sides of 1. Values are of the corners; mid-side nodes
don't count.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MeshError
from .numbering import FACES
from .shape import let
from .vector import Vec, det

# The neighbours of each hexahedron corner, in right-handed order; its edges and diagonals.
HEX_CORNERS = ((1, 3, 4), (2, 0, 5), (3, 1, 6), (0, 2, 7), (7, 5, 0), (4, 6, 1), (5, 7, 2), (6, 4, 3))
HEX_EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (7, 4))
HEX_DIAGONALS = ((0, 6), (1, 7), (2, 4), (3, 5))
# Tetrahedra (corner numbers) whose volumes add up to a prism's, a knife's and a pyramid's.
PARTS = {"PRISM": ((0, 1, 2, 3), (1, 4, 5, 3), (1, 5, 2, 3)), "KNIFE": ((0, 1, 3, 4), (1, 5, 3, 4), (1, 2, 3, 6), (1, 3, 5, 6)), "PYRAMID": ((0, 1, 3, 4), (2, 3, 1, 4))}
_G = 1 / math.sqrt(3)
HEX_FACES = [tuple(int(c) for c in side) for side in FACES["HEX"].split()]


def _points(p: Column, n: int) -> list[Vec]:
    return [Vec.of(F.get(p, F.lit(i))) for i in range(n)]


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _sum(values: list[Column]) -> Column:
    return reduce(Column.__add__, values)


def _total(vectors: list[Vec]) -> Vec:
    return reduce(Vec.__add__, vectors)


def _relative(ratio: Column) -> Column:
    """The square of a size ratio or of its inverse, whichever is less; 0 if it isn't positive."""
    least = F.least(ratio, _over(F.lit(1.0), ratio))
    return F.when(ratio > 0, least * least).otherwise(0.0)


def _angle(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def edge(p: Column) -> dict[str, Column]:
    a, b = _points(p, 2)
    return {"length": (b - a).norm()}


def solid(name: str, p: Column) -> dict[str, Column]:
    """The volume of a prism, knife or pyramid."""
    v = _points(p, {"PRISM": 6, "KNIFE": 7, "PYRAMID": 5}[name])
    return {"volume": _sum([det(v[b] - v[a], v[c] - v[a], v[d] - v[a]) for a, b, c, d in PARTS[name]]) / 6}


def triangle(p: Column, size: float = 1.0) -> dict[str, Column]:
    a, b, c = _points(p, 3)
    sides = [b - a, c - b, a - c]
    long, square = [s.norm() for s in sides], [s.dot(s) for s in sides]
    double, most = sides[0].cross(sides[2]).norm(), F.greatest(*long)
    condition = _over(square[0] + square[2] + sides[0].dot(sides[2]), double * math.sqrt(3))
    # the least angle lies opposite the shortest side; its cosine is the largest
    cosines = [_over(square[i - 1] + square[i - 2] - square[i], 2 * long[i - 1] * long[i - 2]) for i in range(3)]
    shape, relative = _over(F.lit(1.0), condition), _relative(double / 2 / size)
    return {
        "area": double / 2,
        "relative_size_squared": relative,
        "shape_and_size": shape * relative,
        "distortion": F.when(double > 0, 1.0),
        "maximum_angle": _angle(F.least(*cosines)),
        "edge_ratio": _over(most, F.least(*long)),
        "aspect_ratio": _over(most * _sum(long) * (math.sqrt(3) / 6), double),
        "radius_ratio": _over(square[0] * square[1] * square[2] * _sum(square) / 4, double * double),
        "aspect_frobenius": _over(_sum(square), 2 * math.sqrt(3) * double),
        "condition": condition,
        "shape": shape,
        "scaled_jacobian": _over(double * (2 / math.sqrt(3)), F.greatest(*[x * y for x, y in combinations(long, 2)])),
        "minimum_angle": F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(*cosines)))),
    }


def quadrilateral(p: Column) -> dict[str, Column]:
    q = _points(p, 4)
    edges = [q[(i + 1) % 4] - q[i] for i in range(4)]
    long = [e.norm() for e in edges]
    x1, x2 = q[1] + q[2] - q[3] - q[0], q[2] + q[3] - q[0] - q[1]
    normals = [edges[i - 1].cross(edges[i]) for i in range(4)]
    centre = x1.cross(x2).unit()
    areas = [n.dot(centre) for n in normals]
    units = [n.unit() for n in normals]
    fold = F.least(units[0].dot(units[2]), units[1].dot(units[3]))
    diagonals = [(q[2] - q[0]).norm(), (q[3] - q[1]).norm()]
    square = [x * x for x in long]
    crosses = [n.norm() for n in normals]
    frobenius = [_over(square[i - 1] + square[i], crosses[i]) for i in range(4)]
    scaled = F.least(*[_over(areas[i], long[i - 1] * long[i]) for i in range(4)])
    shape = F.greatest(F.lit(0.0), 2 * F.least(*[_over(areas[i], square[i - 1] + square[i]) for i in range(4)]))
    whole = _sum(areas) / 4

    def oddy(i: int) -> Column:
        u, v = edges[i], edges[i - 1]
        g, h, k = u.dot(u), u.dot(v), v.dot(v)
        return _over((g - k) * (g - k) + 4 * h * h, 2 * (g * k - h * h))

    # the turn at a corner; more than half of one where the corner's area is negative
    turns = [_angle(_over(edges[i - 1].dot(edges[i]), -long[i - 1] * long[i])) for i in range(4)]
    turns = [F.when(areas[i] < 0, 360 - t).otherwise(t) for i, t in enumerate(turns)]

    # thin limit: the map's slope along the mean of the corners' normals, at four inner points and the corners
    def slope(u: float, v: float) -> Vec:
        w = [(1 + x * u, 1 + y * v, x, y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        return _total([r.scale(x * b / 4) for r, (_, b, x, _) in zip(q, w, strict=True)]).cross(_total([r.scale(y * a / 4) for r, (a, _, _, y) in zip(q, w, strict=True)]))

    inner = [(x * _G, y * _G) for x in (-1, 1) for y in (-1, 1)]
    at = [slope(*g) for g in inner]
    mean = [_total([n.scale((1 + x * u) * (1 + y * v) / 4) for n, (x, y) in zip(units, ((-1, -1), (1, -1), (1, 1), (-1, 1)), strict=True)]) for u, v in inner]
    worst = F.least(*[s.dot(m) for s, m in zip(at, mean, strict=True)], *[F.signum(areas[i]) * crosses[i] / 4 for i in range(4)])
    return {
        "area": whole,
        "edge_ratio": _over(F.greatest(*long), F.least(*long)),
        "max_edge_ratio": _over(F.greatest(x1.norm(), x2.norm()), F.least(x1.norm(), x2.norm())),
        "aspect_ratio": _over(F.greatest(*long) * _sum(long) / 2, crosses[1] + crosses[3]),
        "radius_ratio": _over(F.sqrt(_sum(square) * F.greatest(*square, *[d * d for d in diagonals])), F.least(*crosses)) / (2 * math.sqrt(2)),
        "med_aspect_frobenius": _sum(frobenius) / 8,
        "max_aspect_frobenius": F.greatest(*frobenius) / 2,
        "skew": F.abs(x1.unit().dot(x2.unit())),
        "taper": _over((q[0] + q[2] - q[1] - q[3]).norm(), F.least(x1.norm(), x2.norm())),
        "warpage": fold * fold * fold,
        "stretch": _over(F.least(*long) * math.sqrt(2), F.greatest(*diagonals)),
        "oddy": F.greatest(*[oddy(i) for i in range(4)]),
        "jacobian": F.least(*areas),
        "scaled_jacobian": scaled,
        "shear": F.greatest(F.lit(0.0), scaled),
        "condition": F.greatest(*[_over(square[i - 1] + square[i], areas[i]) for i in range(4)]) / 2,
        "shape": shape,
        # the reference size of a quadrilateral is its own area
        "relative_size_squared": F.when(whole > 0, 1.0).otherwise(0.0),
        "shape_and_size": F.when(whole > 0, shape).otherwise(0.0),
        "shear_and_size": F.when(whole > 0, F.greatest(F.lit(0.0), scaled)).otherwise(0.0),
        "minimum_angle": F.least(*turns),
        "maximum_angle": F.greatest(*turns),
        "distortion": _over(4 * worst, _sum([s.norm() for s in at])),
    }


def tetrahedron(p: Column, size: float = 1.0) -> dict[str, Column]:
    a, b, c, d = _points(p, 4)
    ab, ac, ad, bc, bd, cd = b - a, c - a, d - a, c - b, d - b, d - c
    edges = {"ab": ab, "ac": ac, "ad": ad, "bc": bc, "bd": bd, "cd": cd}
    long, square = {k: e.norm() for k, e in edges.items()}, {k: e.dot(e) for k, e in edges.items()}
    jacobian = det(ab, ac, ad)
    nodes = [_product([long[k] for k in long if name in k]) for name in "abcd"]
    faces = _sum([ab.cross(ac).norm(), ab.cross(ad).norm(), ac.cross(ad).norm(), bc.cross(bd).norm()])
    own, dots = square["ab"] + square["ac"] + square["ad"], ab.dot(ac) + ac.dot(ad) + ad.dot(ab)
    centre = ac.cross(ad).scale(square["ab"]) + ad.cross(ab).scale(square["ac"]) + ab.cross(ac).scale(square["ad"])
    mean = F.sqrt(_sum(list(square.values())) / 6)
    # the element seen from a regular one
    basis = [ab, (ac.scale(2) - ab).scale(1 / math.sqrt(3)), (ad.scale(3) - ac - ab).scale(1 / math.sqrt(6))]
    t1, t2 = _sum([x.dot(x) for x in basis]), _sum([c.dot(c) for c in (basis[0].cross(basis[1]), basis[1].cross(basis[2]), basis[0].cross(basis[2]))])
    shape = F.when(jacobian > 0, _over(3 * F.pow(jacobian * math.sqrt(2), 2 / 3), 1.5 * own - dots)).otherwise(0.0)
    relative = _relative(jacobian / 6 / size)
    out = [n.unit() for n in (ab.cross(ac), ad.cross(ab), ac.cross(ad), bd.cross(bc))]  # all inward, or all outward
    dihedral = [_angle(-x.dot(y)) for x, y in combinations(out, 2)]

    def collapse(edge: Vec, n: Vec, *sides: str) -> Column:
        return _over(edge.dot(n), n.norm() * F.greatest(*[long[k] for k in sides]))

    # fixed values: the sides whose longest counts for each face, as the metric is defined
    heights = [collapse(ad, ab.cross(ac), "bd", "ab", "ac"), collapse(ac, ad.cross(ab), "ab", "ad", "bc"), collapse(ab, ac.cross(ad), "ad", "ac", "cd"), collapse(ab, bc.cross(bd), "bd", "bc", "cd")]
    beta = _over(centre.norm() * faces / 2, 3 * jacobian * jacobian)
    return {
        "volume": jacobian / 6,
        "condition": _over(F.sqrt(t1 * t2), 3 * det(*basis)),
        "shape": shape,
        "relative_size_squared": relative,
        "shape_and_size": shape * relative,
        "aspect_beta": F.when(jacobian > 0, beta),
        "collapse_ratio": F.least(*heights),
        "minimum_angle": F.least(*dihedral),
        "distortion": F.when(jacobian > 0, 1.0),
        "jacobian": jacobian,
        "scaled_jacobian": _over(jacobian * math.sqrt(2), F.greatest(*nodes, F.abs(jacobian))),
        "edge_ratio": _over(F.greatest(*long.values()), F.least(*long.values())),
        "radius_ratio": _over(centre.norm() * faces / 2, 3 * jacobian * jacobian),
        "aspect_ratio": _over(F.greatest(*long.values()) * faces * (math.sqrt(6) / 12), F.abs(jacobian)),
        "aspect_gamma": _over(mean * mean * mean, jacobian * math.sqrt(2)),
        "aspect_frobenius": _over(1.5 * own - dots, 3 * F.cbrt(2 * jacobian * jacobian)),
    }


def _product(values: list[Column]) -> Column:
    return reduce(Column.__mul__, values)


def _hex_parts(p: Column) -> Column:
    """What the metrics of a hexahedron share, computed once.

    f has for the middle and each corner the determinant d of the edges there, the sum q of their squares, r of
    the squares of their cross products, o of the squares of all their products, and the product n of their lengths.
    """
    v = _points(p, 8)
    sums = lambda plus: _total([v[i] for i in plus]) - _total([v[i] for i in range(8) if i not in plus])
    between = lambda pairs: F.array(*[(v[j] - v[i]).norm() for i, j in pairs])
    named = lambda vectors: F.struct(*[x.struct().alias(f"x{i}") for i, x in enumerate(vectors)])
    of = lambda s, n: [Vec.of(s[f"x{i}"]) for i in range(n)]
    axes = [sums(plus) for plus in ((1, 2, 5, 6), (2, 3, 6, 7), (4, 5, 6, 7))]
    frames = F.array(named(axes), *[named([v[j] - v[i] for j in ends]) for i, ends in enumerate(HEX_CORNERS)])

    def frame(s: Column) -> Column:
        f = of(s, 3)
        products = {(i, j): f[i].dot(f[j]) for i in range(3) for j in range(i, 3)}
        square = F.struct(*[products[i, i].alias(f"s{i}") for i in range(3)], *[products[i, j].alias(f"s{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))], det(*f).alias("d"))

        def done(t: Column) -> Column:
            g, h = [t[f"s{i}"] for i in range(3)], {(i, j): t[f"s{i}{j}"] for i, j in ((0, 1), (0, 2), (1, 2))}
            # the square of a cross product is that of the lengths less that of the dot product
            areas = [g[i] * g[j] - x * x for (i, j), x in h.items()]
            return F.struct(t["d"].alias("d"), _sum(g).alias("q"), _sum(areas).alias("r"), (_sum([x * x for x in g]) + 2 * _sum([x * x for x in h.values()])).alias("o"), F.sqrt(_product(g)).alias("n"))

        return let(square, done)

    # how the volume grows with each corner: the faces at a corner, each begun there
    turned = [[v[f[(f.index(i) + k) % 4]] for f in HEX_FACES if i in f for k in (1, 2, 3)] for i in range(8)]

    def grow(s: Column) -> Column:
        w = of(s, 9)
        return _total([b.cross(c) + c.cross(d) + b.cross(d) for b, c, d in (w[:3], w[3:6], w[6:])]).scale(1 / 12).struct()

    grads = F.transform(F.array(*map(named, turned)), grow)
    rows = [(a, b, c) for c in (-1, 1) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    spots = F.array(*[F.struct(*[F.lit(c * _G).alias(n) for c, n in zip(at, "xyz", strict=True)]) for at in rows])

    def slope(at: Column) -> Column:
        near = lambda row, j: 1 + row[j] * at["xyz"[j]]
        along = [_total([r.scale(near(row, (axis + 1) % 3) * near(row, (axis + 2) % 3) * (row[axis] / 8)) for r, row in zip(v, rows, strict=True)]) for axis in range(3)]
        return let(named(along), lambda s: det(*of(s, 3)))

    return F.struct(
        named(axes).alias("axes"),
        *[t.norm().alias(k) for k, t in (("t01", sums((0, 2, 4, 6))), ("t02", sums((0, 3, 5, 6))), ("t12", sums((0, 1, 6, 7))))],
        between(HEX_EDGES).alias("edges"),
        between(HEX_DIAGONALS).alias("diagonals"),
        F.transform(frames, frame).alias("f"),
        grads.alias("grads"),
        F.transform(spots, slope).alias("inner"),
    )


def _hex_metrics(p: Column, s: Column, size: float) -> dict[str, Column]:
    axes = [Vec.of(s["axes"][f"x{i}"]) for i in range(3)]
    widths = [a.norm() for a in axes]
    corners = F.slice(s["f"], 2, 8)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    volume, least = F.get(s["f"], F.lit(0))["d"] / 64, F.array_min(F.transform(corners, lambda f: f["d"]))
    conditions = F.transform(corners, lambda f: _over(F.sqrt(f["q"] * f["r"]), f["d"]))
    whole = F.forall(conditions, lambda c: c.isNotNull())
    oddy = F.array_max(F.transform(s["f"], lambda f: F.when(f["d"] > 0, _over(f["o"] - f["q"] * f["q"] / 3, F.pow(f["d"], 4 / 3)))))
    shapes = F.array_min(F.transform(s["f"], lambda f: F.when(f["d"] > 0, _over(3 * F.pow(f["d"], 2 / 3), f["q"])).otherwise(0.0)))
    scaled = F.array_min(F.transform(s["f"], lambda f: _over(f["d"], f["n"])))
    shear, relative = F.greatest(F.lit(0.0), scaled), _relative(total(F.transform(corners, lambda f: f["d"])) / 8 / size)
    return {
        "volume": volume,
        "edge_ratio": _over(F.array_max(s["edges"]), F.array_min(s["edges"])),
        "max_edge_ratio": _over(F.greatest(*widths), F.least(*widths)),
        "skew": F.greatest(*[F.abs(a.unit().dot(b.unit())) for a, b in combinations(axes, 2)]),
        "taper": F.greatest(*[_over(s[f"t{i}{j}"], F.least(widths[i], widths[j])) for i, j in combinations(range(3), 2)]),
        "stretch": _over(F.array_min(s["edges"]) * math.sqrt(3), F.array_max(s["diagonals"])),
        "diagonal": _over(F.array_min(s["diagonals"]), F.array_max(s["diagonals"])),
        "dimension": F.sqrt(_over(F.pow(total(F.zip_with(F.slice(p, 1, 8), s["grads"], lambda v, g: v["x"] * g["x"])), 2) / 2, total(F.transform(s["grads"], lambda g: Vec.of(g).dot(Vec.of(g)))))),
        "oddy": F.when(F.forall(s["f"], lambda f: f["d"] > 0), F.greatest(F.lit(0.0), oddy)),
        "med_aspect_frobenius": F.when(whole, total(conditions) / 24),
        "condition": F.when(whole, F.array_max(conditions) / 3),
        "max_aspect_frobenius": F.when(whole, F.array_max(conditions) / 3),
        "jacobian": F.least(volume, least),
        "scaled_jacobian": scaled,
        "shear": shear,
        "shape": shapes,
        "relative_size_squared": relative,
        "shape_and_size": shapes * relative,
        "shear_and_size": shear * relative,
        "distortion": _over(F.least(least / 8, F.array_min(s["inner"])) * 8, total(s["inner"])),
    }


def hexahedron(p: Column, size: float = 1.0) -> Column:
    """All metrics as the fields of one value, so that what they share is computed once a row."""
    return let(_hex_parts(p), lambda s: F.struct(*[c.alias(k) for k, c in _hex_metrics(p, s, size).items()]))


#: The metrics of each type.
METRICS = {"EDGE": edge, "TRI": triangle, "QUAD": quadrilateral, "TET": tetrahedron, "HEX": hexahedron, **{n: lambda p, n=n: solid(n, p) for n in PARTS}}


def measures(name: str, p: Column, **size: float) -> Column:
    """Every metric of an element type as the fields of one value; an error for types without metrics."""
    if name not in METRICS:
        raise MeshError(f"no quality metrics of {name}")
    found = METRICS[name](p, **size)
    return found if isinstance(found, Column) else F.struct(*[c.alias(k) for k, c in found.items()])
