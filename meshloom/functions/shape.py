"""Shape functions as columns: weights of the nodes, values, integrals and the inverse map.

Elements are of first order, or of second order if a number of nodes says so. Local coordinates (u, v, w) run from
-1 to 1 in edges, quadrilaterals and hexahedra and from 0 in triangles and tetrahedra, where a corner is the
origin and u + v + w is 1 at most. A prism is a triangle in (u, v) times an edge in w; a pyramid is a hexahedron
whose upper face has shrunk to its tip, at w = 1 for any (u, v).
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ETYPES, MeshError
from .numbering import positions_of
from .vector import Vec, det

# Local coordinates of the corners, in canonical order.
CUBE = {"EDGE": ((-1,), (1,)), "QUAD": ((-1, -1), (1, -1), (1, 1), (-1, 1)), "HEX": ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))}
SIMPLEX = {"TRI": 2, "TET": 3}
_SOLIDS = {"PRISM": 6, "PYRAMID": 5}
# Node counts of second order, after the corners nodes on edges, then (9, 27) on faces and inside.
SECOND = {"EDGE": (3,), "TRI": (6,), "QUAD": (8, 9), "TET": (10,), "HEX": (20, 27)}
NEWTON_STEPS = 10


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _local(at: Column) -> list[Column]:
    return [at["u"], at["v"], at["w"]]


def point(u: Column | float, v: Column | float = 0.0, w: Column | float = 0.0) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for x, n in ((u, "u"), (v, "v"), (w, "w"))])


def dimension_of(name: str) -> int:
    return SIMPLEX.get(name) or (3 if name in _SOLIDS else len(CUBE[name][0]))


def _first_order(name: str, x: list) -> list:
    """Weights of the corners, of anything that adds and multiplies."""
    one = x[0] * 0 + 1
    if name in SIMPLEX:
        x = x[: SIMPLEX[name]]
        return [reduce(lambda a, b: a - b, x, one), *x]
    if name in CUBE:
        n = len(CUBE[name][0])
        return [reduce(lambda a, b: a * b, [(1 + c * y) for c, y in zip(corner, x, strict=False)]) / 2**n for corner in CUBE[name]]
    u, v, w = x
    if name == "PRISM":
        return [k * (1 + end * w) / 2 for end in (-1, 1) for k in (1 - u - v, u, v)]
    if name == "PYRAMID":
        return [(1 + a * u) * (1 + b * v) * (1 - w) / 8 for a, b in CUBE["QUAD"]] + [(1 + w) / 2 + 0 * u]
    raise MeshError(f"no shape functions of {name}")


def _second_order(name: str, n: int, x: list) -> list:
    """Weights of corners and middle nodes, in canonical order."""
    if n not in SECOND.get(name, ()):
        raise MeshError(f"no shape functions of {name} with {n} nodes")
    if name in SIMPLEX:
        c = _first_order(name, x)
        return [k * (2 * k - 1) for k in c] + [4 * c[i] * c[j] for i, j in positions_of(name, 1)]
    d = len(CUBE[name][0])
    corner = CUBE[name]
    nodes = list(corner) + [tuple((a + b) // 2 for a, b in zip(corner[i], corner[j], strict=True)) for i, j in (positions_of(name, 1) if d > 1 else [(0, 1)])]
    if n in (9, 27):
        faces = positions_of(name, 2) if d == 3 else []
        nodes += [tuple(sum(corner[i][k] for i in f) // 4 for k in range(3)) for f in faces] + [(0,) * d]
    if n in (3, 9, 27):  # products of parabolas
        parabola = lambda c, y: (1 - y * y) if c == 0 else y * (y + c) / 2
        return [reduce(lambda a, b: a * b, [parabola(c, y) for c, y in zip(node, x, strict=False)]) for node in nodes]
    out = []
    for node in nodes:  # without nodes on faces: corners lose what the middles of their edges have
        terms = [(1 + c * y) if c else (1 - y * y) for c, y in zip(node, x, strict=False)]
        k = reduce(lambda a, b: a * b, terms)
        if 0 in node:
            out.append(k / 2 ** (d - 1))
        else:
            out.append(k * (sum((c * y for c, y in zip(node, x, strict=False)), x[0] * 0) - (d - 1)) / 2**d)
    return out


def shape_weights(name: str, at: Column, n: int | None = None) -> list[Column]:
    """The weight of each node at local coordinates (u, v, w); n nodes, or the corners only."""
    x = _local(at)
    return _first_order(name, x) if n is None or n == nodes_of(name) else _second_order(name, n, x)


def nodes_of(name: str) -> int:
    return _SOLIDS.get(name) or (SIMPLEX[name] + 1 if name in SIMPLEX else len(CUBE[name]) if name in CUBE else 0)


class _Dual:
    """A column with its derivatives: what polynomials of local coordinates need."""

    def __init__(self, value, slope: list):
        self.value, self.slope = value, slope

    @staticmethod
    def _of(x, n: int) -> _Dual:
        return x if isinstance(x, _Dual) else _Dual(x, [0] * n)

    def __add__(self, o):
        o = self._of(o, len(self.slope))
        return _Dual(self.value + o.value, [_plus(a, b) for a, b in zip(self.slope, o.slope, strict=True)])

    def __mul__(self, o):
        o = self._of(o, len(self.slope))
        return _Dual(self.value * o.value, [_plus(_times(a, o.value), _times(b, self.value)) for a, b in zip(self.slope, o.slope, strict=True)])

    def __neg__(self):
        return self * -1

    def __sub__(self, o):
        return self + (-o if isinstance(o, _Dual) else -1 * o)

    def __rsub__(self, o):
        return -self + o

    def __truediv__(self, o):
        return self * (1 / o)

    __radd__, __rmul__ = __add__, __mul__


def _plus(a, b):
    return b if _zero(a) else a if _zero(b) else a + b


def _times(a, b):
    return 0 if _zero(a) or _zero(b) else a * b


def _zero(x) -> bool:
    return isinstance(x, (int, float)) and x == 0


def slopes(name: str, at: Column, n: int | None = None) -> list[list[Column]]:
    """For each local direction the derivatives of all nodes' weights."""
    d = dimension_of(name)
    x = [_Dual(c, [1 if i == k else 0 for i in range(d)]) for k, c in enumerate(_local(at)[:d])]
    w = _first_order(name, x) if n is None or n == nodes_of(name) else _second_order(name, n, x)
    column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return [[column(k.slope[i]) for k in w] for i in range(d)]


def _corners(p: Column, n: int) -> list[Vec]:
    return [Vec.of(F.get(p, F.lit(i))) for i in range(n)]


def _weighted(w: list[Column], v: list[Vec]) -> Vec:
    return reduce(Vec.__add__, [a.scale(k) for k, a in zip(w, v, strict=True)])


def evaluate(name: str, values: Column, at: Column, n: int | None = None) -> Column:
    """The value at local coordinates of a field with the array values at the nodes."""
    w = shape_weights(name, at, n)
    return reduce(Column.__add__, [F.get(values, F.lit(i)) * k for i, k in enumerate(w)])


def place(name: str, p: Column, at: Column, n: int | None = None) -> Vec:
    """The position of local coordinates in the element with nodes p."""
    w = shape_weights(name, at, n)
    return _weighted(w, _corners(p, len(w)))


def jacobian(name: str, p: Column, at: Column, n: int | None = None) -> Column:
    """The determinant of the map: length, area or volume for each unit of the local coordinates."""
    d = slopes(name, at, n)
    axes = [_weighted(s, _corners(p, len(s))) for s in d]
    if len(axes) == 1:
        return axes[0].norm()
    return axes[0].cross(axes[1]).norm() if len(axes) == 2 else det(*axes)


def rule(name: str, m: int) -> list[tuple[float, float, float, float]]:
    """Points (u, v, w) and weights of Gauss's rule with m points along each direction; in simplices and pyramids along the lines to a tip.

    Exact for polynomials up to 2 * m - 1 in each direction, in simplices up to a total of 2 * m - the dimension.
    """
    x, k = (a.tolist() for a in np.polynomial.legendre.leggauss(m))
    d = dimension_of(name)
    if name in CUBE or name == "PYRAMID":
        return [((*[x[i] for i in at], 0.0, 0.0)[:3] + (float(np.prod([k[i] for i in at])),)) for at in product(range(m), repeat=d)]
    half = [((a + 1) / 2, b / 2) for a, b in zip(x, k, strict=True)]
    if name == "TET":
        return [(a, b * (1 - a), c * (1 - a) * (1 - b), p * q * r * (1 - a) ** 2 * (1 - b)) for a, p in half for b, q in half for c, r in half]
    flat = [(a, b * (1 - a), p * q * (1 - a)) for a, p in half for b, q in half]
    if name == "TRI":
        return [(a, b, 0.0, w) for a, b, w in flat]
    return [(a, b, x[i], w * k[i]) for a, b, w in flat for i in range(m)]


def integral(name: str, p: Column, values: Column, n: int | None = None, points: int | None = None) -> Column:
    """The integral of a field over an element, from its values at the nodes.

    By Gauss's rule with so many points along each direction; those taken by default are exact for solids and for flat
    faces of first order, and for those of second order whose edges are straight.
    """
    m = points or {"EDGE": 2, "QUAD": 2, "HEX": 2, "TRI": 2, "TET": 2}.get(name, 3) + (2 if n not in (None, nodes_of(name)) else 0)
    # weights and their derivatives at the points are numbers; they stand in one literal
    spots = F.from_json(F.lit(json.dumps([_at_point(name, n, q) for q in rule(name, m)])), "array<struct<k:double,w:array<double>,s:array<array<double>>>>")
    dot = lambda numbers, f: F.aggregate(F.zip_with(numbers, p, lambda k, v: k * v[f]), F.lit(0.0), lambda acc, y: acc + y)
    field = lambda numbers: F.aggregate(F.zip_with(numbers, values, lambda k, v: k * v), F.lit(0.0), lambda acc, y: acc + y)

    def part(q: Column) -> Column:
        axes = F.transform(q["s"], lambda s: F.struct(*[dot(s, c).alias(c) for c in "xyz"]))

        def size(a: Column) -> Column:
            v = [Vec.of(F.get(a, F.lit(i))) for i in range(dimension_of(name))]
            return v[0].norm() if len(v) == 1 else v[0].cross(v[1]).norm() if len(v) == 2 else det(*v)

        return let(axes, size) * field(q["w"]) * q["k"]

    return F.aggregate(F.transform(spots, part), F.lit(0.0), lambda acc, y: acc + y)


def _at_point(name: str, n: int | None, q: tuple[float, ...]) -> dict:
    d = dimension_of(name)
    x = [_Dual(c, [1.0 if i == k else 0 for i in range(d)]) for k, c in enumerate(q[:d])]
    w = _first_order(name, x) if n is None or n == nodes_of(name) else _second_order(name, n, x)
    return {"k": q[3], "w": [float(k.value) for k in w], "s": [[float(k.slope[i]) for k in w] for i in range(d)]}


def inverse(name: str, p: Column, x: Column, nodes: int | None = None) -> Column:
    """Local coordinates (u, v, w) of the position x (struct x, y, z) in an element with nodes p.

    Exact for triangles and tetrahedra of first order; by NEWTON_STEPS steps of Newton's method for the others, from the
    middle. For faces and edges the nearest point of their plane or line counts. Null for flat elements; the tip of a
    pyramid has the coordinates of its axis.
    """
    target = Vec.of(x)
    straight = name in SIMPLEX and nodes in (None, nodes_of(name))
    steps = 1 if straight else NEWTON_STEPS
    n = dimension_of(name)
    v = _corners(p, nodes or nodes_of(name))
    start = point(0.25, 0.25, 0.25 if n == 3 else 0.0) if name in SIMPLEX and not straight else point(0.25, 0.25, 0.0) if name == "PRISM" else point(0.0)

    def step(at: Column) -> Column:
        axes = [_weighted(s, v).struct() for s in slopes(name, at, nodes)]
        off = (target - _weighted(shape_weights(name, at, nodes), v)).struct()
        bound = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(axes)], off.alias("off"))

        def move(b: Column) -> Column:
            a, o = [Vec.of(b[f"a{i}"]) for i in range(n)], Vec.of(b["off"])
            if n == 3:
                d = F.nullif(det(*a), F.lit(0.0))
                delta = [det(o, a[1], a[2]) / d, det(a[0], o, a[2]) / d, det(a[0], a[1], o) / d]
                if name == "PYRAMID":  # the map is flat at the tip
                    delta = [F.coalesce(c, F.when(o.norm() < 1e-12 * (1 + target.norm()), 0.0)) for c in delta]
            elif n == 2:  # least squares in the plane of the axes
                g, h, k = a[0].dot(a[0]), a[0].dot(a[1]), a[1].dot(a[1])
                d = F.nullif(g * k - h * h, F.lit(0.0))
                q, r = a[0].dot(o), a[1].dot(o)
                delta = [(q * k - r * h) / d, (r * g - q * h) / d, F.lit(0.0)]
            else:
                delta = [a[0].dot(o) / F.nullif(a[0].dot(a[0]), F.lit(0.0)), F.lit(0.0), F.lit(0.0)]
            return point(*[c + e for c, e in zip(_local(at), delta, strict=True)])

        return let(bound, move)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: step(at))


def inside(name: str, at: Column, tolerance: float) -> Column:
    """Whether local coordinates lie in the element, or no farther than the tolerance out of it."""
    x = _local(at)
    if name in SIMPLEX:
        x = x[: SIMPLEX[name]]
        return reduce(Column.__and__, [c >= -tolerance for c in x]) & (reduce(Column.__add__, x) <= 1 + tolerance)
    if name == "PRISM":
        return (x[0] >= -tolerance) & (x[1] >= -tolerance) & (x[0] + x[1] <= 1 + tolerance) & (F.abs(x[2]) <= 1 + tolerance)
    if name == "PYRAMID":  # next to the tip u and v lose their meaning
        return (F.abs(x[2]) <= 1 + tolerance) & (F.greatest(F.abs(x[0]), F.abs(x[1])) * (1 - x[2]) <= 1 - x[2] + tolerance)
    return reduce(Column.__and__, [F.abs(c) <= 1 + tolerance for c in x[: len(CUBE[name][0])]])


KINDS = ("EDGE", "TRI", "QUAD", "TET", "PYRAMID", "PRISM", "HEX")


def by_type(etype: Column, f) -> Column:
    """f(name) for the element's type, null for types without shape functions."""
    out = None
    for name in KINDS:
        out = (F.when if out is None else out.when)(etype == ETYPES[name], f(name))
    return out
