"""Sides of elements as column expressions over ordered connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DIMENSIONS, ETYPES, MeshError

# Vertex positions of each type's edges and faces, in canonical order (3D faces outward).
EDGES = {
    "TRI": "01 12 20",
    "QUAD": "01 12 23 30",
    "TET": "01 12 20 03 13 23",
    "PYRAMID": "01 12 23 30 04 14 24 34",
    "PRISM": "01 12 20 03 14 25 34 45 53",
    "KNIFE": "01 12 23 30 04 15 26 35 45 56",
    "HEX": "01 12 23 30 04 15 26 37 45 56 67 74",
}
FACES = {
    "TET": "013 123 032 021",
    "PYRAMID": "014 124 234 304 0321",
    "PRISM": "0143 1254 0352 021 345",
    "KNIFE": "0154 1265 2356 3045 0321",
    "HEX": "0154 1265 2376 3047 0321 4567",
}
# Corner vertices of each type with a set number of them.
CORNERS = {"VERTEX": 1, "EDGE": 2, "TRI": 3, "QUAD": 4, "TET": 4, "PYRAMID": 5, "PRISM": 6, "KNIFE": 7, "HEX": 8}


def corners(etype: Column, conn: Column) -> Column:
    """The corner vertices: conn without mid-side nodes."""
    out = conn
    for name, n in CORNERS.items():
        out = F.when(etype == ETYPES[name], F.slice(conn, 1, n)).otherwise(out)
    return out


def sides(etype: Column, conn: Column, dim: int) -> Column:
    """An array of the connectivities of the element's sides of dimension dim (1 or 2).

    Elements of that dimension are their own side; polygon edges run around the polygon; types without such
    sides have an empty array.
    """
    if dim not in (1, 2):
        raise MeshError("sides have dimension 1 or 2")
    n = F.size(conn)
    around = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(conn, i), F.get(conn, (i + 1) % n)))
    none = F.array().cast("array<array<bigint>>")
    own = ["EDGE"] if dim == 1 else ["TRI", "QUAD", "POLYGON"]
    out = F.when(etype.isin([ETYPES[x] for x in own]), F.array(conn))
    if dim == 1:
        out = out.when((etype == ETYPES["POLYGON"]) & (n >= 3), around)
    for name, text in (EDGES if dim == 1 else FACES).items():
        out = out.when(etype == ETYPES[name], F.array(*[F.array(*[F.get(conn, F.lit(int(c))) for c in side]) for side in text.split()]))
    return out.otherwise(none)


def side_etype(conn: Column) -> Column:
    """The entity type of a side, from its number of corners."""
    n = F.size(conn)
    return F.when(n == 2, ETYPES["EDGE"]).when(n == 3, ETYPES["TRI"]).when(n == 4, ETYPES["QUAD"]).otherwise(ETYPES["POLYGON"])


def forward(conn: Column) -> Column:
    """Whether the cycle, begun at its least vertex, goes on to the lesser of that vertex's two neighbours.

    Two sides with the same vertices have the same sense if this agrees, else opposite senses.
    """
    n, at = F.size(conn), F.array_position(conn, F.array_min(conn)).cast("int") - 1
    following, before = F.get(conn, (at + 1) % n), F.get(conn, (at + n - 1) % n)
    return F.when(n == 2, F.get(conn, F.lit(0)) <= F.get(conn, F.lit(1))).otherwise(following <= before)


def explode_sides(elem: DataFrame, dim: int) -> DataFrame:
    """(etype, id, side, conn, key): key has the side's vertices in rising order, so equal sides have equal keys.

    Sides that collapse to a repeated vertex in an edge are left out.
    """
    rows = elem.select("etype", "id", F.posexplode(sides(F.col("etype"), corners(F.col("etype"), F.col("conn")), dim)).alias("side", "conn"))
    rows = rows.withColumn("key", F.array_sort("conn"))
    return rows.filter((F.size("conn") > 2) | (F.get("conn", F.lit(0)) != F.get("conn", F.lit(1))))


# The opposite of each side of the types that have one, as (dimension, number), by dimension and number.
OPPOSITE = {
    "TRI": {0: ((1, 1), (1, 2), (1, 0)), 1: ((0, 2), (0, 0), (0, 1))},
    "QUAD": {0: ((0, 2), (0, 3), (0, 0), (0, 1)), 1: ((1, 2), (1, 3), (1, 0), (1, 1))},
    "TET": {0: ((2, 1), (2, 2), (2, 0), (2, 3)), 1: ((1, 5), (1, 3), (1, 4), (1, 1), (1, 2), (1, 0)), 2: ((0, 2), (0, 0), (0, 1), (0, 3))},
    "HEX": {0: ((0, 6), (0, 7), (0, 4), (0, 5), (0, 2), (0, 3), (0, 0), (0, 1)), 1: ((1, 10), (1, 11), (1, 8), (1, 9), (1, 6), (1, 7), (1, 4), (1, 5), (1, 2), (1, 3), (1, 0), (1, 1)), 2: ((2, 2), (2, 3), (2, 0), (2, 1), (2, 5), (2, 4))},
}


def positions_of(name: str, dim: int) -> list[tuple[int, ...]]:
    """The vertex positions of each side of dimension dim of a type, in canonical order; its own corners for its own dimension."""
    if dim == 0:
        return [(i,) for i in range(CORNERS[name])]
    if dim == DIMENSIONS[ETYPES[name]]:
        return [tuple(range(CORNERS[name]))]
    table = EDGES if dim == 1 else FACES
    if name not in table:
        raise MeshError(f"{name} has no sides of dimension {dim}")
    return [tuple(int(c) for c in side) for side in table[name].split()]


def adjacent_sides(name: str, side_dim: int, sides: list[int], to_dim: int, mode: str = "INTERSECT") -> list[int]:
    """Numbers of the sides of dimension to_dim that touch all (INTERSECT) or any (UNION) of the given sides of one type.

    A lower side touches one that holds it; a higher one, one that it holds; one of the same dimension, itself.
    """
    own, to = positions_of(name, side_dim), positions_of(name, to_dim)

    def touches(a: int, b: int) -> bool:
        x, y = set(own[a]), set(to[b])
        return x <= y if side_dim <= to_dim else y <= x

    every = {"INTERSECT": all, "UNION": any}[mode]
    return [b for b in range(len(to)) if sides and every(touches(a, b) for a in sides)]


def opposite_side(name: str, dim: int, side: int) -> tuple[int, int]:
    """(dimension, number) of the side across the element from a side."""
    try:
        return OPPOSITE[name][dim][side]
    except (KeyError, IndexError):
        raise MeshError(f"side {side} of dimension {dim} of {name} has no opposite") from None


def side_number(etype: Column, conn: Column, child: Column, dim: int) -> Column:
    """(side, sense, offset) of a side (its ordered vertices) in an element; null if it is none of its sides.

    sense is 1 if the side runs as the canonical one does, -1 if against it; offset is the place in the
    canonical side of the child's first vertex.
    """
    every = F.transform(sides(etype, corners(etype, conn), dim), lambda s, i: F.struct(i.alias("side"), s.alias("conn")))
    key = F.array_sort(child)
    found = F.get(F.filter(every, lambda s: F.array_sort(s["conn"]) == key), F.lit(0))
    sense = F.when(forward(found["conn"]) == forward(child), 1).otherwise(-1)
    offset = F.array_position(found["conn"], F.get(child, F.lit(0))).cast("int") - 1
    return F.when(found.isNotNull(), F.struct(found["side"].alias("side"), sense.alias("sense"), offset.alias("offset")))


def _mid_counts(name: str) -> tuple[int, int, int]:
    dim = DIMENSIONS[ETYPES[name]]
    return tuple(len(positions_of(name, d)) if d <= dim else 0 for d in (1, 2, 3))


def has_mid_nodes(name: str, n: int) -> tuple[bool, bool, bool]:
    """Whether an element of n nodes has nodes on its edges, its faces and inside."""
    rest, counts = n - CORNERS[name], _mid_counts(name)
    for mask in range(8):
        flags = tuple(bool(mask >> d & 1) for d in range(3))
        if all(c or not f for c, f in zip(counts, flags, strict=True)) and sum(c for c, f in zip(counts, flags, strict=True) if f) == rest:
            return flags
    raise MeshError(f"{name} has no form with {n} nodes")


def mid_node_index(name: str, n: int, dim: int, side: int) -> int:
    """The place in conn of the node on a side of dimension 1, 2 or 3 of an element of n nodes."""
    flags, counts = has_mid_nodes(name, n), _mid_counts(name)
    if not flags[dim - 1]:
        raise MeshError(f"{name} of {n} nodes has no nodes on sides of dimension {dim}")
    return CORNERS[name] + sum(counts[d] for d in range(dim - 1) if flags[d]) + side


def mid_node_parent(name: str, n: int, place: int) -> tuple[int, int]:
    """(dimension, side) that the node at a place in conn lies on; a corner is its own."""
    if place < CORNERS[name]:
        return 0, place
    flags, counts, place = has_mid_nodes(name, n), _mid_counts(name), place - CORNERS[name]
    for d in range(3):
        if flags[d]:
            if place < counts[d]:
                return d + 1, place
            place -= counts[d]
    raise MeshError("no such node")


def permuted(values: Column, order: list[int], back: bool = False) -> Column:
    """An array in another order: element i comes from place order[i], or goes there if back."""
    places = [order.index(i) for i in range(len(order))] if back else order
    return F.array(*[F.get(values, F.lit(p)) for p in places])


def rotation(a: Column, b: Column) -> Column:
    """(direct, offset) if cycle b is cycle a rotated (direct true) or reversed and rotated (false); else null.

    offset is the place in b of a's first element.
    """
    n = F.size(a)
    at = F.array_position(b, F.get(a, F.lit(0))).cast("int") - 1
    run = lambda step: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(b, F.pmod(at + step * i, n)))
    fits = (n == F.size(b)) & (n > 0) & (at >= 0)
    return F.when(fits & (run(1) == a), F.struct(F.lit(True).alias("direct"), at.alias("offset"))).when(fits & (run(-1) == a), F.struct(F.lit(False).alias("direct"), at.alias("offset")))
