"""New meshes from old ones: uniform refinement, mid-side nodes, smoothing, the dual, boxes cut into parts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import CORNERS, corners, explode_sides, positions_of
from ..model import DIMENSIONS, ETYPES, Mesh, MeshError, dimension, elem_vertex
from ..storage import numbered, written
from .adjacency import skin_vertices
from .sets import components

ID = ["etype", "id"]
Point = tuple[int, ...]  # the weight of each corner, in n-ths (simplices, edges) or in n**dim-ths


def _lattice(name: str, n: int) -> tuple[list[Point], list[list[Point]]]:
    """Points and children of an element cut into n along each edge; a point is the weights of the corners."""
    dim = DIMENSIONS[ETYPES[name]]
    if name in ("EDGE", "QUAD", "HEX"):
        unit = {"EDGE": ((0,), (1,)), "QUAD": ((0, 0), (1, 0), (1, 1), (0, 1))}.get(name) or tuple((a, b, c) for c in (0, 1) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))

        def at(p: tuple[int, ...]) -> Point:
            return tuple(reduce(int.__mul__, [x if u else n - x for u, x in zip(corner, p, strict=True)]) for corner in unit)

        cells = list(product(range(n), repeat=dim))
        return [at(p) for p in product(range(n + 1), repeat=dim)], [[at(tuple(a + b for a, b in zip(c, u, strict=True))) for u in unit] for c in cells]
    if name == "TRI":
        at3 = lambda i, j: (n - i - j, i, j)
        up = [[at3(i, j), at3(i + 1, j), at3(i, j + 1)] for i in range(n) for j in range(n - i)]
        down = [[at3(i + 1, j), at3(i + 1, j + 1), at3(i, j + 1)] for i in range(n - 1) for j in range(n - 1 - i)]
        return [at3(i, j) for i in range(n + 1) for j in range(n + 1 - i)], up + down
    if name == "TET":
        at4 = lambda i, j, k: (n - i - j - k, i, j, k)
        points = [at4(i, j, k) for i in range(n + 1) for j in range(n + 1 - i) for k in range(n + 1 - i - j)]
        children = []
        # a cube of the lattice holds a corner tetrahedron, an octahedron cut into four along one diagonal, and an inverted tetrahedron
        for i, j, k in product(range(n), repeat=3):
            a, b, c, d = at4(i, j, k), at4(i + 1, j, k), at4(i, j + 1, k), at4(i, j, k + 1)
            e, f, g, h = at4(i + 1, j + 1, k), at4(i + 1, j, k + 1), at4(i, j + 1, k + 1), at4(i + 1, j + 1, k + 1)
            if i + j + k < n:
                children.append([a, b, c, d])
            if i + j + k < n - 1:
                children += [[b, c, d, f], [c, g, d, f], [c, e, g, f], [b, e, c, f]]
            if i + j + k < n - 2:
                children.append([e, f, g, h])
        return points, [_positive(t) for t in children]
    raise MeshError(f"no refinement of {name}")


def _positive(t: list[Point]) -> list[Point]:
    """The tetrahedron with its corners in an order of positive volume."""
    u, v, w = ([b - a for a, b in zip(t[0][1:], x[1:], strict=True)] for x in t[1:])
    volume = u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])
    return t if volume > 0 else [t[0], t[2], t[1], t[3]]


def _key(conn: Column, point: Point) -> Column:
    """What names a new point in all elements that share it: its corners with their weights."""
    return F.array_sort(F.array(*[F.struct(F.get(conn, F.lit(i)).alias("vid"), F.lit(w).alias("w")) for i, w in enumerate(point) if w]))


def refine(mesh: Mesh, n: int = 2) -> tuple[Mesh, DataFrame]:
    """The mesh with each edge cut into n, and (etype, id, parent_etype, parent_id) of its elements.

    An edge gives n children, a face n * n, a solid n ** 3. Old vertices keep their ids; new ones follow, in
    the order of what they lie between. Elements are numbered anew, by parent. Points that elements share are
    one vertex, found by their corners and weights.
    """
    kinds = [r[0] for r in mesh.elem.select("etype").distinct().collect()]  # at most as many as there are types
    named = [x for x in ETYPES if ETYPES[x] in kinds]
    cells = []
    for name in named:
        total = n if name in ("EDGE", "TRI", "TET") else n ** DIMENSIONS[ETYPES[name]]
        _, children = _lattice(name, n)
        own = mesh.elem.filter(F.col("etype") == ETYPES[name])
        keys = F.array(*[F.array(*[_key(F.col("conn"), p) for p in child]) for child in children])
        cells.append(own.select(F.col("etype").cast("int").alias("etype"), F.col("id").alias("parent"), F.lit(total).alias("total"), F.posexplode(keys).alias("child", "keys")))
    cells = written(reduce(DataFrame.unionByName, cells), "children")
    used = cells.select("etype", "parent", "child", "total", F.posexplode("keys").alias("pos", "key"))
    old, new = F.size("key") == 1, used.filter(F.size("key") > 1)
    # the same point may have weights of other totals in elements of other types: edges and faces agree after reduction
    share = F.transform("key", lambda k: F.struct(k["vid"].alias("vid"), (k["w"] / F.col("total")).alias("w")))
    points = written(new.select(share.alias("key")).distinct(), "points")
    where = points.select("key", F.explode("key").alias("k")).select("key", "k.vid", "k.w").join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    placed = where.groupBy("key").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"])
    top = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = written(numbered(placed, ["key"], "id", top + 1), "new-vertices")
    names = placed.select("key", F.col("id").alias("nid"))
    met = used.filter(old).select("etype", "parent", "child", "pos", F.get("key", F.lit(0))["vid"].alias("nid"))
    met = met.unionByName(new.withColumn("key", share).join(names, "key").select("etype", "parent", "child", "pos", "nid"))
    conn = met.groupBy("etype", "parent", "child").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nid"))), lambda s: s["nid"]).alias("conn"))
    conn = written(numbered(conn, ["parent", "child"], "id", 1, ["etype"]), "refined")
    lineage = conn.select("etype", "id", F.col("etype").alias("parent_etype"), F.col("parent").alias("parent_id"))
    return Mesh(mesh.vertex.unionByName(placed.select("id", *"xyz")), conn.select("etype", "id", "conn")), lineage


def second_order(mesh: Mesh, edges: bool = True, faces: bool = False, solids: bool = False) -> Mesh:
    """The mesh with nodes in the middle of edges, faces and solids, after the corners in conn; tags and sets stay.

    Elements that share a side share its node. Nodes that elements have already beyond their corners go.
    """
    wanted = {1: edges, 2: faces, 3: solids}
    first = corners(F.col("etype"), F.col("conn"))

    def mids(name: str) -> Column:
        out = []
        for d in (1, 2, 3):
            if wanted[d] and d <= DIMENSIONS[ETYPES[name]]:
                out += [F.array_sort(F.array(*[F.get(F.col("conn"), F.lit(i)) for i in side])) for side in positions_of(name, d)]
        return F.array(*out) if out else F.array().cast("array<array<bigint>>")

    keys = None
    for name in CORNERS:
        if name != "VERTEX":
            keys = (F.when if keys is None else keys.when)(F.col("etype") == ETYPES[name], mids(name))
    rows = mesh.elem.withColumn("conn", first).withColumn("keys", F.coalesce(keys, F.array().cast("array<array<bigint>>")))
    new = rows.select(F.explode("keys").alias("key")).distinct()
    where = new.select("key", F.explode("key").alias("vid")).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid").groupBy("key").agg(*[F.avg(c).alias(c) for c in "xyz"])
    top = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = written(numbered(where, ["key"], "id", top + 1), "mid-nodes")
    met = rows.select(*ID, F.posexplode("keys").alias("pos", "key")).join(placed.select("key", F.col("id").alias("nid")), "key")
    more = met.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nid"))), lambda s: s["nid"]).alias("more"))
    elem = rows.join(more, ID, "left").select(*ID, F.concat("conn", F.coalesce("more", F.array().cast("array<bigint>"))).alias("conn"))
    return replace(mesh, vertex=mesh.vertex.unionByName(placed.select("id", *"xyz")), elem=elem)


def first_order(mesh: Mesh) -> Mesh:
    """The mesh with corners only; vertices that no element uses any more stay."""
    return replace(mesh, elem=mesh.elem.withColumn("conn", corners(F.col("etype"), F.col("conn"))))


def smooth(mesh: Mesh, rounds: int = 10, fixed: DataFrame | None = None, tolerance: float = 0.0) -> tuple[Mesh, int]:
    """The mesh after rounds in which each free vertex moves to the mean of the middles of its elements; the rounds done.

    Vertices of the skin, or those of fixed (id), stay. Rounds end once no vertex moves farther than the
    tolerance. Elements of the highest dimension count.
    """
    dim = mesh.elem.agg(F.max(dimension(F.col("etype")))).first()[0]
    elem = mesh.elem.filter(dimension(F.col("etype")) == dim)
    ends = written(elem_vertex(elem).select(*ID, "vid").distinct(), "ends")
    still = fixed.select("id") if fixed is not None else skin_vertices(elem, dim - 1)
    free = written(ends.select(F.col("vid").alias("id")).distinct().join(still, "id", "left_anti"), "free")
    vertex = mesh.vertex
    for n in range(1, rounds + 1):
        middle = ends.join(vertex.withColumnRenamed("id", "vid"), "vid").groupBy(*ID).agg(*[F.avg(c).alias(c) for c in "xyz"])
        to = ends.join(free.withColumnRenamed("id", "vid"), "vid", "left_semi").join(middle, ID).groupBy(F.col("vid").alias("id")).agg(*[F.avg(c).alias("n" + c) for c in "xyz"])
        far = sum(((F.coalesce("n" + c, c) - F.col(c)) * (F.coalesce("n" + c, c) - F.col(c)) for c in "xyz"), F.lit(0.0))
        moved = written(vertex.join(to, "id", "left").select("id", *[F.coalesce("n" + c, c).alias(c) for c in "xyz"], far.alias("far")), "smoothed")
        vertex = moved.select("id", *"xyz")
        if (moved.agg(F.max("far")).first()[0] or 0.0) <= tolerance * tolerance:
            break
    return replace(mesh, vertex=vertex), n


def dual(mesh: Mesh, dim: int) -> Mesh:
    """The dual of elements of dimension dim: a vertex in the middle of each, an edge for each side that two share.

    Dual vertices have the ids of their elements, edges are numbered by them. Elements of several types must
    not share ids.
    """
    elem = mesh.elem.filter(dimension(F.col("etype")) == dim)
    rows = elem.select(F.col("id"), F.explode(F.array_distinct("conn")).alias("vid")).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    vertex = rows.groupBy("id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    both = explode_sides(elem, dim - 1).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n = 2")
    edge = numbered(both.select("a", "b", "key"), ["a", "b", "key"], "id")
    return Mesh(vertex, edge.select(F.lit(ETYPES["EDGE"]).alias("etype"), "id", F.array("a", "b").alias("conn")))


def chords(elem: DataFrame) -> DataFrame:
    """(key, chord): sides that opposite sides of quadrilaterals (edges) and hexahedra (faces) connect; chord is the least number of its sides.

    Sides are numbered in the order of their sorted vertices.
    """
    quad, hexa = elem.filter(F.col("etype") == ETYPES["QUAD"]), elem.filter(F.col("etype") == ETYPES["HEX"])
    rows = explode_sides(quad, 1).unionByName(explode_sides(hexa, 2))
    keys = written(numbered(rows.select("key").distinct(), ["key"], "n"), "sides")
    pair = F.when(F.col("etype") == ETYPES["QUAD"], F.col("side") % 2).otherwise(F.when(F.col("side") >= 4, 2).otherwise(F.col("side") % 2))
    ends = rows.select(*ID, pair.alias("pair"), "key").join(keys, "key").groupBy(*ID, "pair").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    label = components(keys.select("n"), ends.select("a", "b"))
    return keys.join(label, keys.n == label.node).select("key", F.col("label").alias("chord"))


def medians(rows: DataFrame, value: str, within: str) -> DataFrame:
    """(within, m): the least value in each group that half of its values at least don't exceed, exactly; nulls don't count.

    Equal values are one row with their count; these are dealt by ranges and added up inside a range after the
    ranges before it, so no group is sorted in one task.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = rows.filter(F.col(value).isNotNull()).groupBy(F.col(within), F.col(value).alias("m")).agg(F.count("*").alias("__n"))
    each = written(each.repartitionByRange(parts, within, "m").withColumn("__part", F.spark_partition_id()), "value-counts")
    ahead = Window.partitionBy(within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    ranges = each.groupBy(within, "__part").agg(F.sum("__n").alias("__own"))
    ranges = ranges.select(within, "__part", F.coalesce(F.sum("__own").over(ahead), F.lit(0)).alias("__before"), F.sum("__own").over(Window.partitionBy(within)).alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy(within, "__part").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    met = each.withColumn("__upto", upto).join(ranges, [within, "__part"])
    return met.filter(2 * (F.col("__before") + F.col("__upto")) >= F.col("__all")).groupBy(within).agg(F.min("m").alias("m"))


def cut(rows: DataFrame, coordinates: list[str], levels: int) -> DataFrame:
    """rows with part, 0 to 2 ** levels - 1: each part is halved at the median of the coordinate along which it is longest."""
    rows = written(rows.withColumn("part", F.lit(0).cast("long")), "parts")
    for _ in range(levels):
        span = rows.groupBy("part").agg(*[(F.max(c) - F.min(c)).alias("s_" + c) for c in coordinates])
        longest = F.greatest(*[F.col("s_" + c) for c in coordinates]) if len(coordinates) > 1 else F.col("s_" + coordinates[0])
        along: Callable | Column = F
        for c in coordinates:
            along = along.when(F.col("s_" + c) == longest, F.col(c))
        met = written(rows.join(F.broadcast(span), "part").withColumn("__t", along).select(*rows.columns, "__t"), "along")  # a row a part, 2 ** levels at most
        met = met.join(F.broadcast(medians(met, "__t", "part")), "part")
        rows = written(met.withColumn("part", F.col("part") * 2 + (F.col("__t") > F.col("m")).cast("long")).select(*rows.columns), "parts")
    return rows


def blocks(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """rows with part: runs of the order of the same length; the first ones have one more where that can't be."""
    total = rows.count()
    least, extra = divmod(total, parts)
    n, big = F.col("__n"), extra * (least + 1)
    part = F.when(n < big, F.floor(n / (least + 1))).otherwise(extra + F.floor((n - big) / max(1, least)))
    return numbered(rows, order, "__n", 0).withColumn("part", part.cast("long")).drop("__n")
