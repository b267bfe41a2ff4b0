"""The overlap of two meshes of convex faces as a mesh of its own, with shared nodes and both parents.

A node of the overlap has an identity that doesn't depend on coordinates: a source vertex, a target vertex, or the
crossing of an edge of one mesh with an edge of the other, each named by its vertices. Every overlap that
touches a node finds it by the same test on the same numbers (edges run from their lesser vertex), so that
neighbours share nodes exactly and the overlap has no cracks. A vertex that lies on an edge, or on a vertex of
the other mesh, is that vertex.

Planar meshes are seen as points (x, y, 1), spherical ones as unit vectors; in both, a vertex is left of an
edge if the determinant of the three is positive, and two edges cross where the planes through them do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.numbering import explode_sides
from ..functions.shape import let
from ..functions.vector import Vec, det
from ..model import ETYPES, Mesh, MeshError, dimension, elem_vertex
from ..storage import numbered, written

#: Sines (or lengths, in the plane, relative to an edge) below which a vertex lies on an edge or on another vertex.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Overlay:
    """The overlap mesh, its parents (id, src, tgt, area) and its nodes' names (id, kind, a, b, c, d).

    kind 0 is the source vertex a, 1 the target vertex a, 2 the crossing of source edge (a, b) and target edge (c, d).
    """

    mesh: Mesh
    parents: DataFrame
    nodes: DataFrame


def cells(mesh: Mesh, spherical: bool) -> DataFrame:
    """(id, p): the faces of a mesh with their corners (id, x, y, z) in order, on the sphere or at height 1."""
    faces = mesh.elem.filter(dimension(F.col("etype")) == 2)
    met = elem_vertex(faces).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    at = Vec(*[F.col(c).cast("double") for c in "xyz"])
    at = at.unit() if spherical else Vec(at.x, at.y, F.lit(1.0))
    rows = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "vid", at.x.alias("x"), at.y.alias("y"), at.z.alias("z")))).alias("p"))
    return rows.select("id", F.transform("p", lambda v: F.struct(v["vid"].alias("id"), v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))).alias("p"))


def _boxed(rows: DataFrame, name: str, width: float, spherical: bool) -> DataFrame:
    """Cells with a row for each cube of the given width that their box touches; arcs stand out of their chords."""
    out = rows.select(F.col("id").alias(name), F.col("p").alias(name[0]))
    axes = "xyz" if spherical else "xy"
    for c in axes:
        v = F.col(f"{name[0]}.{c}")
        out = out.withColumn(f"{name}_{c}0", F.array_min(v)).withColumn(f"{name}_{c}1", F.array_max(v))
    if spherical:
        size = sum((F.pow(F.col(f"{name}_{c}1") - F.col(f"{name}_{c}0"), 2) for c in axes), F.lit(0.0))
        out = out.withColumn("__out", size / 2)
        for c in axes:
            out = out.withColumn(f"{name}_{c}0", F.col(f"{name}_{c}0") - F.col("__out")).withColumn(f"{name}_{c}1", F.col(f"{name}_{c}1") + F.col("__out"))
        out = out.drop("__out")
    for c in axes:
        out = out.withColumn("c" + c, F.explode(F.sequence(F.floor(F.col(f"{name}_{c}0") / width), F.floor(F.col(f"{name}_{c}1") / width))))
    return out


def _side(a: Column, b: Column, v: Column, tolerance: float) -> Column:
    """1 if v is left of the edge from a to b, -1 if right, 0 on it: computed along the edge from its lesser vertex."""

    def at(p: Column, q: Column) -> Column:
        along = Vec.of(q) - Vec.of(p)
        # of differences, as products of whole coordinates lose the digits that the tolerance asks for
        return let(det(Vec.of(p), along, Vec.of(v) - Vec.of(p)) / F.nullif(along.norm(), F.lit(0.0)), lambda d: F.when(F.abs(d) <= tolerance, 0).otherwise(F.signum(d).cast("int")))

    return F.when(a["id"] < b["id"], at(a, b)).otherwise(-at(b, a))


def _edges(p: Column) -> Column:
    return F.transform(p, lambda v, i: F.struct(v.alias("a"), F.get(p, (i + 1) % F.size(p)).alias("b")))


def _signs(edges: Column, points: Column, tolerance: float) -> Column:
    """For each edge, the sides of all points."""
    return F.transform(edges, lambda e: F.transform(points, lambda v: F.coalesce(_side(e["a"], e["b"], v, tolerance), F.lit(0))))


def _crossing(s: Column, t: Column, spherical: bool) -> Column:
    """The node where two edges cross, the same whichever way they run."""
    lo = lambda e: F.when(e["a"]["id"] < e["b"]["id"], e["a"]).otherwise(e["b"])
    hi = lambda e: F.when(e["a"]["id"] < e["b"]["id"], e["b"]).otherwise(e["a"])
    if spherical:
        normal = lambda e: Vec.of(lo(e)).cross(Vec.of(hi(e)))
        line = normal(s).cross(normal(t))
        near = Vec.of(lo(s)) + Vec.of(hi(s))
        at = let(line.unit().struct(), lambda u: F.when(Vec.of(u).dot(near) < 0, Vec.of(u).scale(-1.0).struct()).otherwise(u))
    else:
        d, e, gap = Vec.of(hi(s)) - Vec.of(lo(s)), Vec.of(hi(t)) - Vec.of(lo(t)), Vec.of(lo(t)) - Vec.of(lo(s))
        at = let(gap.cross(e).z / d.cross(e).z, lambda k: (Vec.of(lo(s)) + d.scale(k)).struct())
    return F.struct(_key(2, lo(s)["id"], hi(s)["id"], lo(t)["id"], hi(t)["id"]).alias("key"), at.alias("at"))


def _key(kind: int, *ids: Column) -> Column:
    named = [*ids, *[F.lit(0)] * (4 - len(ids))]
    return F.struct(F.lit(kind).alias("kind"), *[i.cast("long").alias(n) for i, n in zip(named, "abcd", strict=True)])


def _inside(points: Column, signs: Column, kind: int) -> Column:
    """The points that no edge has on its right, as nodes."""
    marked = F.transform(points, lambda v, j: F.struct(v.alias("v"), F.forall(signs, lambda row: F.get(row, j) >= 0).alias("ok")))
    return F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: F.struct(_key(kind, m["v"]["id"]).alias("key"), F.struct(*[m["v"][c].alias(c) for c in "xyz"]).alias("at")))


def _ring(nodes: Column, spherical: bool) -> Column:
    """Nodes of a convex polygon in counterclockwise order."""
    n = F.size(nodes)
    total = lambda c: F.aggregate(nodes, F.lit(0.0), lambda acc, v: acc + v["at"][c])
    sums = Vec(*map(total, "xyz"))
    middle = (sums.unit() if spherical else sums.scale(1 / n)).struct()

    def order(m: Column) -> Column:
        mid = Vec.of(m)
        up = mid if spherical else Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))
        first = Vec.of(F.get(nodes, F.lit(0))["at"]) - mid

        def angle(v: Column) -> Column:
            d = Vec.of(v["at"]) - mid
            return F.atan2(up.dot(first.cross(d)), first.dot(d) - first.dot(up) * d.dot(up))

        return F.transform(F.array_sort(F.transform(nodes, lambda v: F.struct(angle(v).alias("angle"), v["key"].alias("key"), v["at"].alias("at")))), lambda v: F.struct(v["key"].alias("key"), v["at"].alias("at")))

    return let(middle, order)


def _area(ring: Column, spherical: bool) -> Column:
    if spherical:
        return sphere.area(F.transform(ring, lambda v: v["at"]))
    n = F.size(ring)
    first = Vec.of(F.get(ring, F.lit(0))["at"])
    terms = F.transform(ring, lambda v, i: (Vec.of(v["at"]) - first).cross(Vec.of(F.get(ring, (i + 1) % n)["at"]) - first).z)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2


def overlay(source: Mesh, target: Mesh, width: float, *, spherical: bool = False, tolerance: float = TOLERANCE, least: float = 1e-12) -> Overlay:
    """The overlap mesh of the faces of two meshes, convex and counterclockwise (seen from outside on a sphere).

    Faces meet in cubes of the given width, near the size of the larger faces; overlaps of at most `least` area
    go. Cells are POLYGONs numbered by (src, tgt), nodes are numbered by their names. Vertices are told apart by id,
    so no face may use two vertices at one place; faces on a sphere are smaller than half of it.
    """
    if width <= 0:
        raise MeshError("width is positive")
    axes = "xyz" if spherical else "xy"
    pairs = _boxed(cells(source, spherical), "src", width, spherical).join(_boxed(cells(target, spherical), "tgt", width, spherical), ["c" + c for c in axes])
    for c in axes:  # a pair counts in one cube only: the first that both touch
        low = F.greatest(f"src_{c}0", f"tgt_{c}0")
        pairs = pairs.filter((low <= F.least(f"src_{c}1", f"tgt_{c}1") + tolerance) & (F.col("c" + c) == F.floor(low / width)))
    pairs = pairs.select("src", "tgt", "s", "t")
    signed = pairs.select("src", "tgt", "s", "t", _edges(F.col("s")).alias("se"), _edges(F.col("t")).alias("te"))
    signed = signed.select("*", _signs(F.col("te"), F.col("s"), tolerance).alias("st"), _signs(F.col("se"), F.col("t"), tolerance).alias("ts"))
    # a face wholly on the right of one edge of the other has no area in common with it
    apart = lambda c: F.exists(c, lambda row: F.forall(row, lambda x: x <= 0))
    signed = written(signed.filter(~apart("st") & ~apart("ts")), "overlay-pairs")
    own, other = _inside(F.col("s"), F.col("st"), 0), _inside(F.col("t"), F.col("ts"), 1)

    def opposite(row: Column, i: Column) -> Column:
        return F.get(row, i) * F.get(row, (i + 1) % F.size(row)) < 0

    met = F.flatten(F.transform("se", lambda e, i: F.filter(F.transform("te", lambda f, k: F.when(opposite(F.get("st", k), i) & opposite(F.get("ts", i), k), _crossing(e, f, spherical))), lambda x: x.isNotNull())))
    rows = signed.select("src", "tgt", own.alias("own"), other.alias("other"), met.alias("met"))
    # where vertices of both lie on one another, the source's names the node
    near = lambda v: F.exists("own", lambda u: (Vec.of(u["at"]) - Vec.of(v["at"])).norm() <= tolerance)
    rows = rows.select("src", "tgt", F.concat("own", F.filter("other", lambda v: ~near(v)), "met").alias("nodes")).filter(F.size("nodes") >= 3)
    rows = rows.select("src", "tgt", _ring(F.col("nodes"), spherical).alias("ring"))
    rows = written(rows.select("src", "tgt", "ring", _area(F.col("ring"), spherical).alias("area")), "overlay-rings").filter(F.col("area") > least)
    rows = written(numbered(rows, ["src", "tgt"], "id"), "overlay-cells")
    used = rows.select("id", F.posexplode("ring").alias("pos", "v")).select("id", "pos", "v.key", "v.at")
    nodes = written(numbered(used.groupBy("key").agg(F.min("at").alias("at")), ["key"], "nid"), "overlay-nodes")
    conn = used.select("id", "pos", "key").join(nodes.select("key", "nid"), "key").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nid"))), lambda s: s["nid"]).alias("conn"))
    height = F.col("at.z") if spherical else F.lit(0.0)
    vertex = nodes.select(F.col("nid").alias("id"), "at.x", "at.y", height.alias("z"))
    elem = conn.select(F.lit(ETYPES["POLYGON"]).alias("etype"), "id", "conn")
    return Overlay(Mesh(vertex, written(elem, "overlay-mesh")), rows.select("id", "src", "tgt", "area"), nodes.select(F.col("nid").alias("id"), "key.*"))


def edge_uses(elem: DataFrame) -> DataFrame:
    """(kind, n): how many edges of a face mesh are used once (border), twice against one another (inner), or otherwise (torn)."""
    rows = explode_sides(elem, 1).select("key", (F.get("conn", F.lit(0)) == F.get("key", F.lit(0))).cast("int").alias("up"))
    uses = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    kind = F.when(F.col("n") == 1, "border").when((F.col("n") == 2) & (F.col("up") == 1), "inner").otherwise("torn")
    return uses.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def covering(source: Mesh, target: Mesh, width: float, *, spherical: bool = False) -> DataFrame:
    """(id): the source faces whose boxes touch that of a target face, which are enough to overlay the target."""
    axes = "xyz" if spherical else "xy"
    met = _boxed(cells(source, spherical), "src", width, spherical).join(_boxed(cells(target, spherical), "tgt", width, spherical), ["c" + c for c in axes])
    for c in axes:
        met = met.filter(F.greatest(f"src_{c}0", f"tgt_{c}0") <= F.least(f"src_{c}1", f"tgt_{c}1"))
    return met.select(F.col("src").alias("id")).distinct()
