"""Questions to a geometry model: volumes bounded by surfaces of triangles.

triangles: (tid, surface, a, b, c) with points as structs; senses: (surface, volume, sense), 1 if the surface's
triangles face outwards of the volume, -1 if inwards, 0 if the volume lies on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import closest_on_triangle, solid_angle
from ..functions.shape import let
from ..functions.vector import Vec
from ..model import MeshError
from ..storage import written
from .spatial import CELL, _cell, _cover, ray_hits

CORNERS = ("a", "b", "c")
#: Points that a direct sum over all triangles takes at once.
MAX_DIRECT = 10_000


def _points() -> list[Vec]:
    return [Vec.of(F.col(c)) for c in CORNERS]


def normals(triangles: DataFrame) -> DataFrame:
    """(tid, normal): the unit normal of each triangle, null if it is flat."""
    a, b, c = _points()
    return triangles.select("tid", (b - a).cross(c - a).unit().struct().alias("normal"))


def surface_areas(triangles: DataFrame) -> DataFrame:
    a, b, c = _points()
    return triangles.groupBy("surface").agg((F.sum((b - a).cross(c - a).norm()) / 2).alias("area"))


def volumes(triangles: DataFrame, senses: DataFrame) -> DataFrame:
    """(volume, size): the signed sum of the tetrahedra between the origin and each triangle; surfaces of sense 0 don't count."""
    a, b, c = _points()
    own = triangles.groupBy("surface").agg((F.sum(a.dot(b.cross(c))) / 6).alias("size"))
    return own.join(senses, "surface").groupBy("volume").agg(F.sum(F.col("size") * F.col("sense")).alias("size"))


def next_volumes(senses: DataFrame) -> DataFrame:
    """(surface, volume, next): for each volume at a surface the one on its other side, null if there is none."""
    a, b = senses.select("surface", "volume", "sense"), senses.select("surface", F.col("volume").alias("next"), F.col("sense").alias("other"))
    met = a.join(b, "surface").filter((F.col("volume") != F.col("next")) & (F.col("sense") != F.col("other")))
    return a.join(met.select("surface", "volume", "next"), ["surface", "volume"], "left").select("surface", "volume", F.when(F.col("sense") == 0, F.col("volume")).otherwise(F.col("next")).alias("next"))


def implicit_complement(senses: DataFrame, volume: int) -> DataFrame:
    """senses with one more volume, outside all others: every surface that just one volume has bounds it from the other side."""
    lone = senses.filter("sense <> 0").groupBy("surface").agg(F.count("*").alias("n"), F.min("sense").alias("sense")).filter("n = 1")
    kinds = {f.name: f.dataType for f in senses.schema}
    return senses.select("surface", "volume", "sense").unionByName(lone.select("surface", F.lit(volume).cast(kinds["volume"]).alias("volume"), (-F.col("sense")).cast(kinds["sense"]).alias("sense")))


def geometric_skin(senses: DataFrame) -> DataFrame:
    """(surface): surfaces of one volume only."""
    return senses.groupBy("surface").agg(F.count_distinct("volume").alias("n")).filter("n = 1").select("surface")


def check(triangles: DataFrame, senses: DataFrame) -> DataFrame:
    """(kind, id, n): what is wrong: surfaces without triangles or volumes, and volumes whose triangles leave open edges."""
    have, named = triangles.select("surface").distinct(), senses.select("surface").distinct()
    empty = named.join(have, "surface", "left_anti").select(F.lit("surface without triangles").alias("kind"), F.col("surface").alias("id"), F.lit(1).cast("long").alias("n"))
    loose = have.join(named, "surface", "left_anti").select(F.lit("surface without volume").alias("kind"), F.col("surface").alias("id"), F.lit(1).cast("long").alias("n"))
    ends = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    edge = triangles.select("surface", F.explode(F.transform(ends, lambda e: F.array_sort(e))).alias("edge"))
    sides = edge.join(senses.filter("sense <> 0"), "surface").groupBy("volume", "edge").agg(F.count("*").alias("m")).filter("m % 2 = 1")
    open_ = sides.groupBy("volume").agg(F.count("*").alias("n")).select(F.lit("volume with open edges").alias("kind"), F.col("volume").alias("id"), "n")
    return empty.unionByName(loose).unionByName(open_)


def ray_fire(rays: DataFrame, triangles: DataFrame, senses: DataFrame, width: float, *, orientation: int = 1, history: DataFrame | None = None) -> DataFrame:
    """(rid, surface, tid, distance, next): the first surface that each ray (rid, volume, o, d, length) meets from inside its volume.

    orientation 1 counts triangles that the ray leaves the volume through, -1 those it comes in through, 0
    all. Triangles of history (rid, tid) don't count. Rays that meet nothing within their length have nulls.
    next is the volume on the other side.
    """
    hits = ray_hits(rays.select("rid", "o", "d", "length"), triangles.select("tid", *CORNERS), width)
    met = hits.join(triangles.select("tid", "surface"), "tid").join(rays.select("rid", "volume"), "rid").join(senses, ["surface", "volume"])
    leaving = F.when(F.col("sense") == 0, F.lit(0)).when(F.col("entering") == (F.col("sense") < 0), 1).otherwise(-1)
    if orientation:
        met = met.filter((leaving == orientation) | (leaving == 0))
    if history is not None:
        met = met.join(history.select("rid", "tid"), ["rid", "tid"], "left_anti")
    first = met.groupBy("rid", "volume").agg(F.min(F.struct("t", "surface", "tid")).alias("m")).select("rid", "volume", "m.surface", "m.tid", F.col("m.t").alias("distance"))
    first = first.join(next_volumes(senses), ["surface", "volume"], "left").select("rid", "surface", "tid", "distance", "next")
    return rays.select("rid").join(first, "rid", "left").select("rid", "surface", "tid", "distance", "next")


def winding(points: DataFrame, triangles: DataFrame, senses: DataFrame) -> DataFrame:
    """(pid, volume, turns): the solid angle of each volume's surfaces around each point, in full turns.

    A stated set of at most MAX_DIRECT points is held against all triangles, which stay where they are; the
    sums are aggregated per task before they meet.
    """
    if points.count() > MAX_DIRECT:
        raise MeshError(f"more than {MAX_DIRECT} points; deal them out in blocks or use find_volume()")
    few = F.broadcast(points.select("pid", F.struct(*"xyz").alias("p")))
    each = triangles.join(few).select("pid", "surface", solid_angle(Vec.of(F.col("p")), *_points()).alias("angle"))
    own = each.groupBy("pid", "surface").agg(F.sum("angle").alias("angle"))
    return own.join(senses, "surface").groupBy("pid", "volume").agg((F.sum(F.col("angle") * F.col("sense")) / (4 * 3.141592653589793)).alias("turns"))


def find_volume_direct(points: DataFrame, triangles: DataFrame, senses: DataFrame) -> DataFrame:
    """(pid, volume): the least volume that winds around each point more than half a turn, null if none."""
    held = winding(points, triangles, senses).filter("turns > 0.5").groupBy("pid").agg(F.min("volume").alias("volume"))
    return points.select("pid").join(held, "pid", "left")


def find_volume(points: DataFrame, triangles: DataFrame, senses: DataFrame, width: float, length: float) -> DataFrame:
    """(pid, volume): the least volume that holds each point, null if none.

    A ray askew to the axes tells: a volume holds the point if the first of its surfaces that the ray meets is
    left. Where crossings of one volume tie, as on an edge, the ray counts as leaving only if all of them do.
    """
    d = F.struct(*[F.lit(v).alias(c) for v, c in zip((0.8017837257372732, 0.5345224838248488, 0.2672612419124244), "xyz", strict=True)])
    rays = points.select(F.col("pid").alias("rid"), F.struct(*"xyz").alias("o"), d.alias("d"), F.lit(length).alias("length"))
    hits = ray_hits(rays, triangles.select("tid", *CORNERS), width).join(triangles.select("tid", "surface"), "tid").join(senses.filter("sense <> 0"), "surface")
    out = F.col("entering") == (F.col("sense") < 0)
    first = hits.groupBy("rid", "volume").agg(F.min(F.struct(F.round("t", 9).alias("t"), out.alias("leaving"))).alias("m"))
    held = first.filter("m.leaving").groupBy(F.col("rid").alias("pid")).agg(F.min("volume").alias("volume"))
    return points.select("pid").join(held, "pid", "left")


def on_boundary(points: DataFrame, triangles: DataFrame, senses: DataFrame, radius: float) -> DataFrame:
    """(pid, volume, side) for points (pid, x, y, z, dx, dy, dz) with a surface no farther than the radius.

    side is 1 if the direction leads into the volume, -1 if out of it, 0 if along the surface.
    """
    near = near_triangles(points, triangles, radius)
    near = near.join(normals(triangles), "tid").join(triangles.select("tid", "surface"), "tid").join(senses, "surface")
    way = points.select("pid", F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z")).alias("way"))
    met = near.join(way, "pid").withColumn("side", -F.signum(Vec.of(F.col("normal")).dot(Vec.of(F.col("way"))) * F.col("sense")))
    return met.groupBy("pid", "volume").agg(F.min_by("side", F.struct("d2", "tid")).cast("int").alias("side"))


def near_triangles(points: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """(pid, tid, d2, q): triangles no farther than the radius from each point, with the nearest point q of each."""
    low = [F.least(*[F.col(c)[x] for c in CORNERS]) - radius for x in "xyz"]
    high = [F.greatest(*[F.col(c)[x] for c in CORNERS]) + radius for x in "xyz"]
    # cells are as wide as the radius, so a triangle is in those that it touches and the ones next to them
    # which are many more than the triangles' size lets Spark expect, so that they must not be broadcast
    cells = _cover(triangles.select("tid", *CORNERS), low, high, radius).hint("merge")
    own = points.select("pid", F.struct(*"xyz").alias("p"), *[_cell(F.col(c), radius).alias("c" + c) for c in "xyz"])

    def judged(q: Column) -> Column:
        gap = let((Vec.of(q) - Vec.of(F.col("p"))).struct(), lambda g: Vec.of(g).dot(Vec.of(g)))
        return F.struct(gap.alias("d2"), q.alias("q"))

    met = own.join(cells, CELL).select("pid", "tid", let(closest_on_triangle(Vec.of(F.col("p")), *_points()), judged).alias("m"))
    return met.filter(F.col("m.d2") <= radius * radius).select("pid", "tid", "m.d2", "m.q")


def closest(points: DataFrame, triangles: DataFrame, radius: float, most: float) -> DataFrame:
    """(pid, tid, d2, q): the nearest triangle of each point (the least tid on ties) and its nearest point; nulls beyond `most`.

    Points look within the radius first; those that find nothing look twice as far, up to `most`.
    """
    found, left, radius = None, written(points.select("pid", *"xyz"), "points"), min(radius, most)
    triangles = written(triangles.select("tid", *CORNERS), "triangles")
    while True:
        now = near_triangles(left, triangles, radius).groupBy("pid").agg(F.min(F.struct("d2", "tid", "q")).alias("m")).select("pid", "m.tid", "m.d2", "m.q")
        now = written(now, "closest")
        found = now if found is None else found.unionByName(now)
        left = written(left.join(now, "pid", "left_anti"), "left")
        if radius >= most or left.isEmpty():
            return points.select("pid").join(found, "pid", "left")
        radius = min(2 * radius, most)


def topology_from_adjacency(sides: DataFrame, members: DataFrame) -> DataFrame:
    """(parent, child): the set of higher elements that a set of lower ones bounds.

    sides: (set_id, key) of the higher elements' sides; members: (set_id, key) of the lower ones. The first
    member of a set, by its key, stands for it.
    """
    first = members.groupBy("set_id").agg(F.min("key").alias("key")).select(F.col("set_id").alias("child"), "key")
    return sides.select(F.col("set_id").alias("parent"), "key").join(first, "key").select("parent", "child").distinct()


def topology_by_inclusion(inside: DataFrame) -> DataFrame:
    """(outer, inner): of pairs (outer, inner) that hold one another at any depth, those of the next outer one.

    The next outer one is that which most others hold; depth is counted, so no pair of pairs is made.
    """
    depth = inside.groupBy(F.col("inner").alias("outer")).agg(F.count("*").alias("depth"))
    met = inside.join(depth, "outer", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("inner").orderBy(F.desc("depth"), "outer"))).filter("rank = 1").select("outer", "inner")
