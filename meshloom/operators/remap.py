"""Meshes on the sphere, their overlap, and checks of remapping weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.shape import let
from ..functions.vector import Vec, det
from ..model import MeshError
from ..storage import written
from .measure import clip, planar_area


def lat_lon(spark: SparkSession, n_lon: int, n_lat: int) -> DataFrame:
    """(id, poly): the cells of a grid of longitudes and latitudes, triangles at the poles."""
    i, j = F.col("id") % n_lon, F.floor(F.col("id") / n_lon)
    at = lambda a, b: sphere.corner_of((i + a) * (2 * math.pi / n_lon), (j + b) * (math.pi / n_lat) - math.pi / 2)
    south, north = F.array(at(0, 0), at(1, 1), at(0, 1)), F.array(at(0, 0), at(1, 0), at(0, 1))
    poly = F.when(j == 0, south).when(j == n_lat - 1, north).otherwise(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)))
    return spark.range(n_lon * n_lat).select("id", poly.alias("poly"))


def cubed_sphere(spark: SparkSession, n: int) -> DataFrame:
    """(id, poly): n * n cells of equal angles on each of the six faces of a cube."""
    face = (F.floor(F.col("id") / (n * n)) + 1).cast("int")
    i, j = F.col("id") % n, F.floor(F.col("id") / n) % n
    to = lambda k: F.tan((2 * k / n - 1) * (math.pi / 4))
    at = lambda a, b: sphere.unproject(F.struct(to(i + a).alias("x"), to(j + b).alias("y")), face)
    return spark.range(6 * n * n).select("id", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("poly"))


def icosahedral(spark: SparkSession, n: int) -> DataFrame:
    """(id, poly): the 20 triangles of an icosahedron, each cut into n * n."""
    g = (1 + math.sqrt(5)) / 2
    points = [p for a in (-1, 1) for b in (-g, g) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    near = lambda p, q: abs(sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) - 4) < 1e-9
    faces = [(p, q, r) for i, p in enumerate(points) for j, q in enumerate(points[:i]) for r in points[:j] if near(p, q) and near(q, r) and near(p, r)]
    rows = spark.createDataFrame([(k, *[tuple(map(float, p)) for p in f]) for k, f in enumerate(faces)], "face long, " + ", ".join(f"{c} struct<x:double,y:double,z:double>" for c in "abc"))
    a, b, c = (Vec.of(F.col(x)) for x in "abc")
    # row j has 2 (n - j) - 1 small triangles: upright ones first
    k, j = F.col("k"), F.col("j")
    spot = lambda u, v: (a + (b - a).scale((u) / n) + (c - a).scale((v) / n)).unit().struct()
    up = F.array(spot(k, j), spot(k + 1, j), spot(k, j + 1))
    i = k - (n - j)
    down = F.array(spot(i + 1, j), spot(i + 1, j + 1), spot(i, j + 1))
    grid = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), 2 * (n - F.col("j")) - 2)))
    q = lambda t, i: Vec.of(F.get(t, F.lit(i)))
    poly = let(F.when(k < n - j, up).otherwise(down), lambda t: F.when(det(q(t, 0), q(t, 1), q(t, 2)) < 0, F.reverse(t)).otherwise(t))
    return grid.select((F.col("face") * n * n + 2 * n * j - j * j + k).cast("long").alias("id"), poly.alias("poly"))


def total_area(cells: DataFrame, radius: float = 1.0) -> DataFrame:
    return cells.agg(F.sum(sphere.area(F.col("poly"), radius)).alias("area"), F.count("*").alias("n"))


def _boxes(cells: DataFrame, name: str, width: float) -> DataFrame:
    """Cells with a row for each cube that their cap touches: the cap round their middle that holds all corners."""
    poly = F.col("poly")
    part = lambda c: F.transform(poly, lambda v: v[c])
    mean = Vec(*[F.aggregate(part(c), F.lit(0.0), lambda acc, x: acc + x) for c in "xyz"]).unit()
    rows = cells.select(F.col("id").alias(name), poly.alias(f"{name}_poly"), mean.struct().alias("mid"), "poly")
    mid = Vec.of(F.col("mid"))
    far = F.array_max(F.transform("poly", lambda v: (Vec.of(v) - mid).norm()))
    rows = rows.withColumn("far", far)
    for c in "xyz":
        rows = rows.withColumn("c" + c, F.explode(F.sequence(F.floor((F.col(f"mid.{c}") - F.col("far")) / width), F.floor((F.col(f"mid.{c}") + F.col("far")) / width))))
    return rows.select(name, f"{name}_poly", F.col("mid").alias(f"{name}_mid"), F.col("far").alias(f"{name}_far"), "cx", "cy", "cz")


def overlaps(source: DataFrame, target: DataFrame, width: float, least: float = 1e-13) -> DataFrame:
    """(src, tgt, area, poly) of the overlapping pairs of convex cells (id, poly) on the unit sphere.

    Cells meet in cubes of the given width, then by their caps; a pair is projected to the target's gnomonic
    plane, where arcs are straight, clipped there and put back. That takes cells whose corners lie on one side of
    the plane's parallel through the middle: cells of more than some 18 degrees may be an error.
    """
    pairs = _boxes(source, "src", width).join(_boxes(target, "tgt", width), ["cx", "cy", "cz"])
    gap = (Vec.of(F.col("src_mid")) - Vec.of(F.col("tgt_mid"))).norm()
    # a pair counts in one cube only: the first one that both touch
    pairs = pairs.filter(gap <= F.col("src_far") + F.col("tgt_far"))
    first = [F.floor((F.greatest(F.col(f"src_mid.{c}") - F.col("src_far"), F.col(f"tgt_mid.{c}") - F.col("tgt_far"))) / width) for c in "xyz"]
    pairs = pairs.filter((F.col("cx") == first[0]) & (F.col("cy") == first[1]) & (F.col("cz") == first[2]))
    pairs = pairs.select("src", "tgt", "src_poly", "tgt_poly", sphere.plane_of(Vec.of(F.col("tgt_mid"))).alias("plane"))
    flat = lambda c: F.transform(c, lambda v: sphere.project(Vec.of(v), F.col("plane")))
    pairs = written(pairs.select("src", "tgt", "plane", flat("src_poly").alias("s"), flat("tgt_poly").alias("t")), "projected")
    whole = lambda c: F.forall(c, lambda v: v.isNotNull())
    if not pairs.filter(~(whole("s") & whole("t"))).isEmpty():
        raise MeshError("cells are too large for one projection")
    cut = pairs.select("src", "tgt", "plane", clip(F.col("s"), F.col("t")).alias("q"))
    cut = written(cut, "clipped")  # each step is computed once, not again in the filters after it
    cut = cut.filter((F.size("q") >= 3) & (planar_area(F.col("q")) > least))
    back = written(cut.select("src", "tgt", F.transform("q", lambda v: sphere.unproject(v, F.col("plane"))).alias("poly")), "overlap")
    return back.select("src", "tgt", sphere.area(F.col("poly")).alias("area"), "poly").filter(F.col("area") > least)


def overlap_check(overlap: DataFrame, cells: DataFrame, side: str) -> DataFrame:
    """(id, area, covered): each cell's area and that of its overlaps; side is src or tgt."""
    own = cells.select("id", sphere.area(F.col("poly")).alias("area"))
    met = overlap.groupBy(F.col(side).alias("id")).agg(F.sum("area").alias("covered"))
    return own.join(met, "id", "left").select("id", "area", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def match_ids(source: DataFrame, target: DataFrame) -> DataFrame:
    """(row, col, w): weight 1 between cells (id, gid) of the same global id."""
    met = target.select(F.col("id").alias("row"), "gid").join(source.select(F.col("id").alias("col"), "gid"), "gid")
    return met.select("row", "col", F.lit(1.0).alias("w"))


def inconsistent(w: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(row, total): target cells whose weights don't add up to 1."""
    return w.groupBy("row").agg(F.sum("w").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def unconserved(w: DataFrame, source: DataFrame, target: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(col, share): source cells (id, area) of whose integral the target cells (id, area) get another share than 1."""
    met = w.join(target.select(F.col("id").alias("row"), F.col("area").alias("at")), "row").groupBy("col").agg(F.sum(F.col("w") * F.col("at")).alias("got"))
    share = F.col("got") / F.col("area")
    return met.join(source.select(F.col("id").alias("col"), "area"), "col").select("col", share.alias("share")).filter(F.abs(F.col("share") - 1) > tolerance)


def nonmonotone(w: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The weights outside of 0 to 1."""
    return w.filter((F.col("w") < -tolerance) | (F.col("w") > 1 + tolerance))


def check_weights(w: DataFrame, source: DataFrame, target: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(kind, n): how many rows, columns and weights fail each check."""
    named = {"inconsistent": inconsistent(w, tolerance), "unconserved": unconserved(w, source, target, tolerance), "nonmonotone": nonmonotone(w, tolerance)}
    out = None
    for k, rows in named.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


FIELDS = {
    "wave": lambda p: 2 + F.pow(F.cos(p["lat"]), 2) * F.cos(2 * p["lon"]),
    "fine wave": lambda p: 2 + F.pow(F.sin(2 * p["lat"]), 16) * F.cos(16 * p["lon"]),
    "one": lambda p: F.lit(1.0),
}


def analytic(cells: DataFrame, name: str) -> DataFrame:
    """(id, value) of a known field at the middle of each cell."""
    if name not in FIELDS:
        raise MeshError(f"no field {name!r}")
    part = lambda c: F.transform("poly", lambda v: v[c])
    mid = Vec(*[F.aggregate(part(c), F.lit(0.0), lambda acc, x: acc + x) for c in "xyz"])
    return cells.select("id", sphere.to_lon_lat(mid).alias("p")).select("id", FIELDS[name](F.col("p")).alias("value"))


def error_norms(values: DataFrame, exact: DataFrame) -> DataFrame:
    """(l1, l2, linf, n): plain means of the errors' sizes and squares, and the largest, over the cells (id, value) of both."""
    gap = F.abs(F.col("value") - F.col("exact"))
    met = values.join(exact.select("id", F.col("value").alias("exact")), "id")
    return met.agg(F.avg(gap).alias("l1"), F.sqrt(F.avg(gap * gap)).alias("l2"), F.max(gap).alias("linf"), F.count("*").alias("n"))


def advected(overlap: DataFrame, values: DataFrame) -> DataFrame:
    """(id, value): each arrival cell's mean of the departure cells' values (id, value), weighed by overlap."""
    met = overlap.join(values.withColumnRenamed("id", "src"), "src")
    return met.groupBy(F.col("tgt").alias("id")).agg((F.sum(F.col("area") * F.col("value")) / F.sum("area")).alias("value"))


def departed(cells: DataFrame, velocity, step: float) -> DataFrame:
    """cells with corners moved back along a velocity, a function of a point's Vec, for one step, and put on the sphere again."""
    return cells.withColumn("poly", F.transform("poly", lambda v: (Vec.of(v) - velocity(Vec.of(v)).scale(step)).unit().struct()))


def compare_maps(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(row, col, a, b): weights that differ by more than the tolerance, or that one map lacks."""
    met = a.select("row", "col", F.col("w").alias("a")).join(b.select("row", "col", F.col("w").alias("b")), ["row", "col"], "full")
    return met.filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


