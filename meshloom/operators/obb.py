"""Oriented boxes: one for each group of points or triangles, along the axes of their spread, and tests of points and rays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matrix import eigen
from ..functions.shape import let
from ..functions.vector import Vec
from ..storage import written


def _fitted(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(group, center, axes, half) of points (group, x, y, z) in the frames (group, axes): the least box along each frame."""
    p = Vec(*[F.col(c) for c in "xyz"])
    along = [p.dot(Vec.of(F.get("axes", F.lit(i)))).alias(f"t{i}") for i in range(3)]
    ends = points.join(frames, "group").select("group", *along).groupBy("group").agg(*[f(f"t{i}").alias(f"{n}{i}") for i in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    spans = F.array_sort(F.array(*[F.struct(((F.col(f"hi{i}") - F.col(f"lo{i}")) / 2).alias("half"), F.lit(i).alias("i"), F.get("axes", F.lit(i)).alias("axis"), ((F.col(f"hi{i}") + F.col(f"lo{i}")) / 2).alias("mid")) for i in range(3)]))
    rows = ends.join(frames, "group").select("group", spans.alias("s"))
    part = lambda i, f: F.get("s", F.lit(i))[f]
    center = Vec(*[sum((part(i, "mid") * part(i, "axis")[c] for i in range(3)), F.lit(0.0)) for c in "xyz"])
    return rows.select("group", center.struct().alias("center"), F.transform("s", lambda s: s["axis"]).alias("axes"), F.transform("s", lambda s: s["half"]).alias("half"))


def of_points(points: DataFrame) -> DataFrame:
    """(group, center, axes, half) of points (group, x, y, z): the box along the axes of the points' covariance.

    axes are three unit vectors, half the box's half lengths along them, from the shortest to the longest. Two passes, both
    aggregated before the shuffle; the frames between them are a row a group.
    """
    m = F.struct(*[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    spread = points.groupBy("group").agg(m.alias("m"))
    frames = written(spread.select("group", F.transform(eigen(F.col("m")), lambda e: e["axis"]).alias("axes")), "frames")
    return _fitted(points, frames)


def of_triangles(triangles: DataFrame) -> DataFrame:
    """(group, center, axes, half) of triangles (group, p: three points): axes of the covariance of the surface, so that small triangles count little."""
    a, b, c = (Vec.of(F.get("p", F.lit(i))) for i in range(3))
    rows = triangles.select("group", "p", ((b - a).cross(c - a).norm() / 2).alias("area"), (a + b + c).scale(1 / 3).struct().alias("mid"))
    w = F.col("area")
    corner = lambda i, x: F.get("p", F.lit(i))[x]
    second = lambda x, y: F.sum(w * (9 * F.col(f"mid.{x}") * F.col(f"mid.{y}") + sum((corner(i, x) * corner(i, y) for i in range(3)), F.lit(0.0))) / 12)
    sums = rows.groupBy("group").agg(F.sum(w).alias("w"), *[F.sum(w * F.col(f"mid.{x}")).alias("s" + x) for x in "xyz"], *[second(x, y).alias("m" + x + y) for x, y in ("xx", "xy", "xz", "yy", "yz", "zz")])
    m = F.struct(*[(F.col("m" + x + y) / F.col("w") - F.col("s" + x) * F.col("s" + y) / (F.col("w") * F.col("w"))).alias(x + y) for x, y in ("xx", "xy", "xz", "yy", "yz", "zz")])
    frames = written(sums.filter("w > 0").select("group", m.alias("m")).select("group", F.transform(eigen(F.col("m")), lambda e: e["axis"]).alias("axes")), "frames")
    points = triangles.select("group", F.explode("p").alias("v")).select("group", "v.x", "v.y", "v.z")
    return _fitted(points, frames)


def _local(box: Column, p: Vec) -> list[Column]:
    d = p - Vec.of(box["center"])
    return [d.dot(Vec.of(F.get(box["axes"], F.lit(i)))) for i in range(3)]


def _half(box: Column, i: int) -> Column:
    return F.get(box["half"], F.lit(i))


def volume(box: Column) -> Column:
    return 8 * _half(box, 0) * _half(box, 1) * _half(box, 2)


def holds(box: Column, p: Vec, tolerance: float = 0.0) -> Column:
    return reduce(Column.__and__, [F.abs(t) <= _half(box, i) + tolerance for i, t in enumerate(_local(box, p))])


def closest(box: Column, p: Vec) -> Column:
    """The point (x, y, z) of the box nearest to p: p itself inside."""
    near = [F.greatest(-_half(box, i), F.least(_half(box, i), t)) for i, t in enumerate(_local(box, p))]
    c = Vec.of(box["center"])
    for i, t in enumerate(near):
        c = c + Vec.of(F.get(box["axes"], F.lit(i))).scale(t)
    return c.struct()


def ray(box: Column, origin: Vec, direction: Vec, tolerance: float = 0.0) -> Column:
    """(enter, leave): the stretch of a ray inside the box, in lengths of the direction, from 0 on; null if it misses."""
    far = F.lit(float("inf"))
    near, end = F.lit(0.0), far
    for i, t in enumerate(_local(box, origin)):
        d = direction.dot(Vec.of(F.get(box["axes"], F.lit(i))))
        half = _half(box, i) + tolerance
        inside = F.abs(t) <= half
        still = F.abs(d) < 1e-300
        a, b = (-half - t) / F.nullif(d, F.lit(0.0)), (half - t) / F.nullif(d, F.lit(0.0))
        near = F.greatest(near, F.when(still, F.when(inside, 0.0).otherwise(far)).otherwise(F.least(a, b)))
        end = F.least(end, F.when(still, far).otherwise(F.greatest(a, b)))
    return let(F.struct(near.alias("enter"), end.alias("leave")), lambda s: F.when(s["enter"] <= s["leave"], s))


def hits(boxes: DataFrame, rays: DataFrame, width: float) -> DataFrame:
    """(ray, group, enter, leave) of rays (ray, origin, direction, length) that meet boxes within their length.

    Boxes and rays meet in cubes of the given width, near the size of the boxes: a ray is walked in steps of
    at most the width, and a box stands in the cubes that its upright hull and one cube more around it touch.
    """
    b = F.struct("center", "axes", "half")
    reach = {c: sum((F.abs(F.get("axes", F.lit(i))[c]) * F.get("half", F.lit(i)) for i in range(3)), F.lit(0.0)) for c in "xyz"}
    spread = boxes.select("group", b.alias("box"), *[(F.floor((F.col(f"center.{c}") - reach[c]) / width) - 1).alias("lo" + c) for c in "xyz"], *[(F.floor((F.col(f"center.{c}") + reach[c]) / width) + 1).alias("hi" + c) for c in "xyz"])
    for c in "xyz":
        spread = spread.withColumn("c" + c, F.explode(F.sequence("lo" + c, "hi" + c)))
    o, d = Vec.of(F.col("origin")), Vec.of(F.col("direction"))
    steps = F.ceil(F.col("length") * d.norm() / width)
    walk = rays.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    at = o + d.scale(F.col("length") * F.col("k") / F.greatest(steps, F.lit(1).cast("long")))
    walk = walk.select("ray", "origin", "direction", "length", *[F.floor(getattr(at, c) / width).alias("c" + c) for c in "xyz"]).distinct()
    met = walk.join(spread.select("group", "box", "cx", "cy", "cz"), ["cx", "cy", "cz"]).dropDuplicates(["ray", "group"])
    found = met.select("ray", "group", "length", ray(F.col("box"), Vec.of(F.col("origin")), Vec.of(F.col("direction"))).alias("at"))
    return found.filter("at is not null and at.enter <= length").select("ray", "group", "at.enter", "at.leave")
