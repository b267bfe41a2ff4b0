"""Surfaces of high order from the vertices of a face mesh: a polynomial height over each vertex's tangent plane.

Each vertex sees the vertices of some rings of faces around it. Their heights over its tangent plane are fitted by
weighted least squares: Spark adds up the normal equations (a fixed number of sums, before the shuffle as far
as it can), and small systems of equal size are solved in batches. A point of a face is moved to the mean of
its corners' surfaces, weighed as the corners are, so that faces join without gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import corners
from ..functions.vector import Vec
from ..model import Mesh, MeshError, dimension
from ..storage import written
from .measure import with_points

DEGREES = range(1, 7)
#: Eigenvalues of a system below this share of the largest are left out, so too few neighbours give a lower degree.
LEAST = 1e-9


def powers(degree: int) -> list[tuple[int, int]]:
    """Exponents of the monomials up to a degree but the constant, which the vertex itself makes zero."""
    return [(n - j, j) for n in range(1, degree + 1) for j in range(n + 1)]


def normals(mesh: Mesh) -> DataFrame:
    """(id, nx, ny, nz): unit normals of vertices, the mean of their faces' normals weighed by area."""
    faces = mesh.elem.filter(dimension(F.col("etype")) == 2)
    rows = with_points(Mesh(mesh.vertex, faces.withColumn("conn", corners(F.col("etype"), F.col("conn")))))
    at = lambda i: Vec.of(F.get("p", i))
    fan = F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: (at(i) - at(F.lit(0))).cross(at(i + 1) - at(F.lit(0))).struct())
    total = lambda c: F.aggregate(fan, F.lit(0.0), lambda acc, v: acc + v[c])
    each = rows.select("etype", "id", *[total(c).alias(c) for c in "xyz"])
    met = faces.select("etype", "id", F.explode(F.array_distinct("conn")).alias("vid")).join(each, ["etype", "id"])
    sums = met.groupBy(F.col("vid").alias("id")).agg(*[F.sum(c).alias(c) for c in "xyz"])
    n = Vec(*[F.col(c) for c in "xyz"]).unit()
    return sums.select("id", n.x.alias("nx"), n.y.alias("ny"), n.z.alias("nz"))


def rings(elem: DataFrame, n: int) -> DataFrame:
    """(vid, other): for each vertex the vertices that it reaches over at most n faces, itself left out."""
    faces = elem.filter(dimension(F.col("etype")) == 2).withColumn("conn", corners(F.col("etype"), F.col("conn")))
    pairs = faces.select(F.explode("conn").alias("vid"), "conn").select("vid", F.explode("conn").alias("other")).filter("vid <> other").distinct()
    step = written(pairs, "ring")
    out = step
    for _ in range(n - 1):
        wider = out.join(step.select(F.col("vid").alias("other"), F.col("other").alias("next")), "other").select("vid", F.col("next").alias("other")).filter("vid <> other")
        out = written(out.unionByName(wider).distinct(), "rings")
    return out


def _frame(n: Vec) -> tuple[Vec, Vec]:
    """Two tangents of a unit normal, made from the axis that it is farthest from."""
    small = F.least(F.abs(n.x), F.abs(n.y), F.abs(n.z))
    pick = F.when(F.abs(n.x) == small, 0).when(F.abs(n.y) == small, 1).otherwise(2)
    axis = Vec(*[F.when(pick == i, 1.0).otherwise(0.0) for i in range(3)])
    t = axis.cross(n).unit()
    return t, n.cross(t)


def fit(mesh: Mesh, degree: int, *, n_rings: int | None = None, normal: DataFrame | None = None) -> DataFrame:
    """(id, p, n, t, h, c): each vertex's place, normal, first tangent, mean distance to its neighbours and coefficients.

    The surface of a vertex is p + a t + b (n x t) + f(a, b) n, where f adds up c[k] (a / h)^i (b / h)^j over
    powers(degree). Neighbours weigh less the farther they are and the more their normals turn away; those turned
    away by a right angle don't count. normal gives (id, nx, ny, nz) in place of normals(). A vertex without
    neighbours has a plane.
    """
    if degree not in DEGREES:
        raise MeshError(f"the degree is between {DEGREES[0]} and {DEGREES[-1]}")
    terms = powers(degree)
    point = mesh.vertex.join(normal if normal is not None else normals(mesh), "id")
    t, _ = _frame(Vec(F.col("nx"), F.col("ny"), F.col("nz")))
    point = written(point.select("id", F.struct("x", "y", "z").alias("p"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")).alias("n"), t.struct().alias("t")), "frames")
    near = rings(mesh.elem, n_rings or degree // 2 + 1 + degree % 2)
    pairs = near.join(point.withColumnRenamed("id", "vid"), "vid").join(point.select(F.col("id").alias("other"), F.col("p").alias("q"), F.col("n").alias("m")), "other")
    n, s = Vec.of(F.col("n")), Vec.of(F.col("t"))
    d = Vec.of(F.col("q")) - Vec.of(F.col("p"))
    local = written(pairs.select("vid", d.dot(s).alias("a"), d.dot(n.cross(s)).alias("b"), d.dot(n).alias("w"), d.norm().alias("r"), F.greatest(n.dot(Vec.of(F.col("m"))), F.lit(0.0)).alias("turn")), "neighbours")
    size = local.groupBy("vid").agg(F.avg("r").alias("h"))
    rows = local.join(size, "vid")
    weight = F.col("turn") / F.pow(F.pow(F.col("r") / F.col("h"), 2) + 0.01, degree / 2)
    rows = rows.select("vid", "h", "w", weight.alias("k"), *[(F.pow(F.col("a") / F.col("h"), i) * F.pow(F.col("b") / F.col("h"), j)).alias(f"m{x}") for x, (i, j) in enumerate(terms)])
    m, k = len(terms), F.col("k")
    left = [F.sum(k * F.col(f"m{x}") * F.col(f"m{y}")) for x in range(m) for y in range(x + 1)]
    right = [F.sum(k * F.col(f"m{x}") * F.col("w")) for x in range(m)]
    sums = rows.groupBy("vid", "h").agg(*[e.alias(f"s{i}") for i, e in enumerate(left + right)])
    sums = sums.select("vid", "h", F.array(*[F.col(f"s{i}") for i in range(len(left))]).alias("left"), F.array(*[F.col(f"s{i}") for i in range(len(left), len(left) + m)]).alias("right"))

    def solve(batches):
        at = np.tril_indices(m)
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.zeros((batch.num_rows, m, m))
            a[:, at[0], at[1]] = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            a += np.tril(a, -1).transpose(0, 2, 1)
            b = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, m)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            c = np.einsum("nij,nj->ni", np.linalg.pinv(a / (scale[:, :, None] * scale[:, None, :]), rcond=LEAST, hermitian=True), b / scale) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(c))], names=["id", "h", "c"])

    found = sums.mapInArrow(solve, f"id {dict(sums.dtypes)['vid']}, h double, c array<double>")
    flat = F.array(*[F.lit(0.0)] * m)
    return point.join(found, "id", "left").select("id", "p", "n", "t", F.coalesce("h", F.lit(1.0)).alias("h"), F.coalesce("c", flat).alias("c"))


def surface(degree: int, x: Vec) -> Vec:
    """Where the surface of a row of fit() is over (or under) a point, along its normal."""
    p, n, t = (Vec.of(F.col(c)) for c in "pnt")
    d = x - p
    a, b = d.dot(t) / F.col("h"), d.dot(n.cross(t)) / F.col("h")
    f: Column = F.lit(0.0)
    for k, (i, j) in enumerate(powers(degree)):
        f = f + F.get("c", F.lit(k)) * F.pow(a, i) * F.pow(b, j)
    return p + t.scale(a * F.col("h")) + n.cross(t).scale(b * F.col("h")) + n.scale(f)


def moved(mesh: Mesh, fitted: DataFrame, degree: int, points: DataFrame) -> DataFrame:
    """(pid, x, y, z): points (pid, etype, id, weight: of each corner) of faces, moved to the surface that fit() gave."""
    faces = mesh.elem.filter(dimension(F.col("etype")) == 2).withColumn("conn", corners(F.col("etype"), F.col("conn")))
    rows = points.join(faces, ["etype", "id"]).select("pid", F.posexplode("conn").alias("pos", "vid"), "weight").select("pid", "vid", F.get("weight", F.col("pos")).alias("w"))
    met = rows.join(fitted.withColumnRenamed("id", "vid"), "vid")
    flat = met.groupBy("pid").agg(*[F.sum(F.col("w") * F.col(f"p.{c}")).alias("q" + c) for c in "xyz"])
    at = surface(degree, Vec(F.col("qx"), F.col("qy"), F.col("qz")))
    parts = met.join(flat, "pid").select("pid", "w", at.x.alias("x"), at.y.alias("y"), at.z.alias("z"))
    return parts.groupBy("pid").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"])
