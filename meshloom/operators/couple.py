"""Solution transfer: points located in elements, values interpolated there, fields integrated and normalised."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shape
from ..model import Mesh, MeshError, dimension, elem_vertex
from .measure import with_points
from .spatial import CELL, _cell, _cover

ID = ["etype", "id"]


def locate(points: DataFrame, mesh: Mesh, width: float, tolerance: float = 1e-9, dim: int = 3) -> DataFrame:
    """(pid, etype, id, at): for each point (pid, x, y, z) the least element that holds it and its local coordinates there; null if none does.

    Elements of dimension dim count, those of lower dimension only with points in their plane or line; one that has
    no shape functions (polygons, knives, polyhedra) is an error. Points and element boxes meet in grid cells as wide as
    `width`; the inverse map decides. Corners alone give the elements' form.
    """
    names = [n for n in shape.KINDS if {"EDGE": 1, "TRI": 2, "QUAD": 2}.get(n, 3) == dim]
    solid = mesh.elem.filter(dimension(F.col("etype")) == dim)
    other = solid.filter(~F.col("etype").isin([shape.ETYPES[n] for n in names])).select("etype").limit(1).collect()
    if other:
        raise MeshError(f"points can't be located in elements of type {other[0][0]}")
    solid = with_points(replace(mesh, elem=solid))
    part = lambda f, c: f(F.transform("p", lambda v: v[c]))
    slack = 1e-6 * width
    cells = _cover(solid, [part(F.array_min, c) - slack for c in "xyz"], [part(F.array_max, c) + slack for c in "xyz"], width)
    own = points.select("pid", F.struct(*"xyz").alias("x"), *[_cell(F.col(c), width).alias("c" + c) for c in "xyz"])
    box = [F.col(f"x.{c}").between(part(F.array_min, c) - slack, part(F.array_max, c) + slack) for c in "xyz"]
    met = own.join(cells, CELL).filter(box[0] & box[1] & box[2])

    def judged(name: str) -> Column:
        """Local coordinates and whether they are inside, from one inverse map."""

        def look(at: Column) -> Column:
            fits = shape.inside(name, at, tolerance)
            if dim < 3:
                fits = fits & ((shape.place(name, F.col("p"), at) - shape.Vec.of(F.col("x"))).norm() <= tolerance * max(1.0, width))
            return F.struct(at.alias("at"), fits.alias("fits"))

        return shape.let(shape.inverse(name, F.col("p"), F.col("x")), look)

    local = None
    for name in names:
        local = (F.when if local is None else local.when)(F.col("etype") == shape.ETYPES[name], judged(name))
    met = met.select("pid", *ID, local.alias("m"))
    found = met.filter("m.fits").select("pid", *ID, "m.at").groupBy("pid").agg(F.min(F.struct(*ID, "at")).alias("m"))
    return points.select("pid").join(found, "pid", "left").select("pid", "m.etype", "m.id", "m.at")


def corner_weights(located: DataFrame, elem: DataFrame) -> DataFrame:
    """(pid, vid, weight): the shape functions of each located point's element at the point."""
    met = located.filter(F.col("id").isNotNull()).join(elem, ID)
    every = shape.by_type(F.col("etype"), lambda n: F.array(*shape.shape_weights(n, F.col("at"))))
    rows = met.select("pid", F.arrays_zip(F.slice("conn", 1, F.size(every)).alias("vid"), every.alias("weight")).alias("z"))
    return rows.select("pid", F.explode("z").alias("z")).select("pid", "z.vid", "z.weight")


def interpolate(located: DataFrame, elem: DataFrame, nodal: DataFrame) -> DataFrame:
    """(pid, value): a field with values (vid, value) at the vertices, by the shape functions; null where a point has no element."""
    met = corner_weights(located, elem).join(nodal, "vid")
    out = met.groupBy("pid").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return located.select("pid").join(out, "pid", "left")


def constant(located: DataFrame, values: DataFrame) -> DataFrame:
    """(pid, value): the value (etype, id, value) of each located point's element."""
    return located.join(values, ID, "left").select("pid", "value")


def integrals(mesh: Mesh, nodal: DataFrame) -> DataFrame:
    """(etype, id, integral) of a field with values (vid, value) at the vertices, over each element with shape functions."""
    at = mesh.vertex.withColumnRenamed("id", "vid").join(nodal, "vid")
    met = elem_vertex(mesh.elem).join(at, "vid").groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*"xyz").alias("p"), F.col("value").cast("double").alias("f")))).alias("c"))
    p, f = F.transform("c", lambda c: c["p"]), F.transform("c", lambda c: c["f"])
    whole = shape.by_type(F.col("etype"), lambda n: shape.integral(n, F.col("p"), F.col("f")))
    return met.select(*ID, p.alias("p"), f.alias("f")).select(*ID, whole.alias("integral")).filter(F.col("integral").isNotNull())


def factor(total: Column, least: float = 1e-8) -> Column:
    """What makes an integral 1; 0 for integrals next to 0."""
    return F.when(F.abs(total) > least, 1 / total).otherwise(0.0)


def normalise(mesh: Mesh, nodal: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(group, total, factor) of a field over the whole mesh (group 0) or over each group of elements (etype, id, group)."""
    each = integrals(mesh, nodal)
    each = each.withColumn("group", F.lit(0).cast("long")) if groups is None else each.join(groups, ID)
    return each.groupBy("group").agg(F.sum("integral").alias("total")).withColumn("factor", factor(F.col("total")))


def matching_groups(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(a_set, b_set, *keys): sets (set_id, *keys) of two meshes whose tags agree in all keys, nulls with nulls."""
    left, right = a.select(F.col("set_id").alias("a_set"), *keys).alias("l"), b.select(F.col("set_id").alias("b_set"), *keys).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).select("a_set", "b_set", *[F.col(f"l.{k}") for k in keys])
