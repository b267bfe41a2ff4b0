"""Sizes of elements, planar overlap of convex polygons, and weights for remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import let
from ..functions.vector import Vec, det
from ..model import ETYPES, Mesh, elem_vertex

# The tetrahedra whose volumes add up to each solid's measure.
TETRAHEDRA = {"TET": "0123", "PYRAMID": "0124 0234", "PRISM": "0125 3540 1450", "HEX": "0134 7364 4516 1634 2631"}


def with_points(mesh: Mesh) -> DataFrame:
    """(etype, id, p): p has each element's vertices as structs (x, y, z), in order."""
    met = elem_vertex(mesh.elem).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    rows = met.groupBy("etype", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("p"))
    return rows.withColumn("p", F.transform("p", lambda v: F.struct(v["x"], v["y"], v["z"])))


def measure(etype: Column, p: Column) -> Column:
    """Length, area or volume of an element from its points; 0 for other types."""
    at = lambda i: Vec.of(F.get(p, F.lit(i)))
    n = F.size(p)
    sums = lambda c: F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v[c])
    mid = Vec(sums("x") / n, sums("y") / n, sums("z") / n)
    fan = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (mid - Vec.of(F.get(p, i))).cross(mid - Vec.of(F.get(p, (i + 1) % n))).norm() / 2)
    polygon = F.aggregate(fan, F.lit(0.0), lambda acc, x: acc + x)
    out = F.when(etype == ETYPES["EDGE"], (at(1) - at(0)).norm())
    out = out.when(etype == ETYPES["TRI"], (at(1) - at(0)).cross(at(2) - at(0)).norm() / 2)
    out = out.when(etype.isin(ETYPES["QUAD"], ETYPES["POLYGON"]), polygon)
    for name, text in TETRAHEDRA.items():
        total = F.lit(0.0)
        for a, b, c, d in text.split():
            o = at(int(a))
            total = total + det(at(int(b)) - o, at(int(c)) - o, at(int(d)) - o) / 6
        out = out.when(etype == ETYPES[name], total)
    return out.otherwise(0.0)


def clip(subject: Column, window: Column) -> Column:
    """The part of a convex polygon inside another, both arrays of (x, y), counterclockwise."""

    def cut(poly: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        n = F.size(poly)
        none = F.array().cast("array<struct<x:double,y:double>>")

        def kept(sides: Column) -> Column:  # of each corner, computed once
            def step(v: Column, i: Column) -> Column:
                j = (i + n - 1) % n
                u, su, sv = F.get(poly, j), F.get(sides, j), F.get(sides, i)
                met = let(su / F.nullif(su - sv, F.lit(0.0)), lambda k: F.struct((u["x"] + (v["x"] - u["x"]) * k).alias("x"), (u["y"] + (v["y"] - u["y"]) * k).alias("y")))
                own = F.struct(v["x"].alias("x"), v["y"].alias("y"))
                return F.when((sv >= 0) & (su >= 0), F.array(own)).when(sv >= 0, F.array(met, own)).when(su >= 0, F.array(met)).otherwise(none)

            return F.flatten(F.transform(poly, step))

        return let(F.transform(poly, lambda v: (b["x"] - a["x"]) * (v["y"] - a["y"]) - (b["y"] - a["y"]) * (v["x"] - a["x"])), kept)

    n = F.size(window)
    edges = F.transform(window, lambda v, i: F.struct(v.alias("a"), F.get(window, (i + 1) % n).alias("b")))
    return F.aggregate(edges, subject, cut)


def planar_area(poly: Column) -> Column:
    n = F.size(poly)
    terms = F.transform(poly, lambda v, i: v["x"] * F.get(poly, (i + 1) % n)["y"] - F.get(poly, (i + 1) % n)["x"] * v["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)) / 2).otherwise(0.0)


def overlaps(source: DataFrame, target: DataFrame, width: float, least: float = 1e-14) -> DataFrame:
    """(src, tgt, area) of the overlapping pairs of cells (id, poly); cells meet in grid cells of the given width."""

    def covered(cells: DataFrame, name: str) -> DataFrame:
        rows = cells.select(F.col("id").alias(name), F.col("poly").alias(name + "_poly"))
        for c in "xy":
            v = F.col(f"{name}_poly.{c}")  # an array: that field of each corner
            rows = rows.withColumn(f"{name}_{c}0", F.array_min(v)).withColumn(f"{name}_{c}1", F.array_max(v))
        for c in "xy":
            rows = rows.withColumn("c" + c, F.explode(F.sequence(F.floor(F.col(f"{name}_{c}0") / width), F.floor(F.col(f"{name}_{c}1") / width))))
        return rows

    pairs = covered(source, "src").join(covered(target, "tgt").hint("merge"), ["cx", "cy"])
    sides = []
    for c in "xy":  # a pair counts in one cell only: the first that both touch; boxes that only touch have no area in common
        low, high = F.greatest(f"src_{c}0", f"tgt_{c}0"), F.least(f"src_{c}1", f"tgt_{c}1")
        pairs = pairs.filter((low < high) & (F.col("c" + c) == F.floor(low / width)))
        sides.append(high - low)
    pairs = pairs.filter(sides[0] * sides[1] > least / 2)
    # a filter on the area would be pushed below it and clip each pair twice
    area = F.array(planar_area(clip(F.col("src_poly"), F.col("tgt_poly"))))
    return pairs.select("src", "tgt", F.explode(F.filter(area, lambda x: x > least)).alias("area"))


def weights(overlap: DataFrame) -> DataFrame:
    """(row, col, w): first-order conservative weights, the share of each target cell that a source cell covers."""
    total = overlap.groupBy("tgt").agg(F.sum("area").alias("total"))
    return overlap.join(total, "tgt").select(F.col("tgt").alias("row"), F.col("src").alias("col"), (F.col("area") / F.col("total")).alias("w"))


def apply_weights(w: DataFrame, values: DataFrame, transpose: bool = False) -> DataFrame:
    """(id, value): the weighted sums of values (id, value)."""
    a, b = ("row", "col") if transpose else ("col", "row")
    met = w.join(values.withColumnRenamed("id", a), a)
    return met.groupBy(F.col(b).alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
