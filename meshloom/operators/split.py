"""Splitting a mesh along cuts, manifold or not: elements on different sides of a cut get vertices of their own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import corners, explode_sides
from ..model import Mesh, MeshError, dimension, elem_vertex
from ..storage import numbered, written
from .sets import components

ID = ["etype", "id"]


def split(mesh: Mesh, cut: DataFrame, dim: int) -> tuple[Mesh, DataFrame]:
    """The mesh cut open along sides (key: sorted vertices) of its elements of dimension dim, and (id, old) of its new vertices.

    Around each vertex of the cut, elements that reach one another over sides which aren't cut stay together;
    each such group but that with the least element gets a copy of the vertex. So a cut that ends inside the mesh
    leaves its rim whole, and one along which several sheets meet parts as many groups as there are. A side that
    more than two elements share holds all of them together unless it is cut. Lower elements that lie on the cut go with the
    least group. Copies are numbered after the greatest vertex by (old, group); sets and tags stay as they are.
    """
    if dim not in (2, 3):
        raise MeshError("elements of dimension 2 or 3 are split")
    own = mesh.elem.filter(dimension(F.col("etype")) == dim)
    keys = cut.select("key").distinct()
    rim = keys.select(F.explode("key").alias("vid")).distinct()
    ends = elem_vertex(own.withColumn("conn", corners(F.col("etype"), F.col("conn")))).join(rim, "vid", "left_semi").select(*ID, "vid").distinct()
    ends = written(numbered(ends, ["vid", *ID], "n"), "cut-ends")  # the least element of a vertex has its least number
    whole = explode_sides(own, dim - 1).join(keys, "key", "left_anti").select("key", *ID, F.explode("key").alias("vid"))
    held = whole.join(ends, [*ID, "vid"]).select("key", "vid", "n")
    chain = held.select("n", F.lead("n").over(Window.partitionBy("key", "vid").orderBy("n")).alias("b")).filter("b is not null")
    label = components(ends.select("n"), chain.select(F.col("n").alias("a"), "b"))
    met = written(ends.join(label, ends.n == label.node).select(*ID, "vid", "label"), "cut-groups")
    first = met.groupBy("vid").agg(F.min("label").alias("first"))
    group = met.join(first, "vid").filter("label <> first").select("vid", "label").distinct()
    top = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = written(numbered(group, ["vid", "label"], "new", top + 1), "cut-vertices")
    copies = mesh.vertex.join(new.select(F.col("vid").alias("id"), "new"), "id").select(F.col("new").alias("id"), *[c for c in mesh.vertex.columns if c != "id"])
    changed = met.join(new, ["vid", "label"]).select(*ID, "vid", "new")
    swaps = changed.groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("vid", "new"))).alias("swap"))  # at most an element's corners
    elem = mesh.elem.join(swaps, ID, "left").withColumn("conn", F.when(F.col("swap").isNull(), F.col("conn")).otherwise(F.transform("conn", lambda v: F.coalesce(F.col("swap")[v], v))))
    return replace(mesh, vertex=mesh.vertex.unionByName(copies.select(mesh.vertex.columns)), elem=elem.select(mesh.elem.columns)), new.select(F.col("new").alias("id"), F.col("vid").alias("old"))


def faces_of_cut(mesh: Mesh, opened: Mesh, lineage: DataFrame, dim: int) -> DataFrame:
    """(key, etype, id, side): the sides that the cut laid open, by their old vertices; a parted side has a row for each element at it.

    Those that were on the skin before are not among them.
    """
    old = lineage.withColumnRenamed("id", "vid")

    def skin(m: Mesh) -> DataFrame:
        rows = explode_sides(m.elem.filter(dimension(F.col("etype")) == dim), dim - 1)
        once = rows.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct(*ID, "side")).alias("at")).filter("n = 1")
        return once.select("key", "at.*")

    now = skin(opened).withColumn("vid", F.explode("key")).join(old, "vid", "left")
    named = now.groupBy(*ID, "side").agg(F.array_sort(F.collect_list(F.coalesce("old", "vid"))).alias("key"))
    return named.join(skin(mesh).select(*ID, "side"), [*ID, "side"], "left_anti").select("key", *ID, "side")
