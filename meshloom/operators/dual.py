"""Sheets of hexahedra and quadrilaterals, and the dual of a mesh of solids: rings around edges, cells around vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import corners, explode_sides, sides
from ..functions.rings import chained
from ..model import ETYPES, dimension
from ..storage import numbered, written
from .sets import components

ID = ["etype", "id"]
#: The edges of a hexahedron that run side by side, by their numbers.
PARALLEL = {"HEX": ((0, 2, 8, 10), (1, 3, 9, 11), (4, 5, 6, 7)), "QUAD": ((0, 2), (1, 3))}


def sheets(elem: DataFrame) -> DataFrame:
    """(etype, id, axis, sheet): for each of an element's directions the sheet that it belongs to, named by the least number of its edges.

    A sheet holds the hexahedra (or quadrilaterals) that are reached over opposite edges; each element is in one for each
    direction, twice in the same one where a sheet crosses itself. Edges are numbered by their vertices.
    """
    parts = []
    for name, groups in PARALLEL.items():
        own = elem.filter(F.col("etype") == ETYPES[name])
        direction = F.array(*[F.lit(next(i for i, g in enumerate(groups) if e in g)) for e in range(sum(map(len, groups)))])
        parts.append(explode_sides(own, 1).select(*ID, F.get(direction, F.col("side")).alias("axis"), "key"))
    rows = parts[0].unionByName(parts[1])
    names = written(numbered(rows.select("key").distinct(), ["key"], "n"), "edges")
    ends = written(rows.join(names, "key").select(*ID, "axis", "n"), "sheet-edges")
    first = ends.groupBy(*ID, "axis").agg(F.min("n").alias("a"))
    pairs = ends.join(first, [*ID, "axis"]).select("a", F.col("n").alias("b")).filter("a <> b")
    label = components(names.select("n"), pairs)
    return first.join(label, first.a == label.node).select(*ID, "axis", F.col("label").alias("sheet"))


def edge_rings(elem: DataFrame) -> DataFrame:
    """(a, b, ring, fans, closed): for each edge of solids the elements (etype, id) around it, each beside the ones with which it shares a face.

    closed rings are inside the mesh; fans > 1 tells that the solids at an edge hang together by it alone. One
    edge's solids are one row.
    """
    solid = elem.filter(dimension(F.col("etype")) == 3).withColumn("conn", corners(F.col("etype"), F.col("conn")))
    faces = F.transform(sides(F.col("etype"), F.col("conn"), 2), lambda s: F.array_sort(s))
    rows = solid.select(*ID, faces.alias("faces"), F.explode(F.transform(sides(F.col("etype"), F.col("conn"), 1), lambda s: F.array_sort(s))).alias("edge"))
    at = F.filter("faces", lambda f: F.array_contains(f, F.get("edge", F.lit(0))) & F.array_contains(f, F.get("edge", F.lit(1))))
    rows = rows.select("edge", F.struct(*ID, F.get(at, F.lit(0)).alias("a"), F.get(at, F.lit(1)).alias("b")).alias("e"))
    grouped = rows.groupBy("edge").agg(F.array_sort(F.collect_list("e")).alias("e"))
    ordered = grouped.select("edge", "e", chained(F.col("e")).alias("o"))
    ring = F.transform("o.order", lambda i: F.struct(F.get("e", i)["etype"].alias("etype"), F.get("e", i)["id"].alias("id")))
    return ordered.select(F.get("edge", F.lit(0)).alias("a"), F.get("edge", F.lit(1)).alias("b"), ring.alias("ring"), "o.fans", "o.closed")


def cells(elem: DataFrame) -> DataFrame:
    """(vid, faces, whole): the dual cell of each vertex: for each edge at it the ring of solids that are the corners of a face of the cell.

    whole tells that all rings are closed, so that the cell is a polyhedron; the cells of vertices on the skin are open there.
    """
    rings = edge_rings(elem)
    both = rings.select(F.col("a").alias("vid"), F.col("b").alias("to"), "ring", "closed").unionByName(rings.select(F.col("b").alias("vid"), F.col("a").alias("to"), "ring", "closed"))
    faces = F.transform(F.array_sort(F.collect_list(F.struct("to", "ring"))), lambda f: f["ring"])
    return both.groupBy("vid").agg(faces.alias("faces"), F.min("closed").alias("whole"))
