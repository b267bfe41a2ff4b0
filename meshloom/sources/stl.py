"""Text files of facets: triangles with their corners' coordinates. Equal coordinates are one vertex."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import Vec
from ..model import ETYPES, Mesh, MeshError
from ..operators.measure import with_points
from ..storage import numbered, written
from . import lines as L


def read(spark: SparkSession, path: str) -> Mesh:
    """Triangles in the file's order; vertices numbered by their coordinates. -0.0 counts as 0.0."""
    rows = L.lines(spark, path).filter(F.col("text").rlike(r"^\s*vertex\s")).select(F.lit(0).alias("head_line"), "line", "text")
    get = lambda i: F.get(L.words(F.col("text")), F.lit(i)).cast("double") + 0.0
    corner = L.counted(rows, F.lit(1)).select((F.floor(F.col("before") / 3) + 1).alias("id"), (F.col("before") % 3).alias("pos"), *[get(i + 1).alias(c) for i, c in enumerate("xyz")])
    return _joined(written(corner, "facets"))


def read_binary(spark: SparkSession, path: str) -> Mesh:
    """The mesh of binary files (one, or a folder of them), triangles in the order of files and facets.

    A file has 80 bytes of header, a count, and 50 bytes a facet. Each file is one row of at most 2 GB, read by
    one task; a count that disagrees with the file's length is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        record = np.dtype([("normal", "<f4", 3), ("p", "<f4", (3, 3)), ("attribute", "<u2")])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                count = int(np.frombuffer(data, "<u4", 1, 80)[0]) if len(data) >= 84 else -1
                if len(data) != 84 + record.itemsize * count:
                    raise MeshError(f"{name.as_py()} is no binary file of facets")
                points = np.frombuffer(data, record, count, 84)["p"].reshape(-1, 3).astype(np.float64) + 0.0
                for lo in range(0, len(points), 1 << 18):
                    part = points[lo : lo + (1 << 18)]
                    at = np.arange(lo, lo + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(at // 3), pa.array(at % 3), *[pa.array(part[:, i]) for i in range(3)]], names=["path", "facet", "pos", "x", "y", "z"])

    rows = written(files.mapInArrow(run, "path string, facet long, pos long, x double, y double, z double"), "facets")
    size = rows.groupBy("path").agg((F.max("facet") + 1).alias("n"))
    ahead = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    before = size.select("path", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return _joined(rows.join(before, "path").select((F.col("before") + F.col("facet") + 1).alias("id"), "pos", "x", "y", "z"))


def _joined(corner: DataFrame) -> Mesh:
    vertex = written(numbered(corner.select(*"xyz").distinct(), list("xyz"), "id"), "vertices")
    met = corner.join(vertex.withColumnRenamed("id", "vid"), list("xyz"))
    conn = met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("conn"))
    return Mesh(vertex.select("id", *"xyz"), conn.select(F.lit(ETYPES["TRI"]).alias("etype"), "id", "conn"))


def write(mesh: Mesh, path: str, name: str = "mesh") -> None:
    """Write the mesh's triangles, with their normals, as a folder of parts; other elements are left out."""
    spark = mesh.vertex.sparkSession
    rows = with_points(Mesh(mesh.vertex, mesh.elem.filter(F.col("etype") == ETYPES["TRI"])))
    at = lambda i: Vec.of(F.get("p", F.lit(i)))
    show = lambda v: F.concat_ws(" ", *[L.number(F.coalesce(getattr(v, c), F.lit(0.0))) for c in "xyz"])
    normal = (at(1) - at(0)).cross(at(2) - at(0)).unit()
    text = F.array(F.concat(F.lit("facet normal "), show(normal)), F.lit("outer loop"), *[F.concat(F.lit("vertex "), show(at(i))) for i in range(3)], F.lit("endloop"), F.lit("endfacet"))
    lines = rows.select("id", F.posexplode(text).alias("i", "text")).select(F.lit(0).alias("section"), (F.col("id") * 8 + F.col("i")).alias("at"), "text")
    out = L.heading(spark, -1, f"solid {name}").unionByName(lines).unionByName(L.heading(spark, 1, f"endsolid {name}"))
    L.write(out, path)
