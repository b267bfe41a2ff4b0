"""Text files of lines `v x y z` and `f a b c ..`: vertices and faces, numbered by their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh
from . import lines as L


def read(spark: SparkSession, path: str) -> Mesh:
    """Faces with three, four or more corners become TRI, QUAD and POLYGON. Of v/vt/vn only v is kept; a negative v counts back from the last vertex."""
    every = L.lines(spark, path).select(F.lit(0).alias("head_line"), "line", "text")

    def rows(keyword: str) -> DataFrame:
        found = every.filter(F.col("text").rlike(rf"^\s*{keyword}\s"))
        w = L.words(F.col("text"))
        return L.counted(found, F.lit(1)).select((F.col("before") + 1).alias("id"), F.slice(w, 2, F.size(w) - 1).alias("f"), "line")

    points = rows("v")
    vertex = points.select("id", *[F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    conn = F.transform("f", lambda s: F.split_part(s, F.lit("/"), F.lit(1)).cast("long"))
    face = rows("f").select("id", "line", conn.alias("conn"))
    back = face.filter(F.exists("conn", lambda v: v < 0)).select("id", "line")
    # how many vertices stand before each such face
    seen = L.counted(points.select(F.lit(0).alias("head_line"), "line", F.lit(1).alias("n"), F.lit(None).cast("long").alias("id")).unionByName(back.select(F.lit(0).alias("head_line"), "line", F.lit(0).alias("n"), "id")), F.col("n")).filter("n = 0").select("id", F.col("before").alias("seen"))
    face = face.join(seen, "id", "left").select("id", F.transform("conn", lambda v: F.when(v < 0, F.col("seen") + v + 1).otherwise(v)).alias("conn"))
    n = F.size("conn")
    kind = F.when(n == 3, ETYPES["TRI"]).when(n == 4, ETYPES["QUAD"]).otherwise(ETYPES["POLYGON"])
    return Mesh(vertex, face.select(kind.alias("etype"), "id", "conn"))


def write(mesh: Mesh, path: str) -> None:
    """Write vertices and faces as a folder of parts; elements of other dimensions are left out."""
    from .vtk import compact

    vertex, elem = compact(Mesh(mesh.vertex, mesh.elem.filter(F.col("etype").isin(ETYPES["TRI"], ETYPES["QUAD"], ETYPES["POLYGON"]))))
    out = vertex.select(F.lit(0).alias("section"), F.col("n").alias("at"), F.concat_ws(" ", F.lit("v"), *[L.number(F.col(c)) for c in "xyz"]).alias("text"))
    conn = F.transform("conn", lambda v: (v + 1).cast("string"))
    L.write(out.unionByName(elem.select(F.lit(1).alias("section"), F.col("n").alias("at"), F.concat_ws(" ", F.lit("f"), F.array_join(conn, " ")).alias("text"))), path)
