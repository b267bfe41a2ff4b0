"""Legacy text files with an unstructured grid: points, cells, cell types, scalar and vector data.

Points, types and data may be broken into lines anywhere; a cell stands on a line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh, MeshError, Tag
from ..storage import numbered, written
from . import lines as L

# Cell type numbers of the format and the entity types they stand for.
CELL_TYPES = {1: "VERTEX", 3: "EDGE", 5: "TRI", 7: "POLYGON", 8: "QUAD", 9: "QUAD", 10: "TET", 11: "HEX", 12: "HEX", 13: "PRISM", 14: "PYRAMID", 21: "EDGE", 22: "TRI", 23: "QUAD", 24: "TET", 25: "HEX"}
# The order of corners of cell types that number them otherwise.
REORDERED = {8: (0, 1, 3, 2), 11: (0, 1, 3, 2, 4, 5, 7, 6)}
WRITTEN = {"EDGE": 3, "TRI": 5, "QUAD": 9, "POLYGON": 7, "TET": 10, "PYRAMID": 14, "PRISM": 13, "HEX": 12}
_HEAD = r"^\s*(POINTS|CELLS|CELL_TYPES|POINT_DATA|CELL_DATA|SCALARS|VECTORS|NORMALS|TENSORS|FIELD|LOOKUP_TABLE|METADATA|DATASET)\b"


def read(spark: SparkSession, path: str) -> Mesh:
    """The mesh of a file; ids begin at 1, in the file's order, over all cell types. Data are tags by name, on points (type VERTEX) and cells."""
    rows = L.lines(spark, path)
    parts = written(L.sections(rows, _HEAD), "vtk-sections")
    heads = rows.filter(F.col("text").rlike(_HEAD)).select("line", F.trim("text").alias("head")).orderBy("line").collect()  # a few a file
    part = lambda name: parts.filter(F.col("head").startswith(name + " "))
    vertex = L.points(L.tokens(part("POINTS")))
    cells = L.filled(part("CELLS")).select((F.col("at") + 1).alias("id"), F.transform(L.words(F.col("text")), lambda w: w.try_cast("long")).alias("w"))
    if not cells.filter(~(F.get("w", F.lit(0)) + 1).eqNullSafe(F.size("w"))).isEmpty():
        raise MeshError("a cell isn't on a line of its own")
    types = L.tokens(part("CELL_TYPES")).select((F.col("at") + 1).alias("id"), F.col("token").try_cast("int").alias("type"))
    conn = F.transform(F.slice("w", 2, F.size("w") - 1), lambda v: v + 1)
    etype = None
    for number, name in CELL_TYPES.items():
        etype = (F.when if etype is None else etype.when)(F.col("type") == number, ETYPES[name])
    for number, order in REORDERED.items():
        conn = F.when(F.col("type") == number, F.array(*[F.get(conn, F.lit(i)) for i in order])).otherwise(conn)
    elem = cells.join(types, "id").select(etype.alias("etype"), "id", conn.alias("conn"))
    lost = elem.filter(F.col("etype").isNull())
    if not lost.isEmpty():
        raise MeshError("a cell has a type that isn't known")
    return Mesh(vertex, elem.filter(F.col("etype") != 0), _data(parts, heads, elem))


def _data(parts: DataFrame, heads: list, elem: DataFrame) -> dict[str, Tag]:
    """Tags of the data sections; the values of a scalar follow its look-up table's line."""
    tags: dict[str, Tag] = {}
    on, pending = "", None
    for line, head in heads:
        w = head.split()
        if w[0] in ("POINT_DATA", "CELL_DATA"):
            on = w[0]
        name, kind, at, width = None, "double", line, 1
        if w[0] == "SCALARS":
            pending = w
            follow = [h for n, h in heads if n > line][:1]
            if not follow or not follow[0].startswith("LOOKUP_TABLE"):
                name, kind = w[1], w[2]
        elif w[0] == "LOOKUP_TABLE" and pending:
            name, kind, pending = pending[1], pending[2], None
        elif w[0] in ("VECTORS", "NORMALS"):
            name, width = w[1], 3
        if not name or not on:
            continue
        cast = "long" if kind in ("int", "long", "short", "char", "unsigned_int", "unsigned_long") else "double"
        values = L.tokens(parts.filter(F.col("head_line") == at)).select((F.floor(F.col("at") / width) + 1).alias("id"), (F.col("at") % width).alias("i"), F.col("token").try_cast(cast).alias("value"))
        if width > 1:
            values = values.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("value"))
        if on == "POINT_DATA":
            rows = values.select(F.lit(0).alias("etype"), "id", "value")
        else:
            rows = values.join(elem.select("etype", "id"), "id").select("etype", "id", "value")
        tags[name] = Tag(rows if name not in tags else tags[name].values.unionByName(rows))
    return tags


def _etype(column: Column, table: dict[str, int]) -> Column:
    out = None
    for name, number in table.items():
        out = (F.when if out is None else out.when)(column == ETYPES[name], number)
    return out


def compact(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """Vertices (n, id, x, y, z), numbered from 0 by id, and elements (n, etype, id, conn) with conn in these numbers, by (etype, id)."""
    vertex = written(numbered(mesh.vertex, ["id"], "n", 0), "vertices")
    met = mesh.elem.select("etype", "id", F.posexplode("conn").alias("pos", "vid")).join(vertex.select(F.col("id").alias("vid"), "n"), "vid")
    conn = met.groupBy("etype", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("conn"))
    return vertex, written(numbered(conn, ["etype", "id"], "n", 0), "elements")


def write(mesh: Mesh, path: str, tags: list[str] | None = None) -> None:
    """Write the mesh, and the named scalar tags of its elements, as a folder of parts. Elements without a value of a tag get 0."""
    spark = mesh.vertex.sparkSession
    vertex, elem = compact(mesh)
    n, m = vertex.count(), elem.count()
    size = elem.agg(F.coalesce(F.sum(F.size("conn") + 1), F.lit(0))).first()[0]
    join = lambda *c: F.concat_ws(" ", *c)
    out = L.heading(spark, 0, "# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double")
    out = out.unionByName(vertex.select(F.lit(0).alias("section"), F.col("n").alias("at"), join(*[L.number(F.col(c)) for c in "xyz"]).alias("text")))
    out = out.unionByName(L.heading(spark, 1, f"CELLS {m} {size}")).unionByName(elem.select(F.lit(1).alias("section"), F.col("n").alias("at"), join(F.size("conn"), F.array_join(F.col("conn").cast("array<string>"), " ")).alias("text")))
    out = out.unionByName(L.heading(spark, 2, f"CELL_TYPES {m}")).unionByName(elem.select(F.lit(2).alias("section"), F.col("n").alias("at"), _etype(F.col("etype"), WRITTEN).cast("string").alias("text")))
    for i, name in enumerate(tags or []):
        values = elem.join(mesh.tag(name).values, ["etype", "id"], "left").select("n", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        head = ([f"CELL_DATA {m}"] if not i else []) + [f"SCALARS {name} double 1", "LOOKUP_TABLE default"]
        out = out.unionByName(L.heading(spark, 3 + i, *head)).unionByName(values.select(F.lit(3 + i).alias("section"), F.col("n").alias("at"), L.number(F.col("value")).alias("text")))
    L.write(out, path)
