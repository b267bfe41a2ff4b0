"""Text files with sections in dollar signs: numbered nodes, and elements with a type and tags (format 2)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import CORNERS
from ..model import ETYPES, Mesh, MeshError, Tag
from ..storage import written
from . import lines as L
from .cards import canonical, checked, placed

# Element type numbers of the format, with the entity type and number of nodes of each.
TYPES = {1: ("EDGE", 2), 2: ("TRI", 3), 3: ("QUAD", 4), 4: ("TET", 4), 5: ("HEX", 8), 6: ("PRISM", 6), 7: ("PYRAMID", 5), 8: ("EDGE", 3), 9: ("TRI", 6), 10: ("QUAD", 9), 11: ("TET", 10), 12: ("HEX", 27), 16: ("QUAD", 8), 17: ("HEX", 20), 18: ("PRISM", 15), 19: ("PYRAMID", 13)}
POINT = 15
# The order in which the format has the middle nodes of edges and faces.
FILE_EDGES = {"TET": "01 12 20 03 23 13", "HEX": "01 03 04 12 15 23 26 37 45 47 56 67", "PRISM": "01 02 03 12 14 25 34 35 45", "PYRAMID": "01 03 04 12 14 23 24 34"}
FILE_FACES = {"HEX": "0321 0154 0473 1265 2376 4567"}


def _reordered(back: bool) -> Column:
    """conn of second-order elements in canonical order, or back in the file's."""
    conn = F.col("conn")
    for name, n in TYPES.values():
        if name in FILE_EDGES and n > CORNERS[name]:
            order = canonical(name, n, FILE_EDGES[name], FILE_FACES.get(name, ""))
            order = [order.index(i) for i in range(n)] if back else order
            conn = F.when((F.col("etype") == ETYPES[name]) & (F.size("conn") == n), F.array(*[F.get("conn", F.lit(i)) for i in order])).otherwise(conn)
    return conn


def read(spark: SparkSession, path: str) -> Mesh:
    """The mesh of a file, with its node and element numbers as ids; the first tag of an element is MATERIAL_SET, the second PARTITION_GROUP.

    Elements of second order keep their middle nodes, in canonical order. Points are left out; any other type, a
    number of nodes that its type doesn't have, and other versions of the format are errors.
    """
    rows = L.sections(L.lines(spark, path), r"^\s*\$")
    version = rows.filter("head = '$MeshFormat'").select("text").limit(1).collect()
    if not version or not version[0][0].strip().startswith("2"):
        raise MeshError("only format 2 is read")
    part = lambda name: L.filled(rows.filter(F.col("head") == name)).filter("at > 0").select(L.words(F.col("text")).alias("w"))
    vertex = part("$Nodes").select(F.get("w", F.lit(0)).try_cast("long").alias("id"), *[F.get("w", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    every = part("$Elements").select(F.transform("w", lambda w: w.try_cast("long")).alias("w"))
    get = lambda i: F.get("w", F.lit(i))
    etype, size = None, None
    for number, (name, n) in TYPES.items():
        etype = (F.when if etype is None else etype.when)(get(1) == number, ETYPES[name])
        size = (F.when if size is None else size.when)(get(1) == number, n)
    # number, type, how many tags, tags, nodes
    conn = F.slice("w", (get(2) + 4).cast("int"), F.lit(1000))
    elem = every.filter(get(1) != POINT).select(etype.alias("etype"), get(0).alias("id"), conn.alias("conn"), get(1).alias("kind"), size.alias("size"), *[F.when(get(2) > i, get(3 + i)).alias(t) for i, t in enumerate(("material", "group"))])
    # an element whose type asks for another number of nodes is as wrong as one of an unknown type
    elem = elem.withColumn("etype", F.when(F.size("conn") == F.col("size"), F.col("etype")))
    elem = checked(written(elem, "elements"), "kind")
    tag = lambda c: Tag(elem.filter(F.col(c).isNotNull()).select("etype", "id", F.col(c).alias("value")))
    return Mesh(placed(vertex), elem.select("etype", "id", _reordered(False).alias("conn")), {"MATERIAL_SET": tag("material"), "PARTITION_GROUP": tag("group")})


def _number() -> Column:
    """The type number of each element; null where the format has none."""
    out = None
    for number, (name, n) in TYPES.items():
        out = (F.when if out is None else out.when)((F.col("etype") == ETYPES[name]) & (F.size("conn") == n), number)
    return out


def write(mesh: Mesh, path: str, material: str | None = None) -> None:
    """Write the mesh as a folder of parts; the named integer tag becomes both tags of each element, 0 where it has no value."""
    spark = mesh.vertex.sparkSession
    vertex, elem = mesh.vertex, mesh.elem
    if not elem.filter(_number().isNull()).isEmpty():
        raise MeshError("the format has no type for some elements")
    n, m = vertex.count(), elem.count()
    elem = elem.withColumn("value", F.lit(0)) if material is None else elem.join(mesh.tag(material).values, ["etype", "id"], "left").fillna(0, ["value"])
    out = L.heading(spark, 0, "$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(n))
    out = out.unionByName(vertex.select(F.lit(0).alias("section"), F.col("id").alias("at"), F.concat_ws(" ", F.col("id").cast("string"), *[L.number(F.col(c)) for c in "xyz"]).alias("text")))
    out = out.unionByName(L.heading(spark, 1, "$EndNodes", "$Elements", str(m)))
    value = F.col("value").cast("string")
    out = out.unionByName(elem.select(F.lit(1).alias("section"), (F.col("id") * 16 + F.col("etype")).alias("at"), F.concat_ws(" ", F.col("id").cast("string"), _number().cast("string"), F.lit("2"), value, value, F.array_join(_reordered(True).cast("array<string>"), " ")).alias("text")))
    L.write(out.unionByName(L.heading(spark, 2, "$EndElements")), path)
