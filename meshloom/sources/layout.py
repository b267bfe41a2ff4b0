"""The native layout: a folder with one Parquet table for vertices, elements, sets, links and each tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh, MeshError, Tag, dimension, elem_vertex
from ..operators.sets import contents, hops


def write(mesh: Mesh, path: str) -> None:
    mesh.vertex.write.parquet(f"{path}/vertex")
    mesh.elem.write.partitionBy("etype").parquet(f"{path}/elem")
    for name, rows in (("member", mesh.member), ("link", mesh.link)):
        if rows is not None:
            rows.write.parquet(f"{path}/{name}")
    for name, tag in mesh.tags.items():
        tag.values.write.parquet(f"{path}/tag_{name}")


def read(spark: SparkSession, path: str, tags: dict[str, object] | None = None, sets: bool = False) -> Mesh:
    """The mesh in a folder; tags names the tags to read with their defaults. Filters on etype skip whole folders."""
    elem = spark.read.parquet(f"{path}/elem").select(F.col("etype").cast("int").alias("etype"), "id", "conn")
    found = {n: Tag(spark.read.parquet(f"{path}/tag_{n}"), d) for n, d in (tags or {}).items()}
    pair = [spark.read.parquet(f"{path}/{n}") if sets else None for n in ("member", "link")]
    return Mesh(spark.read.parquet(f"{path}/vertex"), elem, found, *pair)


def read_sets(spark: SparkSession, path: str, where: dict[str, list | None], *, tags: dict[str, object] | None = None, children: bool = False, elements: str = "EXPLICIT") -> Mesh:
    """The part of a mesh that sets with the given tag values hold (all of the tags; None: any value), sets they hold included.

    children adds the sets below in the parent-child graph. elements: EXPLICIT reads the elements in the sets,
    NODES also every element all of whose vertices are read, SIDES of those only the ones of lower dimension
    than some element in the sets. Vertices are those of the elements and those in the sets. Only the columns
    and the rows of these entities are kept; files of types that aren't wanted are skipped by Spark's filters.
    """
    if elements not in ("EXPLICIT", "NODES", "SIDES"):
        raise MeshError("elements is EXPLICIT, NODES or SIDES")
    mesh = read(spark, path, tags, sets=True)
    sets: DataFrame | None = None
    for name, values in where.items():
        rows = spark.read.parquet(f"{path}/tag_{name}").filter(F.col("etype") == ETYPES["ENTITYSET"])
        rows = (rows if values is None else rows.filter(F.col("value").isin(values))).select(F.col("id").alias("set_id"))
        sets = rows if sets is None else sets.join(rows, "set_id", "left_semi")
    if sets is None:
        raise MeshError("name a tag")
    if children:
        sets = sets.unionByName(hops(mesh.link, sets).select("set_id")).distinct()
    held = contents(mesh.member, sets)
    elem = mesh.elem.join(held, ["etype", "id"], "left_semi")
    own = held.filter("etype = 0").select("id").unionByName(elem_vertex(elem).select(F.col("vid").alias("id"))).distinct()
    if elements != "EXPLICIT":
        met = elem_vertex(mesh.elem).join(own.select(F.col("id").alias("vid"), F.lit(1).alias("in")), "vid", "left")
        whole = met.groupBy("etype", "id").agg(F.count("in").alias("n"), F.count("*").alias("size")).filter("n = size").select("etype", "id")
        if elements == "SIDES":
            top = elem.agg(F.max(dimension(F.col("etype"))).alias("top"))  # one row
            whole = whole.join(F.broadcast(top), dimension(F.col("etype")) < F.col("top")).select("etype", "id")
        elem = mesh.elem.join(whole.unionByName(elem.select("etype", "id")).distinct(), ["etype", "id"], "left_semi")
    kept = elem.select("etype", "id").unionByName(own.select(F.lit(0).alias("etype"), "id"))
    found = {n: Tag(t.values.join(kept, ["etype", "id"], "left_semi"), t.default) for n, t in mesh.tags.items()}
    member = mesh.member.join(sets.select("set_id"), "set_id", "left_semi")
    return Mesh(mesh.vertex.join(own, "id", "left_semi"), elem, found, member, mesh.link)
