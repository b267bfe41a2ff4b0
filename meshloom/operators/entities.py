"""Entity and tag queries: filters, semi joins and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import corners
from ..model import DIMENSIONS, ETYPES, Mesh, MeshError, Tag, dimension, elem_vertex, etype_of
from ..storage import numbered

ID = ["etype", "id"]
#: Stands for "any value" in a tag predicate.
ANY = object()


def by_type(mesh: Mesh, etype: str | int, within: DataFrame | None = None) -> DataFrame:
    rows = mesh.entities().filter(F.col("etype") == etype_of(etype))
    return rows if within is None else rows.join(within, ID, "left_semi")


def by_dimension(mesh: Mesh, dim: int, within: DataFrame | None = None) -> DataFrame:
    rows = mesh.entities().filter(dimension(F.col("etype")) == dim)
    return rows if within is None else rows.join(within, ID, "left_semi")


def counts(mesh: Mesh) -> DataFrame:
    """(etype, n) of each entity type that the mesh has."""
    return mesh.entities().groupBy("etype").agg(F.count("*").alias("n"))


def by_type_and_tag(mesh: Mesh, etype: str | int, predicates: Mapping[str, object], mode: str = "INTERSECT", within: DataFrame | None = None) -> DataFrame:
    """Entities of the type for which all (INTERSECT) or any (UNION) of the predicates hold.

    A predicate is a tag name with a value, or with ANY for presence. An entity without a value counts as
    having the tag's default; presence asks for a value of its own unless there is a default.
    """
    if mode not in ("INTERSECT", "UNION"):
        raise MeshError("mode is INTERSECT or UNION")
    rows = by_type(mesh, etype, within)
    if not predicates:
        return rows.limit(0) if mode == "UNION" else rows
    if mode == "INTERSECT":
        for name, value in predicates.items():
            rows = _having(rows, mesh.tag(name), value)
        return rows
    return reduce(DataFrame.unionByName, [_having(rows, mesh.tag(n), v) for n, v in predicates.items()]).distinct()


def _having(rows: DataFrame, tag: Tag, value: object) -> DataFrame:
    if value is ANY:
        return rows if tag.default is not None else rows.join(tag.values, ID, "left_semi")
    if value != tag.default or tag.default is None:
        return rows.join(tag.values.filter(F.col("value") == F.lit(value)), ID, "left_semi")
    return rows.join(tag.values.filter(F.col("value") != F.lit(value)), ID, "left_anti")


def tag_data(rows: DataFrame, tag: Tag, *, strict: bool = False) -> DataFrame:
    """rows with the column value: the tag's, or its default, or null; an error instead of null if strict."""
    if strict and tag.default is None and not rows.join(tag.values, ID, "left_anti").isEmpty():
        raise MeshError("an entity has no value of the tag, and the tag no default")
    out = rows.join(tag.values.select(*ID, "value"), ID, "left")
    return out if tag.default is None else out.withColumn("value", F.coalesce("value", F.lit(tag.default)))


def tag_set(tag: Tag, rows: DataFrame) -> Tag:
    """The tag after each of rows (etype, id, value) replaced the value of its entity; of several for one entity the greatest counts."""
    new = rows.groupBy(*ID).agg(F.max("value").alias("value"))
    return Tag(tag.values.join(new, ID, "left_anti").unionByName(new.select(*tag.values.columns)), tag.default)


def tag_clear(tag: Tag, entities: DataFrame, value: object) -> Tag:
    return tag_set(tag, entities.select(*ID, F.lit(value).alias("value")))


def tag_delete(tag: Tag, entities: DataFrame) -> Tag:
    return Tag(tag.values.join(entities, ID, "left_anti"), tag.default)


def tag_stats(rows: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Count, least, greatest, sum and root mean square of value for each group."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(value).alias("total"), F.sqrt(F.avg(value * value)).alias("rms"))


def propagate(member: DataFrame, set_values: DataFrame) -> DataFrame:
    """(etype, id, value): values (set_id, value) of sets, given to their members; the least of several wins."""
    return member.join(set_values, "set_id").groupBy(*ID).agg(F.min("value").alias("value"))


def connectivity(elem: DataFrame, corners_only: bool = False) -> DataFrame:
    """The distinct vertices (id) of elements."""
    rows = elem.withColumn("conn", corners(F.col("etype"), F.col("conn"))) if corners_only else elem
    return elem_vertex(rows).select(F.col("vid").alias("id")).distinct()


def positions(mesh: Mesh, distinct: bool = True) -> DataFrame:
    """(etype, id, x, y, z): the mean of each element's vertices, repeated ones once if distinct."""
    rows = mesh.elem.select(*ID, F.explode(F.array_distinct("conn") if distinct else F.col("conn")).alias("vid"))
    met = rows.join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    return met.groupBy(*ID).agg(*[F.avg(c).alias(c) for c in "xyz"])


def delete(mesh: Mesh, entities: DataFrame) -> Mesh:
    """The mesh without the entities, their tag values and their places in sets."""
    vertices = entities.filter("etype = 0").select("id")
    tags = {n: tag_delete(t, entities) for n, t in mesh.tags.items()}
    member = mesh.member and mesh.member.join(entities, ID, "left_anti")
    return Mesh(mesh.vertex.join(vertices, "id", "left_anti"), mesh.elem.join(entities, ID, "left_anti"), tags, member, mesh.link)


def replace_vertices(mesh: Mesh, kept: DataFrame) -> Mesh:
    """The mesh with vertex ids mapped by rows (id, keep); vertices that are mapped away go."""
    gone = kept.filter("id <> keep").select(F.col("id").alias("vid"), "keep")
    met = elem_vertex(mesh.elem).join(gone, "vid", "left").withColumn("vid", F.coalesce("keep", "vid"))
    rows = met.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("conn"))
    return Mesh(mesh.vertex.join(gone.select(F.col("vid").alias("id")), "id", "left_anti"), rows, mesh.tags, mesh.member, mesh.link)


def assign_ids(entities: DataFrame, start: int = 1) -> DataFrame:
    """entities with gid: consecutive numbers in the order of (etype, id), without a sort in one task. Further columns are kept."""
    return numbered(entities, ID, "gid", start)


def set_coords(mesh: Mesh, moved: DataFrame) -> Mesh:
    """The mesh with the positions of moved (id, x, y, z); other vertices stay, unknown ids change nothing."""
    new = moved.select("id", *[F.col(c).alias("n" + c) for c in "xyz"])
    vertex = mesh.vertex.join(new, "id", "left").select("id", *[F.coalesce("n" + c, c).alias(c) for c in "xyz"])
    return replace(mesh, vertex=vertex)


def set_connectivity(mesh: Mesh, changed: DataFrame) -> Mesh:
    """The mesh with the connectivity of changed (etype, id, conn) in place of the elements' own."""
    new = changed.select(*ID, F.col("conn").alias("new"))
    return replace(mesh, elem=mesh.elem.join(new, ID, "left").select(*ID, F.coalesce("new", "conn").alias("conn")))


def create_vertices(mesh: Mesh, points: DataFrame) -> Mesh:
    """The mesh with more vertices, one for each row (x, y, z), numbered in that order after its greatest id."""
    top = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return replace(mesh, vertex=mesh.vertex.unionByName(numbered(points.select(*"xyz"), list("xyz"), "id", top + 1)))


def create_elements(mesh: Mesh, etype: str | int, conns: DataFrame) -> Mesh:
    """The mesh with more elements of a type, one for each row (conn), numbered in that order after the type's greatest id.

    A vertex that isn't in the mesh is an error.
    """
    kind = etype_of(etype)
    rows = conns.select("conn")
    lost = rows.select(F.explode("conn").alias("id")).join(mesh.vertex, "id", "left_anti")
    if DIMENSIONS[kind] != 3 or kind != ETYPES["POLYHEDRON"]:
        if not lost.isEmpty():
            raise MeshError("an element's vertex is not in the mesh")
    top = mesh.elem.filter(F.col("etype") == kind).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(rows, ["conn"], "id", top + 1).select(F.lit(kind).alias("etype"), "id", "conn")
    return replace(mesh, elem=mesh.elem.unionByName(new))


def existing(mesh: Mesh, wanted: DataFrame) -> DataFrame:
    """wanted (etype, id) with valid: whether the mesh has the entity."""
    have = mesh.entities().select(*ID, F.lit(True).alias("valid"))
    return wanted.select(*ID).join(have, ID, "left").select(*ID, F.coalesce("valid", F.lit(False)).alias("valid"))


def vertices(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """(etype, id, vid): the distinct vertices of each of the entities; a vertex is its own, polyhedra go through their faces.

    A polyhedron's conn holds the ids of its faces, which are polygons.
    """
    met = mesh.elem.join(entities.select(*ID), ID, "left_semi")
    solid = F.col("etype") == ETYPES["POLYHEDRON"]
    faces = elem_vertex(met.filter(solid)).select(*ID, F.col("vid").alias("face"))
    polygons = elem_vertex(mesh.elem.filter(F.col("etype") == ETYPES["POLYGON"])).select(F.col("id").alias("face"), "vid")
    own = entities.filter("etype = 0").select(*ID, F.col("id").alias("vid"))
    return elem_vertex(met.filter(~solid)).select(*ID, "vid").unionByName(faces.join(polygons, "face").select(*ID, "vid")).unionByName(own).distinct()


def centres(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """(etype, id, x, y, z): a vertex's position, and the plain mean over an element's conn, repeated and mid-side nodes included."""
    met = positions(replace(mesh, elem=mesh.elem.join(entities.select(*ID), ID, "left_semi")), distinct=False)
    own = mesh.vertex.join(entities.filter("etype = 0").select("id"), "id", "left_semi")
    return met.unionByName(own.select(F.lit(0).cast(met.schema["etype"].dataType).alias("etype"), "id", *"xyz"))


def tags_on(mesh: Mesh, entities: DataFrame) -> DataFrame:
    """(etype, id, tag): the names of the tags of which each entity has a value of its own."""
    named = [t.values.join(entities.select(*ID), ID, "left_semi").select(*ID, F.lit(n).alias("tag")) for n, t in mesh.tags.items()]
    return reduce(DataFrame.unionByName, named) if named else entities.select(*ID, F.lit("").alias("tag")).limit(0)


def tag_counts(mesh: Mesh) -> DataFrame:
    """(tag, etype, n): how many entities of each type have a value of each tag."""
    named = [t.values.groupBy("etype").agg(F.count("*").alias("n")).select(F.lit(k).alias("tag"), "etype", "n") for k, t in mesh.tags.items()]
    if not named:
        raise MeshError("the mesh has no tags")
    return reduce(DataFrame.unionByName, named)


def compare_tags(a: Tag, b: Tag) -> DataFrame:
    """(etype, id, a, b): entities whose values differ, or that only one of the tags has."""
    met = a.values.select(*ID, F.col("value").alias("a")).join(b.values.select(*ID, F.col("value").alias("b")), ID, "full")
    return met.filter(~F.col("a").eqNullSafe(F.col("b")))


def by_chunk(rows: DataFrame, size: int) -> DataFrame:
    """rows (etype, id) with chunk: numbers of runs of `size` entities in the order of (etype, id), for work in batches."""
    return numbered(rows, ID, "__n", 0).withColumn("chunk", F.floor(F.col("__n") / size)).drop("__n")


def tag_create(mesh: Mesh, name: str, kind: str, default: object = None) -> Mesh:
    """The mesh with an empty tag of a Spark type (long, double, string, array<double>, ...); an error if it has one of that name and another type."""
    if name in mesh.tags:
        if tag_type(mesh.tags[name]) != tag_type(Tag(mesh.vertex.sparkSession.createDataFrame([], f"etype int, id long, value {kind}"))):
            raise MeshError(f"tag {name!r} has another type")
        return mesh
    empty = mesh.vertex.sparkSession.createDataFrame([], f"etype int, id long, value {kind}")
    return replace(mesh, tags={**mesh.tags, name: Tag(empty, default)})


def tag_type(tag: Tag) -> str:
    return dict(tag.values.dtypes)["value"]


# Bytes of a value of each fixed-size type.
TYPE_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def tag_info(mesh: Mesh) -> DataFrame:
    """(tag, type, bytes, default, n): each tag's type, its size (null if values differ in it), default as text, and how many values there are."""
    spark = mesh.vertex.sparkSession
    rows = [(name, tag_type(t), TYPE_BYTES.get(tag_type(t)), None if t.default is None else str(t.default)) for name, t in sorted(mesh.tags.items())]
    info = spark.createDataFrame(rows, "tag string, type string, bytes int, default string")
    if not rows:
        return info.withColumn("n", F.lit(0).cast("long"))
    sizes = [t.values.agg(F.count("*").alias("n")).select(F.lit(name).alias("tag"), "n") for name, t in mesh.tags.items()]
    return info.join(reduce(DataFrame.unionByName, sizes), "tag")
