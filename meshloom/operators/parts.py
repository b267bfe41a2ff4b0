"""Partitions of a mesh as a tag: sharing, owners, interfaces, ghosts and tag exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import explode_sides
from ..model import elem_vertex
from .adjacency import neighbours

ID = ["etype", "id"]


def vertex_parts(elem: DataFrame, part: DataFrame) -> DataFrame:
    """(vid, part): parts (etype, id, value) of the elements at each vertex."""
    return elem_vertex(elem).select("vid", *ID).join(part, ID).select("vid", F.col("value").alias("part")).distinct()


def shared(elem: DataFrame, part: DataFrame) -> DataFrame:
    """(vid, owner, n_parts): vertices in more than one part; the least part owns."""
    return vertex_parts(elem, part).groupBy("vid").agg(F.min("part").alias("owner"), F.count("*").alias("n_parts")).filter("n_parts > 1")


def interfaces(elem: DataFrame, part: DataFrame) -> DataFrame:
    """(parts, n): how many vertices each group of parts shares."""
    groups = vertex_parts(elem, part).groupBy("vid").agg(F.array_sort(F.collect_set("part")).alias("parts")).filter(F.size("parts") > 1)
    return groups.groupBy("parts").agg(F.count("*").alias("n"))


def ghosts(elem: DataFrame, part: DataFrame, layers: int = 1, bridge_dim: int = 0) -> DataFrame:
    """(part, etype, id, layer): elements of other parts within so many layers of the part, over common vertices (0), edges (1) or faces (2).

    Only vertices or sides of more than one part are joined for the first layer; the next ones go on from it.
    """
    ends = elem_vertex(elem).select("etype", "id", F.array("vid").alias("key")) if bridge_dim == 0 else explode_sides(elem, bridge_dim).select("etype", "id", "key")
    own = part.select(*ID, F.col("value").alias("own"))
    at = ends.distinct().join(own, ID)
    between = at.groupBy("key").agg(F.collect_set("own").alias("parts")).filter(F.size("parts") > 1)
    met = at.join(between, "key").select(F.explode("parts").alias("part"), *ID, "own").filter("part <> own").drop("own").distinct()
    reached = met.withColumn("layer", F.lit(1))
    last = reached
    for layer in range(2, layers + 1):
        keys = at.join(last.select("part", *ID), ID).select("part", "key").distinct()
        last = at.join(keys, "key").filter("part <> own").select("part", *ID).distinct().join(reached, ["part", *ID], "left_anti").withColumn("layer", F.lit(layer))
        reached = reached.unionByName(last)
    return reached


# Bits of an entity's status in a part.
NOT_OWNED, SHARED, MULTISHARED, INTERFACE, GHOST = 1, 2, 4, 8, 16


def status(elem: DataFrame, part: DataFrame, ghost: DataFrame) -> DataFrame:
    """(part, etype, id, status) of the vertices (type 0) and elements that each part has, ghosts included.

    A vertex of several parts is shared, multishared from three on, at the interface, and owned by the least
    part; an element with ghosts is shared, and multishared where it is a ghost of several parts.
    """
    at = vertex_parts(elem, part)
    many = at.groupBy("vid").agg(F.count("*").alias("n"), F.min("part").alias("owner"))
    bit = lambda test, value: F.when(test, value).otherwise(0)
    shares = bit(F.col("n") > 1, SHARED) + bit(F.col("n") > 2, MULTISHARED)
    vertices = at.join(many, "vid").select("part", F.lit(0).alias("etype"), F.col("vid").alias("id"), (shares + bit(F.col("n") > 1, INTERFACE) + bit(F.col("part") != F.col("owner"), NOT_OWNED)).alias("status"))
    copies = ghost.groupBy(*ID).agg((F.count_distinct("part") + 1).alias("n"))
    own = part.join(copies, ID, "left").withColumn("n", F.coalesce("n", F.lit(1))).select(F.col("value").alias("part"), *ID, shares.alias("status"))
    held = ghost.select("part", *ID).distinct().join(copies, ID).select("part", *ID, (shares + GHOST + NOT_OWNED).alias("status"))
    return vertices.unionByName(own).unionByName(held)


def with_status(rows: DataFrame, bits: int, how: str = "AND") -> DataFrame:
    """Rows whose status has all (AND), any (OR) or none (NOT) of the bits."""
    met = F.col("status").bitwiseAND(F.lit(bits))
    return rows.filter({"AND": met == bits, "OR": met != 0, "NOT": met == 0}[how])


def shared_sets(member: DataFrame, part: DataFrame) -> DataFrame:
    """(set_id, owner, n_parts): sets with entities of more than one part; the least part owns."""
    met = member.join(part, ID).groupBy("set_id").agg(F.min("value").alias("owner"), F.count_distinct("value").alias("n_parts"))
    return met.filter("n_parts > 1")


def augmented(member: DataFrame, ghost: DataFrame) -> DataFrame:
    """(part, set_id, etype, id): the places of ghosts in the sets of their owners, for the parts that hold them."""
    return ghost.select("part", *ID).distinct().join(member.select("set_id", *ID), ID).select("part", "set_id", *ID)


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sender, receiver, n): how many entities each part sends to each other one, from parts (etype, id, value) before and after."""
    met = old.select(*ID, F.col("value").alias("sender")).join(new.select(*ID, F.col("value").alias("receiver")), ID)
    return met.groupBy("sender", "receiver").agg(F.count("*").alias("n"))


def side_graph(elem: DataFrame, dim: int) -> DataFrame:
    """(a, b): elements (etype, id) that share a side of dimension dim, both ways round: the graph that partitioners take."""
    met = neighbours(elem, dim)
    return met.select(F.struct(*ID).alias("a"), F.struct(F.col("other_etype").alias("etype"), F.col("other_id").alias("id")).alias("b"))


def reduce_tags(copies: DataFrame, how: str = "sum") -> DataFrame:
    """copies (id, part, value) with the value of all copies of an entity put together by sum, min or max."""
    total = copies.groupBy("id").agg({"sum": F.sum, "min": F.min, "max": F.max}[how]("value").alias("value"))
    return copies.drop("value").join(total, "id")


def exchange_tags(copies: DataFrame) -> DataFrame:
    """copies (id, part, value) with each entity's value at its owner, the least part."""
    own = copies.groupBy("id").agg(F.min_by("value", "part").alias("value"))
    return copies.drop("value").join(own, "id")
