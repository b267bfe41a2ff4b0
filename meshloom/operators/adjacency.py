"""Adjacency as joins on connectivity: up and down, sides, skin, bridges and layers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import corners, explode_sides, forward, side_etype
from ..functions.rings import chained
from ..functions.vector import Vec
from ..model import ETYPES, Mesh, MeshError, dimension, elem_vertex
from ..storage import numbered, written
from .measure import with_points

ID = ["etype", "id"]


def vertex_elements(elem: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vid, etype, id): elements at each vertex, once each."""
    rows = elem_vertex(elem).select("vid", *ID)
    if vertices is not None:
        rows = rows.join(vertices.select(F.col("id").alias("vid")), "vid", "left_semi")
    return rows.distinct()


def elements_at(elem: DataFrame, vertices: DataFrame, mode: str = "UNION") -> DataFrame:
    """(etype, id) of elements with any (UNION) or all (INTERSECT) of the vertices (id); none if there are none."""
    met = vertex_elements(elem, vertices)
    if mode == "UNION":
        return met.select(*ID).distinct()
    if mode != "INTERSECT":
        raise MeshError("mode is INTERSECT or UNION")
    wanted = vertices.select("id").distinct().agg(F.count("*").alias("wanted"))
    found = met.groupBy(*ID).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(wanted), F.col("n") == F.col("wanted")).select(*ID)


def adjacent(mesh: Mesh, entities: DataFrame, dim: int, *, explicit: DataFrame | None = None) -> DataFrame:
    """(src_etype, src_id, etype, id): for each of the entities (etype, id) the existing ones of dimension dim that it touches.

    A vertex touches what holds it, an element its corner vertices, its sides that exist as entities, and the
    elements of which it is a side; of the same dimension each touches itself. dim 4 gives the sets that hold
    an entity. Pairs of explicit (src_etype, src_id, etype, id) count, too.
    """
    src = entities.select(*ID).distinct()
    named = [F.col("etype").alias("src_etype"), F.col("id").alias("src_id")]
    if dim == 4:
        rows = mesh.member.join(src, ID).select(*named, F.lit(ETYPES["ENTITYSET"]).alias("to"), F.col("set_id").alias("to_id"))
        return rows.select("src_etype", "src_id", F.col("to").alias("etype"), F.col("to_id").alias("id")).distinct()
    own_dim = dimension(F.col("etype"))
    same = src.filter(own_dim == dim).select(*named, *ID)
    elem = mesh.elem.withColumn("etype", F.col("etype").cast("int"))
    own = elem.join(src, ID, "left_semi")
    if dim == 0:
        out = elem_vertex(own.withColumn("conn", corners(F.col("etype"), F.col("conn")))).select(*named, F.lit(0).alias("to"), F.col("vid").alias("to_id"))
    else:
        target = elem.filter(own_dim == dim)
        at = elem_vertex(target.withColumn("conn", corners(F.col("etype"), F.col("conn")))).select("vid", F.col("etype").alias("to"), F.col("id").alias("to_id"))
        out = src.filter("etype = 0").join(at, src.id == at.vid).select(*named, "to", "to_id")
        key = F.array_sort(corners(F.col("etype"), F.col("conn"))).alias("key")
        if dim < 3:
            down = explode_sides(own.filter(own_dim > dim), dim).select(*named, "key")
            out = out.unionByName(down.join(target.select(F.col("etype").alias("to"), F.col("id").alias("to_id"), key), "key").drop("key"))
        for low in range(1, dim):
            up = own.filter(own_dim == low).select(*named, key)
            held = explode_sides(target, low).select("key", F.col("etype").alias("to"), F.col("id").alias("to_id"))
            out = out.unionByName(up.join(held, "key").drop("key"))
    out = out.select("src_etype", "src_id", F.col("to").alias("etype"), F.col("to_id").alias("id")).unionByName(same)
    if explicit is not None:
        out = out.unionByName(explicit.filter(own_dim == dim).join(src.select(*named), ["src_etype", "src_id"], "left_semi").select(out.columns))
    return out.distinct()


def add_explicit(explicit: DataFrame, new: DataFrame, both: bool = True) -> DataFrame:
    """Explicit adjacencies (src_etype, src_id, etype, id) with more pairs, in both directions or one; repeated ones once."""
    columns = ["src_etype", "src_id", "etype", "id"]
    new = new.select(*columns)
    if both:
        new = new.unionByName(new.select(F.col("etype").alias("src_etype"), F.col("id").alias("src_id"), F.col("src_etype").alias("etype"), F.col("src_id").alias("id")))
    return explicit.select(*columns).unionByName(new).distinct()


def remove_explicit(explicit: DataFrame, gone: DataFrame) -> DataFrame:
    """Explicit adjacencies without those of pairs (src_etype, src_id, etype, id), whichever way round."""
    turned = gone.select(F.col("etype").alias("src_etype"), F.col("id").alias("src_id"), F.col("src_etype").alias("etype"), F.col("src_id").alias("id"))
    return explicit.join(gone.select(turned.columns).unionByName(turned), ["src_etype", "src_id", "etype", "id"], "left_anti")


def adjacencies(mesh: Mesh, entities: DataFrame, dim: int, mode: str = "INTERSECT", *, explicit: DataFrame | None = None) -> DataFrame:
    """(etype, id) of dimension dim adjacent to all (INTERSECT) or any (UNION) of the entities; none if there are none."""
    met = adjacent(mesh, entities, dim, explicit=explicit)
    if mode == "UNION":
        return met.select(*ID).distinct()
    if mode != "INTERSECT":
        raise MeshError("mode is INTERSECT or UNION")
    wanted = entities.select(*ID).distinct().agg(F.count("*").alias("wanted"))  # one row
    found = met.groupBy(*ID).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(wanted), F.col("n") == F.col("wanted")).select(*ID)


def construct(mesh: Mesh, dim: int) -> Mesh:
    """The mesh with an element for each edge (1) or face (2) of higher elements that isn't one yet.

    New ids follow the greatest id of the type, in the order of the sorted vertices.
    """
    have = mesh.elem.select(F.array_sort(corners(F.col("etype"), F.col("conn"))).alias("key"))
    new = side_entities(mesh.elem.filter(dimension(F.col("etype")) > dim), dim).join(have, "key", "left_anti")
    top = mesh.elem.groupBy("etype").agg(F.max("id").alias("top"))
    placed = numbered(new.select("etype", "key", "conn"), ["key"], "n", 1, ["etype"]).join(F.broadcast(top), "etype", "left")  # a row a type
    rows = placed.select("etype", (F.coalesce("top", F.lit(0)) + F.col("n")).alias("id"), "conn")
    return replace(mesh, elem=mesh.elem.unionByName(rows))


def siblings(elem: DataFrame, dim: int) -> DataFrame:
    """(etype, id, side, other_etype, other_id, other_side): each side and the next element's side on the same vertices, in a ring.

    A side that no other element has is left out; of more than two on the same vertices, each leads to the
    next by (etype, id, side) and the last to the first, so a non-manifold side gives no pairs of all with all.
    """
    rows = explode_sides(elem, dim).select("key", F.struct("etype", "id", "side").alias("at"))
    by = Window.partitionBy("key")
    ring = rows.withColumn("next", F.lead("at").over(by.orderBy("at"))).withColumn("first", F.min("at").over(by)).withColumn("n", F.count("*").over(by))
    other = F.coalesce("next", "first")
    return ring.filter("n > 1").select("at.etype", "at.id", "at.side", other["etype"].alias("other_etype"), other["id"].alias("other_id"), other["side"].alias("other_side"))


def common(mesh: Mesh, pairs: DataFrame, dim: int) -> DataFrame:
    """(a_etype, a_id, b_etype, b_id, etype, id): the least entity of dimension dim that both of a pair touch, null if none."""
    ends = [pairs.select(F.col(f"{s}_etype").alias("etype"), F.col(f"{s}_id").alias("id")) for s in "ab"]
    met = adjacent(mesh, ends[0].unionByName(ends[1]), dim)
    a, b = (met.select(F.col("src_etype").alias(f"{s}_etype"), F.col("src_id").alias(f"{s}_id"), *ID) for s in "ab")
    both = pairs.join(a, ["a_etype", "a_id"]).join(b, ["b_etype", "b_id", *ID])
    least = both.groupBy("a_etype", "a_id", "b_etype", "b_id").agg(F.min(F.struct(*ID)).alias("m"))
    return pairs.join(least, ["a_etype", "a_id", "b_etype", "b_id"], "left").select("a_etype", "a_id", "b_etype", "b_id", "m.etype", "m.id")


def stars(elem: DataFrame) -> DataFrame:
    """(vid, pos, etype, id, closed, fans): faces around each vertex in the order in which they share edges at it.

    A fan is a run of faces each of which shares an edge at the vertex with the next; fans > 1 means that the
    vertex is not manifold, and the fans follow one another from the least face on. closed tells that the only
    fan is a ring. One vertex's faces are one group, as large as its valence.
    """
    corner = corners(F.col("etype"), F.col("conn"))
    faces = elem.filter(dimension(F.col("etype")) == 2).select("etype", "id", corner.alias("c"), F.posexplode(corner).alias("p", "vid"))
    n = F.size("c")
    end = lambda step: F.get("c", (F.col("p") + step) % n)
    around = faces.select("vid", F.struct("etype", "id", end(n - 1).alias("a"), end(1).alias("b")).alias("f"))
    grouped = around.groupBy("vid").agg(F.array_sort(F.collect_list("f")).alias("f"))
    ordered = grouped.select("vid", "f", chained(F.col("f")).alias("o"))
    placed = ordered.select("vid", "f", "o.fans", "o.closed", F.posexplode("o.order").alias("pos", "i")).withColumn("f", F.get("f", F.col("i")))
    return placed.select("vid", F.col("pos").cast("long").alias("pos"), "f.etype", "f.id", "closed", F.col("fans").cast("long").alias("fans"))


def nonmanifold_vertices(elem: DataFrame) -> DataFrame:
    """(id): vertices whose faces make more than one fan."""
    return stars(elem).filter("fans > 1").select(F.col("vid").alias("id")).distinct()


def sharp_edges(mesh: Mesh, angle: float) -> DataFrame:
    """(key, angle): edges between two faces whose normals differ by more than `angle` radians.

    Normals follow the order of each face's vertices, turned where both faces run along the edge the same way.
    """
    faces = with_points(replace(mesh, elem=mesh.elem.filter(dimension(F.col("etype")) == 2)))
    at = lambda i: Vec.of(F.get("p", F.lit(i)))
    normal = faces.select(*ID, (at(1) - at(0)).cross(at(2) - at(0)).unit().struct().alias("normal"))
    rows = explode_sides(mesh.elem.filter(dimension(F.col("etype")) == 2), 1).select("key", *ID, (F.get("conn", F.lit(0)) < F.get("conn", F.lit(1))).alias("sense")).join(normal, ID)
    pair = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*ID, "sense", "normal")).alias("a"), F.max(F.struct(*ID, "sense", "normal")).alias("b")).filter("n = 2")
    turn = F.when(F.col("a.sense") == F.col("b.sense"), -1.0).otherwise(1.0)
    cosine = Vec.of(F.col("a.normal")).dot(Vec.of(F.col("b.normal"))) * turn
    return pair.select("key", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle")).filter(F.col("angle") > angle)


def side_entities(elem: DataFrame, dim: int) -> DataFrame:
    """(key, etype, conn, n_up): every edge or face once, with the connectivity of its first use and how often it is used."""
    rows = explode_sides(elem, dim)
    if dim == 1:  # two numbers are the key, and which way an edge runs is one more
        at = F.struct("etype", "id", "side", (F.get("conn", F.lit(0)) == F.get("key", F.lit(0))).alias("up"))
        ends = rows.select(F.get("key", F.lit(0)).alias("a"), F.get("key", F.lit(1)).alias("b"), at.alias("at")).groupBy("a", "b").agg(F.min("at").alias("at"), F.count("*").alias("n_up"))
        conn = F.when(F.col("at.up"), F.array("a", "b")).otherwise(F.array("b", "a"))
        return ends.select(F.array("a", "b").alias("key"), conn.alias("conn"), "n_up", F.lit(ETYPES["EDGE"]).alias("etype"))
    first = F.min_by("conn", F.struct("etype", "id", "side"))
    return rows.groupBy("key").agg(first.alias("conn"), F.count("*").alias("n_up")).withColumn("etype", side_etype(F.col("conn")))


def skin(elem: DataFrame, dim: int) -> DataFrame:
    """(etype, id, side, conn, key): sides of dimension dim that just one element has."""
    rows = explode_sides(elem, dim)
    # of a group of one row every least value is that row's; numbers are summed up by hash, without a sort
    least = [F.min(c).alias(c) for c in ("etype", "id", "side")]
    if dim == 1:
        ends = rows.select("etype", "id", "side", F.get("key", F.lit(0)).alias("a"), F.get("key", F.lit(1)).alias("b"), (F.get("conn", F.lit(0)) == F.get("key", F.lit(0))).cast("int").alias("up"))
        once = ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("up").alias("up"), *least).filter("n = 1")
        return once.select("etype", "id", "side", F.when(F.col("up") == 1, F.array("a", "b")).otherwise(F.array("b", "a")).alias("conn"), F.array("a", "b").alias("key"))
    once = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("conn").alias("conn"), *least)
    return once.filter("n = 1").select("etype", "id", "side", "conn", "key")


def skin_vertices(elem: DataFrame, dim: int) -> DataFrame:
    return skin(elem, dim).select(F.explode("conn").alias("id")).distinct()


def manifold(elem: DataFrame, dim: int) -> DataFrame:
    """Sides that at most one element uses, as keys."""
    return side_entities(elem, dim).filter("n_up <= 1").select("key")


def neighbours(elem: DataFrame, dim: int) -> DataFrame:
    """(etype, id, other_etype, other_id, same_sense): pairs of elements with a common side, both ways round."""
    rows = explode_sides(elem, dim).select("key", *ID, forward(F.col("conn")).alias("sense"))
    other = rows.select("key", F.col("etype").alias("other_etype"), F.col("id").alias("other_id"), F.col("sense").alias("other_sense"))
    met = rows.join(other, "key").filter((F.col("etype") != F.col("other_etype")) | (F.col("id") != F.col("other_id")))
    return met.groupBy(*ID, "other_etype", "other_id").agg(F.min(F.col("sense") == F.col("other_sense")).alias("same_sense"))


def bridge(elem: DataFrame, start: DataFrame, bridge_dim: int = 0, layers: int = 1) -> DataFrame:
    """(etype, id, layer): elements reached from start over common vertices (0), edges (1) or faces (2).

    start is layer 0. Each step joins only the last layer; what was reached before is taken away.
    """
    if bridge_dim == 0:
        ends = elem_vertex(elem).select(*ID, F.array("vid").alias("key")).distinct()
    else:
        ends = explode_sides(elem, bridge_dim).select(*ID, "key").distinct()
    reached = last = start.select(*ID).distinct().withColumn("layer", F.lit(0))
    if layers > 1:
        ends, reached = written(ends, "ends"), written(reached, "reached")
    for layer in range(1, layers + 1):
        keys = ends.join(last, ID, "left_semi").select("key").distinct()
        last = ends.join(keys, "key", "left_semi").select(*ID).distinct().join(reached, ID, "left_anti").withColumn("layer", F.lit(layer))
        if layers > 1:  # a layer is computed once, however many follow
            last = written(last, "layer")
        reached = reached.unionByName(last)
        if layers > 1 and last.isEmpty():
            break
    return reached


def depth(elem: DataFrame, dim: int, most: int) -> DataFrame:
    """(etype, id, layer): layer 1 has the elements at the skin, and so on inwards, up to `most` layers."""
    vertices = skin_vertices(elem, dim)
    first = elements_at(elem, vertices)
    return bridge(elem, first, 0, most - 1).withColumn("layer", F.col("layer") + 1)


def audit(mesh: Mesh) -> DataFrame:
    """(etype, id, vid): uses of vertices that aren't there."""
    return elem_vertex(mesh.elem).join(mesh.vertex.select(F.col("id").alias("vid")), "vid", "left_anti").select(*ID, "vid")
