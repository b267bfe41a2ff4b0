"""Overlap meshes, cuts and adaptive refinement."""

import math

import pytest
from pyspark.sql import functions as F

from meshloom.functions.vector import Vec
from meshloom.model import ETYPES, Mesh, MeshError
from meshloom.operators import adapt, adjacency, measure, overlay, split
from meshloom.plans.views import brick


def mesh_of(spark, points, faces, etype="POLYGON"):
    vertex = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points, 1)], "id long, x double, y double, z double")
    return Mesh(vertex, spark.createDataFrame([(ETYPES[etype], i, list(f)) for i, f in enumerate(faces, 1)], "etype int, id long, conn array<long>"))


def counts(out):
    return {r.kind: r.n for r in overlay.edge_uses(out.mesh.elem).collect()}, out.mesh.vertex.count(), out.mesh.elem.count()


def test_overlay_of_cube_and_octahedron_on_the_sphere(spark):
    """Closed, without cracks: every edge used twice, the sphere covered once; corners of each lie inside faces of the other."""
    cube = [(x, y, z) for z in (-1, 1) for y in (-1, 1) for x in (-1, 1)]
    sides = [(1, 3, 4, 2), (5, 6, 8, 7), (1, 2, 6, 5), (3, 7, 8, 4), (1, 5, 7, 3), (2, 4, 8, 6)]
    tips = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    eighths = [(a, b, c) if (a == 1) == ((b == 3) == (c == 5)) else (a, c, b) for a in (1, 2) for b in (3, 4) for c in (5, 6)]
    out = overlay.overlay(mesh_of(spark, cube, sides), mesh_of(spark, tips, eighths), 1.0, spherical=True)
    uses, nodes, faces = counts(out)
    assert (faces, nodes, uses) == (24, 8 + 6 + 12, {"inner": 48})  # nodes - edges + faces = 2
    assert out.parents.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi)
    assert {r.kind: r.n for r in out.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {0: 8, 1: 6, 2: 12}


def test_overlay_shares_nodes_where_vertices_and_edges_coincide(spark):
    """A square and two triangles on the same corners, one with its tip on the middle of an edge and one that only touches."""
    square = mesh_of(spark, [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0)], [(1, 2, 3, 4)])
    tri = mesh_of(spark, [(0, 0, 0), (2, 0, 0), (1, 2, 0), (2, 2, 0), (3, 1, 0)], [(1, 2, 3), (2, 4, 3), (2, 5, 4)], "TRI")
    out = overlay.overlay(square, tri, 1.0)
    assert {(r.src, r.tgt, round(r.area, 9)) for r in out.parents.collect()} == {(1, 1, 2.0), (1, 2, 1.0)}
    assert {(r.kind, r.a) for r in out.nodes.collect()} == {(0, 1), (0, 2), (0, 3), (1, 3)}  # the target's corner 3 lies on an edge
    assert {r.id for r in overlay.covering(square, tri, 1.0).collect()} == {1}
    with pytest.raises(MeshError):
        overlay.overlay(square, tri, 0.0)
    nothing = Mesh(tri.vertex, tri.elem.limit(0))
    assert overlay.overlay(square, nothing, 1.0).mesh.elem.count() == 0


def test_overlay_against_clipping(spark):
    """Hexagons over turned squares: areas as the clipping of each pair gives them, and no crack."""
    turn = lambda x, y, a: (x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a), 0.0)
    n = 7
    grid = [turn(i * 0.31 - 1, j * 0.31 - 1, 0.37) for j in range(n + 1) for i in range(n + 1)]
    quads = [(1 + i + (n + 1) * j, 2 + i + (n + 1) * j, n + 3 + i + (n + 1) * j, n + 2 + i + (n + 1) * j) for j in range(n) for i in range(n)]
    ring = [(0.0, 0.0, 0.0), *[turn(0.9, 0, k * math.pi / 3) for k in range(6)]]
    source, target = mesh_of(spark, grid, quads, "QUAD"), mesh_of(spark, ring, [(1, 2 + k, 2 + (k + 1) % 6) for k in range(6)], "TRI")
    out = overlay.overlay(source, target, 0.4)
    flat = lambda m: measure.with_points(m).select("id", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("poly"))
    want = {(r.src, r.tgt): r.area for r in measure.overlaps(flat(source), flat(target), 0.4).collect()}
    got = {(r.src, r.tgt): r.area for r in out.parents.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(a) for k, a in want.items())
    uses, nodes, faces = counts(out)
    assert "torn" not in uses and nodes - uses["inner"] - uses["border"] + faces == 1


def test_split_leaves_rims_whole_and_parts_sheets(spark):
    """Four cubes around an edge: one cut square reaches the border at three sides; three squares part three groups."""
    mesh = brick(spark, 2)
    mesh = Mesh(mesh.vertex, mesh.elem.filter("id in (1, 2, 3, 4)"))
    key = lambda *v: (sorted(v),)
    faces = [key(2, 5, 11, 14), key(5, 8, 14, 17), key(4, 5, 13, 14)]
    one, lineage = split.split(mesh, spark.createDataFrame(faces[:1], "key array<long>"), 3)
    assert sorted(r.old for r in lineage.collect()) == [2, 11] and one.vertex.count() == 29
    assert [sorted(r.conn) for r in one.elem.filter("id = 1").collect()] == [[1, 2, 4, 5, 10, 11, 13, 14]]
    three, lineage = split.split(mesh, spark.createDataFrame(faces, "key array<long>"), 3)
    assert sorted(r.old for r in lineage.collect()) == [2, 4, 5, 5, 8, 11, 13, 14, 14, 17]
    assert split.faces_of_cut(mesh, three, lineage, 3).groupBy("key").count().filter("count = 2").count() == 3
    assert adjacency.skin(three.elem, 2).count() == adjacency.skin(mesh.elem, 2).count() + 6
    with pytest.raises(MeshError):
        split.split(mesh, spark.createDataFrame(faces, "key array<long>"), 1)


def test_split_non_manifold_edge(spark):
    """Three triangles on one edge: cut there, each gets its own ends; uncut, the edge holds them together."""
    fan = mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 1), (0, -1, -1)], [(1, 2, 3), (1, 2, 4), (1, 2, 5)], "TRI")
    opened, lineage = split.split(fan, spark.createDataFrame([([1, 2],)], "key array<long>"), 2)
    assert sorted(r.old for r in lineage.collect()) == [1, 1, 2, 2] and opened.vertex.count() == 9
    assert split.split(fan, spark.createDataFrame([([1, 3],)], "key array<long>"), 2)[1].count() == 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_adaptive_tetrahedra_conform(spark, rounds):
    mesh = adapt.tetrahedra(brick(spark, 2))
    out, lineage, done = adapt.refine_to(mesh, lambda x, y, z: 0.25 + Vec(x, y, z).norm(), rounds)
    assert 1 <= done <= rounds and out.elem.count() > 60
    size = measure.with_points(out).select(measure.measure(F.col("etype"), F.col("p")).alias("v"))
    assert size.agg(F.sum("v")).first()[0] == pytest.approx(8) and size.agg(F.min("v")).first()[0] > 0
    skin = adjacency.skin(out.elem, 2).select(F.lit(ETYPES["TRI"]).alias("etype"), F.monotonically_increasing_id().alias("id"), "conn")
    assert measure.with_points(Mesh(out.vertex, skin)).agg(F.sum(measure.measure(F.col("etype"), F.col("p")))).first()[0] == pytest.approx(24)
    assert adapt.torn(out).count() == 0 and out.vertex.select("x", "y", "z").distinct().count() == out.vertex.count()
    assert lineage.select("parent_id").distinct().count() == 48 and lineage.count() == out.elem.count() and out.elem.select("etype", "id").distinct().count() == out.elem.count()


def test_adaptive_triangles_to_a_size(spark):
    mesh = mesh_of(spark, [(0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)], [(1, 2, 3), (1, 3, 4)], "TRI")
    out, _, _ = adapt.refine_to(mesh, lambda x, y, z: F.lit(1.0))
    assert adapt.edges(out).agg(F.max("length")).first()[0] <= 1.0
    assert measure.with_points(out).agg(F.sum(measure.measure(F.col("etype"), F.col("p")))).first()[0] == pytest.approx(12)
    with pytest.raises(MeshError):
        adapt.bisect(brick(spark, 2), spark.createDataFrame([([1, 2],)], "key array<long>"))


def test_written_tables_are_deleted(spark):
    from meshloom import storage

    table = storage.written(spark.range(3), "gone")
    path = storage._written[-1].removeprefix("file://")
    assert table.count() == 3 and storage.delete_written(spark) >= 1 and storage.delete_written(spark) == 0
    import os

    assert not os.path.exists(path)


def test_overlay_far_from_the_origin(spark):
    """Leaning lattices whose lines coincide in places, where products of whole coordinates have fewer digits than the tolerance."""

    def lattice(lines):
        points = [(u + 0.3 * v, v + 0.2 * u, 0) for v in lines for u in lines]
        m = len(lines)
        return mesh_of(spark, points, [(1 + i + m * j, 2 + i + m * j, m + 2 + i + m * j, m + 1 + i + m * j) for j in range(m - 1) for i in range(m - 1)], "QUAD")

    a, b = [2001 + x for x in (0, 1, 3, 6, 7, 9, 10, 13)], [2001 + x for x in (0, 2, 3, 5, 7, 10, 11, 13)]
    out = overlay.overlay(lattice(a), lattice(b), 5.0)
    k = len({*a, *b}) - 1
    assert counts(out) == ({"inner": 2 * k * (k - 1), "border": 4 * k}, (k + 1) ** 2, k * k)
    assert out.parents.agg(F.sum("area")).first()[0] == pytest.approx(13 * 13 * 0.94, abs=1e-9)
