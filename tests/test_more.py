"""Formats, ids, refinement, location and the sphere on small meshes."""

import math

import pytest
from pyspark.sql import functions as F

from meshloom.functions import numbering, sphere
from meshloom.model import ETYPES, Mesh, MeshError, Tag
from meshloom.operators import adjacency, couple, entities, refine, remap, spatial
from meshloom.plans.views import brick
from meshloom.sources import cards, gmsh, layout, obj, vtk

POINTS = "pid long, x double, y double, z double"


def test_ids_with_more_columns(spark):
    rows = spark.range(300_000).select(F.lit(4).alias("etype"), (F.col("id") * 7919 % 300_007).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = entities.assign_ids(rows)
    assert got.columns == ["etype", "id", "more", "gid"]
    low, high, n, many = got.agg(F.min("gid"), F.max("gid"), F.count_distinct("gid"), F.count("*")).first()
    assert (low, high, n, many) == (1, 300_000, 300_000, 300_000)


def test_nearest_within_the_last_radius(spark):
    vertex = spark.createDataFrame([(1, 300.0, 0.0, 0.0)], "id long, x double, y double, z double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, -300.0, 0.0, 0.0)], POINTS)
    assert {r.pid: r.id for r in spatial.nearest(points, vertex, 2.0, 500.0).collect()} == {1: 1, 2: None}


def test_location_and_linear_fields(spark):
    mesh = brick(spark, 2)
    points = spark.createDataFrame([(1, 0.25, 1.5, 1.75), (2, 3.0, 0.0, 0.0)], POINTS)
    found = couple.locate(points, mesh, 1.0)
    nodal = mesh.vertex.select(F.col("id").alias("vid"), (F.col("x") + 2 * F.col("y")).alias("value"))
    assert {r.pid: r.value for r in couple.interpolate(found, mesh.elem, nodal).collect()} == {1: pytest.approx(3.25), 2: None}


def test_bulk_data(spark, tmp_path):
    text = "$ a comment\nGRID    1               0.0     0.0     0.0\nGRID    2               1.0     0.0     0.0\nGRID,3,,1.,1.,0.\nGRID    4               1.5-1   1.0+0   0.0\nCTRIA3  7       2       1       2       3\nCQUAD4,8,2,1,2,3,4\nENDDATA\n"
    (tmp_path / "a.nas").write_text(text)
    mesh = cards.nastran(spark, str(tmp_path / "a.nas"))
    assert {r.id: (r.x, r.y) for r in mesh.vertex.collect()} == {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0.15, 1)}
    assert {(r.etype, r.id): r.conn for r in mesh.elem.collect()} == {(2, 7): [1, 2, 3], (3, 8): [1, 2, 3, 4]}
    (tmp_path / "a.inp").write_text("*HEADING\n** note\n*NODE\n1, 0., 0., 0.\n2, 1., 0., 0.\n3, 0., 1., 0.\n*ELEMENT, TYPE=S3, ELSET=SHELL\n5, 1, 2, 3\n")
    mesh = cards.abaqus(spark, str(tmp_path / "a.inp"))
    assert mesh.vertex.count() == 3 and [(r.etype, r.id, r.conn) for r in mesh.elem.collect()] == [(2, 5, [1, 2, 3])]
    (tmp_path / "a.node").write_text("# nodes\n4 3 0 0\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n")
    (tmp_path / "a.ele").write_text("1 4 0\n1 1 2 3 4\n")
    mesh = cards.node_list(spark, str(tmp_path / "a.node"), str(tmp_path / "a.ele"))
    assert mesh.vertex.count() == 4 and mesh.elem.first().conn == [1, 2, 3, 4]


def test_grid_file_with_data(spark, tmp_path):
    text = "# vtk DataFile Version 3.0\nt\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 4 float\n0 0 0 1 0 0 1 1\n0 0 1 0\nCELLS 2 8\n3 0 1 2\n3 0 2 3\nCELL_TYPES 2\n5 5\nCELL_DATA 2\nSCALARS part int 1\nLOOKUP_TABLE default\n3\n4\n"
    (tmp_path / "a.vtk").write_text(text)
    mesh = vtk.read(spark, str(tmp_path / "a.vtk"))
    assert {r.id: (r.x, r.y) for r in mesh.vertex.collect()} == {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0, 1)}
    assert {r.id: r.conn for r in mesh.elem.collect()} == {1: [1, 2, 3], 2: [1, 3, 4]}
    assert {r.id: r.value for r in mesh.tag("part").values.collect()} == {1: 3, 2: 4}


def test_negative_face_corners(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\nv 5 5 5\nf 1 2 -1\n")
    assert {r.id: r.conn for r in obj.read(spark, str(tmp_path / "a.obj")).elem.collect()} == {1: [1, 2, 3], 2: [1, 2, 4]}


def test_physical_groups(spark, tmp_path):
    (tmp_path / "a.msh").write_text("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n2\n1 15 2 9 9 1\n2 2 2 6 1 1 2 3\n$EndElements\n")
    mesh = gmsh.read(spark, str(tmp_path / "a.msh"))
    assert [(r.etype, r.id, r.conn) for r in mesh.elem.collect()] == [(2, 2, [1, 2, 3])]
    assert mesh.tag("MATERIAL_SET").values.first().value == 6


def test_partial_read_modes(spark, tmp_path):
    mesh = adjacency.construct(brick(spark, 2), 2)
    cells = mesh.elem.filter("etype = 9 and id <= 2")
    member = cells.select(F.lit(5).cast("long").alias("set_id"), F.col("id").alias("pos"), "etype", "id")
    tag = Tag(spark.createDataFrame([(11, 5, 1), (11, 6, 2)], "etype int, id long, value int"))
    layout.write(Mesh(mesh.vertex, mesh.elem, {"M": tag}, member, spark.createDataFrame([(6, 5)], "parent_id long, child_id long")), str(tmp_path / "m"))
    count = lambda **k: [(r["count"]) for r in layout.read_sets(spark, str(tmp_path / "m"), {"M": k.pop("m", [1])}, **k).elem.groupBy("etype").count().orderBy("etype").collect()]
    assert count() == [2] and count(elements="SIDES") == [11, 2] and count(elements="NODES") == [11, 2]
    assert count(m=[2]) == [] and count(m=[2], children=True) == [2]


def test_numbering_tables():
    assert numbering.adjacent_sides("HEX", 0, [0], 2) == [0, 3, 4] and numbering.adjacent_sides("HEX", 2, [0, 4], 1) == [0]
    for name, dims in (("TRI", 2), ("QUAD", 2), ("TET", 3), ("HEX", 3)):
        for d in range(dims):
            own = numbering.positions_of(name, d)
            for side in range(len(own)):
                to, other = numbering.opposite_side(name, d, side)
                assert not set(own[side]) & set(numbering.positions_of(name, to)[other])
                assert numbering.opposite_side(name, to, other) == (d, side)
    assert numbering.has_mid_nodes("HEX", 27) == (True, True, True) and numbering.has_mid_nodes("TET", 10) == (True, False, False)
    assert all(numbering.mid_node_parent("HEX", 27, numbering.mid_node_index("HEX", 27, d, s)) == (d, s) for d, s in ((1, 11), (2, 5), (3, 0)))
    with pytest.raises(MeshError):
        numbering.opposite_side("PRISM", 2, 0)


def test_refined_tetrahedron_and_triangle(spark):
    vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0)], "id long, x double, y double, z double")
    elem = spark.createDataFrame([(ETYPES["TET"], 1, [1, 2, 3, 4]), (ETYPES["TRI"], 1, [1, 2, 3])], "etype int, id long, conn array<bigint>")
    fine, lineage = refine.refine(Mesh(vertex, elem), 3)
    counts = {r.etype: r["count"] for r in fine.elem.groupBy("etype").count().collect()}
    assert counts == {ETYPES["TET"]: 27, ETYPES["TRI"]: 9} and fine.vertex.count() == 20 and lineage.count() == 36
    from meshloom.operators.measure import measure, with_points

    sizes = with_points(fine).groupBy("etype").agg(F.sum(measure(F.col("etype"), F.col("p"))).alias("s"), F.min(measure(F.col("etype"), F.col("p"))).alias("m")).collect()
    assert {r.etype: round(r.s, 9) for r in sizes} == {5: round(1 / 6, 9), 2: 0.5} and all(r.m > 0 for r in sizes)


def test_smoothing_restores_the_middle(spark):
    mesh = brick(spark, 2)
    bent = Mesh(mesh.vertex.withColumn("x", F.when(F.col("id") == 14, 1.4).otherwise(F.col("x"))), mesh.elem)
    out, rounds = refine.smooth(bent, 12, tolerance=1e-6)
    assert abs(out.vertex.filter("id = 14").first().x - 1) < 1e-4 and rounds > 1


def test_polygon_areas_by_three_rules(spark):
    at = lambda lon, lat: (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    poly = [at(0.1, 0.1), at(0.3, 0.1), at(0.3, 0.25), at(0.1, 0.25)]
    rows = spark.createDataFrame([(poly,)], "p array<struct<x:double,y:double,z:double>>")
    got = rows.select(*[sphere.area(F.col("p"), 1.0, r).alias(r) for r in ("lhuilier", "girard", "quadrature")]).first()
    assert abs(got.lhuilier - got.girard) < 1e-12 and abs(got.lhuilier - got.quadrature) < 1e-8


def test_sphere_grids_cover_the_sphere(spark):
    for grid, n in ((remap.lat_lon(spark, 8, 5), 40), (remap.cubed_sphere(spark, 3), 54), (remap.icosahedral(spark, 2), 80)):
        row = remap.total_area(grid).first()
        assert row.n == n and abs(row.area - 4 * math.pi) < 1e-9
