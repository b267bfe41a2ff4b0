import pytest
from pyspark.sql import functions as F

from meshloom.model import ETYPES, Mesh, MeshError, Tag
from meshloom.operators import adjacency, entities, measure, parts, sets, spatial
from meshloom.plans.views import brick, squares
from meshloom.sources import layout, obj


def test_brick_counts_and_skin(spark):
    mesh = brick(spark, 3)
    assert {r.etype: r.n for r in entities.counts(mesh).collect()} == {0: 64, 9: 27}
    assert adjacency.skin(mesh.elem, 2).count() == 54
    assert adjacency.side_entities(mesh.elem, 1).count() == 144
    assert adjacency.audit(mesh).count() == 0


def test_tag_default(spark):
    mesh = brick(spark, 2)
    values = spark.createDataFrame([(9, 1, 5), (9, 2, 7)], "etype int, id long, value int")
    mesh = Mesh(mesh.vertex, mesh.elem, {"M": Tag(values, 7), "N": Tag(values)})
    assert entities.by_type_and_tag(mesh, "HEX", {"M": 7}).count() == 7
    assert entities.by_type_and_tag(mesh, "HEX", {"N": entities.ANY}).count() == 2
    assert entities.by_type_and_tag(mesh, "HEX", {"M": 5, "N": 7}, "UNION").count() == 2
    with pytest.raises(MeshError):
        entities.by_type_and_tag(mesh, "HEX", {"X": 1})


def test_hops_survive_a_cycle(spark):
    link = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent_id long, child_id long")
    start = spark.createDataFrame([(1,)], "set_id long")
    assert sorted(map(tuple, sets.hops(link, start).collect())) == [(2, 1), (3, 2), (4, 3)]
    assert sets.hops(link, start, 1).count() == 1


def test_runs_cross_the_edge_of_a_range(spark):
    ids = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4, 5, 9, 10, 12)], "etype int, id long")
    assert sorted((r.lo, r.hi) for r in sets.runs(ids, 4).collect()) == [(1, 5), (9, 10), (12, 12)]


def test_coincident_chain(spark):
    rows = [(1, 0.0), (2, 0.4), (3, 0.8), (4, 5.0), (5, 5.0)]
    vertex = spark.createDataFrame(rows, "id long, x double").withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    assert {r.id: r.keep for r in sets.merge_coincident(vertex, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_global_ids_are_consecutive(spark):
    rows = spark.range(100).select(F.lit(4).alias("etype"), (F.col("id") * 7 % 101).alias("id"))
    got = sorted((r.id, r.gid) for r in entities.assign_ids(rows).collect())
    assert [g for _, g in got] == list(range(1, 101))


def test_overlap_areas_sum_to_one_and_weights_to_rows(spark):
    over = measure.overlaps(squares(spark, 5), squares(spark, 3), 1 / 3)
    assert abs(over.agg(F.sum("area")).first()[0] - 1) < 1e-12
    sums = measure.weights(over).groupBy("row").agg(F.sum("w").alias("s")).collect()
    assert len(sums) == 9 and all(abs(r.s - 1) < 1e-12 for r in sums)


def test_nearest_and_ghosts(spark):
    mesh = brick(spark, 2)
    point = spark.createDataFrame([(1, 1.2, 0.9, 1.9)], "pid long, x double, y double, z double")
    assert spatial.nearest(point, mesh.vertex, 0.1, 10.0).first().id == 1 + 1 + 3 + 2 * 9
    part = mesh.elem.select("etype", "id", (F.col("id") > 4).cast("int").alias("value"))
    assert parts.shared(mesh.elem, part).count() == 9
    assert parts.ghosts(mesh.elem, part).count() == 8


def test_sources(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1/1 2/2 3/3\nf 1 2 4 3\n")
    mesh = obj.read(spark, str(tmp_path / "a.obj"))
    assert mesh.vertex.count() == 4
    layout.write(mesh, str(tmp_path / "m"))
    again = layout.read(spark, str(tmp_path / "m"))
    assert {(r.etype, r.id, tuple(r.conn)) for r in again.elem.collect()} == {(ETYPES["TRI"], 1, (1, 2, 3)), (ETYPES["QUAD"], 2, (1, 2, 4, 3))}


def test_triangles_in_cells_are_not_broadcast(spark):
    """Their size is unknown to Spark, and no driver holds them."""
    from pyspark.sql import functions as F

    from meshloom.operators import geometry

    corner = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z")) for x, y in ((0.0, 0.0), (50.0, 0.0), (0.0, 50.0))]
    triangles = spark.range(3).select(F.col("id").alias("tid"), *[c.alias(n) for c, n in zip(corner, "abc", strict=True)])
    points = spark.createDataFrame([(1, 1.0, 1.0, 0.5), (2, 60.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert "Broadcast" not in geometry.near_triangles(points, triangles, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert {r.pid: (r.tid, r.d2) for r in geometry.closest(points, triangles, 1.0, 16.0).collect()} == {1: (0, 0.25), 2: (0, 100.0)}


def test_places_with_many_points_are_compared_once(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from meshloom.operators import spatial

    rows = Counter()

    def written(df, label, real=spatial.written):
        out = real(df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(spatial, "written", written)
    at = lambda n, x: spark.range(n).select((F.col("id") + 1).alias("id"), (F.lit(x) + F.col("id") % 2).alias("x"), F.lit(0.0).alias("y"), F.lit(-0.0).alias("z"))
    points, vertex = at(40, 0.25).withColumnRenamed("id", "pid"), at(30, 0.0).withColumn("z", F.lit(0.0))
    got = spatial.within(points, vertex, 0.5)
    assert got.count() == 2 * 20 * 15 and got.filter("pid % 2 = id % 2 and d2 = 0.0625").count() == 600
    assert rows["near-places"] == 2
    got = spatial.nearest(points, vertex, 0.1, 4.0)
    assert rows["nearest"] == 2 and {(r.pid, r.id, r.d2) for r in got.collect()} == {(i, 1 if i % 2 else 2, 0.0625) for i in range(1, 41)}


def test_pieces_of_rays_outside_of_the_surface_meet_nothing(spark):
    """A ray as long as it likes has cells only where there are triangles."""
    from pyspark.sql import functions as F

    from meshloom.operators import spatial

    struct = lambda x, y, z: F.struct(*[F.lit(float(v)).alias(c) for v, c in zip((x, y, z), "xyz", strict=True)])
    triangles = spark.range(1).select(F.col("id").alias("tid"), struct(1, -9, -9).alias("a"), struct(1, 9, -9).alias("b"), struct(1, 0, 9).alias("c"))
    rays = spark.range(20).select(F.col("id").alias("rid"), struct(0, 0.1, 0.1).alias("o"), struct(1, 0, 0).alias("d"), F.lit(1e6).alias("length"))
    assert {(r.rid, r.t) for r in spatial.ray_hits(rays, triangles, 0.5).collect()} == {(i, 1.0) for i in range(20)}
    assert "BroadcastHashJoin" not in spatial.ray_hits(rays, triangles, 0.5)._jdf.queryExecution().executedPlan().toString()


def test_cells_of_meshes_meet_once_without_a_shuffle_of_pairs(spark):
    over = measure.overlaps(squares(spark, 5), squares(spark, 3), 1 / 20)
    assert over.count() == 49
    assert "Aggregate" not in over._jdf.queryExecution().executedPlan().toString()
