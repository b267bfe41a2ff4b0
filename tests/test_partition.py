"""Curves, partitions, structured boxes, rings, sheets and dual cells."""

import itertools

import pytest
from pyspark.sql import functions as F

from meshloom.functions.rings import chained
from meshloom.model import MeshError
from meshloom.operators import adjacency, dual, partition
from meshloom.plans.views import brick


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (3, 1)])
def test_hilbert_visits_every_cell_by_single_steps(spark, n, bits):
    side = 1 << bits
    rows = spark.range(side**n).select(*[(F.floor(F.col("id") / side**d) % side).alias(f"x{d}") for d in range(n)])
    got = rows.select(*rows.columns, partition.hilbert([F.col(c) for c in rows.columns], bits).alias("key")).orderBy("key").collect()
    assert [r.key for r in got] == list(range(side**n))
    assert all(sum(abs(x - y) for x, y in zip(a[:n], b[:n], strict=True)) == 1 for a, b in itertools.pairwise(got))
    with pytest.raises(MeshError):
        partition.hilbert([F.lit(1)], 3)


def test_structured_boxes_against_brute_force(spark):
    """Every method and every number of parts: pieces fill the box once, owners and neighbours agree with them."""
    low, high = (1, -2, 0), (13, 14, 6)
    cells = [(i, j, k) for k in range(low[2], high[2]) for j in range(low[1], high[1]) for i in range(low[0], high[0])]
    frame = spark.createDataFrame(cells, "i long, j long, k long")
    checked = 0
    for method in partition.METHODS:
        for parts in (1, 2, 3, 4, 6, 7, 8, 12, 16, 24, 36, 64):
            try:
                grid = partition.structured(method, low, high, parts, (True, False, False))
            except MeshError:
                continue
            assert grid.parts[0] * grid.parts[1] * grid.parts[2] == parts
            if parts not in (1, 6, 12, 36):
                continue
            boxes = {r.part: ((r.i0, r.j0, r.k0), (r.i1, r.j1, r.k1)) for r in grid.box(spark).collect()}
            sizes = [[b - a for a, b in zip(*box, strict=True)] for box in boxes.values()]
            assert all(max(s) - min(s) <= 1 for s in zip(*sizes, strict=True))
            own = {(r.i, r.j, r.k): r.p for r in frame.select("*", grid.owner([F.col(c) for c in "ijk"]).alias("p")).collect()}
            for cell, p in own.items():
                assert all(a <= c < b for c, a, b in zip(cell, *boxes[p], strict=True))
            west = {r.part: r.w for r in grid.box(spark).select("part", grid.neighbour(F.col("part"), (-1, 0, 0)).alias("w")).collect()}
            for p, (a, _) in boxes.items():
                i = high[0] - 1 if a[0] == low[0] else a[0] - 1
                assert west[p] == (own[(i, a[1], a[2])] if own[(i, a[1], a[2])] != p else None)
            checked += 1
    assert checked >= 12 and frame.limit(1).select(grid.owner([F.lit(99), F.lit(0), F.lit(0)])).first()[0] is None
    with pytest.raises(MeshError):
        partition.structured("diagonal", low, high, 2)
    assert partition.structured("ijk square", (0, 0, 0), (40, 20, 10), 8).parts == (4, 2, 1) and partition.structured("ij square", (0, 0, 0), (30, 10, 5), 12).parts == (6, 2, 1)


def test_curve_and_inertia_parts_are_balanced(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 37 % 100).cast("double").alias("x"), (F.col("id") * 61 % 90).cast("double").alias("y"), (F.col("id") * 17 % 80).cast("double").alias("z"))
    sizes = lambda out: sorted(r["count"] for r in out.groupBy("part").count().collect())
    assert sizes(partition.by_curve(rows, ["x", "y", "z"], 7)) == [142] * 1 + [143] * 6
    assert sizes(partition.by_inertia(rows, 2)) == [250] * 4
    assert partition.by_curve(rows.limit(0), ["x", "y", "z"], 3).count() == 0


def test_swaps_keep_sizes_and_cut_fewer_edges(spark):
    """Two thick rings, dealt out alternately, come apart."""
    pairs = [(50 * g + i, 50 * g + (i + d) % 50) for g in range(2) for i in range(50) for d in (1, 2, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    start = spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 2).alias("part"))
    end = partition.swapped(edges, start, 20)
    assert {r.part: r["count"] for r in end.groupBy("part").count().collect()} == {0: 50, 1: 50}
    assert partition.cut_edges(edges, end) < partition.cut_edges(edges, start) / 2


def test_chains(spark):
    def order(*ends):
        row = spark.createDataFrame([([{"a": a, "b": b} for a, b in ends],)], "e array<struct<a:int,b:int>>").select(chained(F.col("e")).alias("o")).first().o
        return list(row.order), row.fans, row.closed

    assert order((1, 2), (3, 1), (2, 3)) == ([0, 2, 1], 1, True)
    assert order((2, 3), (1, 2), (3, 4)) == ([1, 0, 2], 1, False)
    assert order((1, 2), (5, 6), (2, 3)) == ([0, 2, 1], 2, False)
    assert order((1, 2), (2, 1), (7, 8), (8, 7)) == ([0, 1, 2, 3], 2, False)
    assert order((1, 2)) == ([0], 1, False)


def test_sheets_and_dual_cells(spark):
    mesh = brick(spark, 3)
    sizes = dual.sheets(mesh.elem).groupBy("sheet").count().collect()
    assert sorted(r["count"] for r in sizes) == [9] * 9
    cells = {r.vid: r for r in dual.cells(mesh.elem).collect()}
    inner = [v for v, r in cells.items() if r.whole]
    assert len(cells) == 64 and len(inner) == 8
    for v in inner:
        faces = [[e.id for e in f] for f in cells[v].faces]
        sides = [tuple(sorted(p)) for f in faces for p in zip(f, f[1:] + f[:1], strict=True)]
        assert len(faces) == 6 and len(sides) == 24 and all(sides.count(s) == 2 for s in sides)  # a closed polyhedron
    rings = dual.edge_rings(mesh.elem.filter("id in (1, 5)")).filter("a = 6 and b = 22").first()
    assert (rings.fans, rings.closed, len(rings.ring)) == (2, False, 2)
    assert adjacency.stars(mesh.elem).count() == 0


def test_medians_are_exact(spark):
    """More values than an approximate median tells apart, ties, and nulls."""
    from meshloom.operators.refine import cut, medians

    n = 400_001
    rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), F.col("id"))
    assert medians(rows.withColumn("g", F.lit(1)), "x", "g").first().m == (n - 1) // 2
    few = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (1, 1.0), (1, None), (2, 2.0), (2, 1.0)], "g int, x double")
    assert {r.g: r.m for r in medians(few, "x", "g").collect()} == {1: 5.0, 2: 1.0}
    got = cut(rows, ["x"], 2).groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("part").collect()
    assert [tuple(r) for r in got] == [(0, 100001, 0.0, 100000.0), (1, 100000, 100001.0, 200000.0), (2, 100000, 200001.0, 300000.0), (3, 100000, 300001.0, 400000.0)]


def test_inertia_halves_exactly(spark):
    n = 400_000
    rows = partition.by_inertia(spark.range(n).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), 1)
    assert sorted(tuple(r) for r in rows.groupBy("part").agg(F.count("*").alias("n"), (F.max("id") - F.min("id")).alias("d")).select("n", "d").collect()) == [(n // 2, n // 2 - 1)] * 2
