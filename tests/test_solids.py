"""Polyhedra, oriented boxes, matrices and reconstructed surfaces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import matrix, polyhedron
from meshloom.functions.vector import Vec
from meshloom.model import ETYPES, Mesh, MeshError
from meshloom.operators import obb, reconstruct


def vec(*p):
    return Vec(*[F.lit(float(x)) for x in p])


def test_polyhedron_cuts(spark):
    cube = polyhedron.box(vec(0, 0, 0), vec(1, 1, 1))
    planes = {
        "corner": [(1, 1, 1, 0.5)], "half": [(0, 0, 2, 1)], "none": [(1, 0, 0, 1)], "all": [(1, 0, 0, 0)], "beyond": [(1, 0, 0, -1)], "through edges": [(1, -1, 0, 0)], "through corners": [(1, 1, 1, 1)],
        "prism": [(1, 1, 0, 1), (0, 0, 1, 0.25), (0, 0, -1, -0.125)], "nothing": [(1, 0, 0, 0.3), (-1, 0, 0, -0.4)], "wedge": [(1, 0, -1, 0), (0, 1, -1, 0)],
    }
    rows = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in planes.items()], "name string, planes array<struct<a:double,b:double,c:double,d:double>>")
    left = rows.select("name", polyhedron.cut_all(cube, F.col("planes")).alias("q"))
    got = {r.name: (r.n, r.v, r.a, r.h) for r in left.select("name", F.size("q").alias("n"), polyhedron.volume(F.col("q")).alias("v"), polyhedron.area(F.col("q")).alias("a"), polyhedron.holds(F.col("q"), vec(0.1, 0.2, 0.2)).alias("h")).collect()}
    root = math.sqrt(3)
    want = {"corner": (4, 1 / 48, 3 / 8 + root / 8, True), "half": (6, 0.5, 4, True), "none": (6, 1, 6, True), "all": (0, 0, 0, False), "beyond": (0, 0, 0, False), "through edges": (5, 0.5, 3 + math.sqrt(2), True), "through corners": (4, 1 / 6, 1.5 + root / 2, True), "prism": (5, 1 / 16, None, True), "nothing": (0, 0, 0, False), "wedge": (5, 1 / 3, None, True)}
    for k, (n, v, a, h) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v, abs=1e-12) and (a is None or got[k][2] == pytest.approx(a)), k
        assert got[k][3] == h, k


def test_random_cuts_add_up(spark):
    """What a plane leaves and what its reverse leaves make the whole, cut after cut."""
    rng = random.Random(3)
    rows = [(i, [tuple(rng.gauss(0, 1) for _ in range(3)) + (rng.uniform(-0.3, 0.9),) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p array<struct<a:double,b:double,c:double,d:double>>")
    cube = polyhedron.box(vec(0, 0, 0), vec(1, 1, 1))
    back = F.struct(*[(-F.element_at("p", -1)[c]).alias(c) for c in "abcd"])
    first = df.select("p", polyhedron.cut_all(cube, F.slice("p", 1, 3)).alias("q"))
    sums = first.select(polyhedron.volume(F.col("q")).alias("v"), polyhedron.volume(polyhedron.cut(F.col("q"), F.element_at("p", -1))).alias("a"), polyhedron.volume(polyhedron.cut(F.col("q"), back)).alias("b")).collect()
    assert all(r.v == pytest.approx(r.a + r.b, abs=1e-9) for r in sums) and sum(r.a > 0 and r.b > 0 for r in sums) > 5


def test_eigenvectors(spark):
    rng = np.random.default_rng(1)
    made = [m @ m.T for m in rng.normal(size=(30, 3, 3))] + [np.diag(d).astype(float) for d in ((3, 1, 2), (1, 1, 1), (0, 0, 0), (0, 5, 0))] + [np.ones((3, 3)), -np.ones((3, 3))]
    rows = spark.createDataFrame([(i, *map(float, (m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]))) for i, m in enumerate(made)], "id int, xx double, xy double, xz double, yy double, yz double, zz double")
    for r in rows.select("id", matrix.eigen(F.struct("xx", "xy", "xz", "yy", "yz", "zz")).alias("e"), matrix.determinant(F.struct("xx", "xy", "xz", "yy", "yz", "zz")).alias("d")).collect():
        value, axes = np.array([e.value for e in r.e]), np.array([list(e.axis) for e in r.e])
        assert np.allclose(value, np.linalg.eigvalsh(made[r.id])[::-1]) and np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) == pytest.approx(1)
        assert np.allclose(axes.T @ np.diag(value) @ axes, made[r.id]) and r.d == pytest.approx(np.linalg.det(made[r.id]), abs=1e-9)


def test_transforms(spark):
    turn, shift = matrix.affine([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]]), matrix.affine([[1, 0, 0, 5], [0, 1, 0, 0], [0, 0, 2, 0]])
    row = spark.range(1).select(matrix.moved(matrix.after(shift, turn), vec(1, 2, 3)).struct().alias("a"), matrix.moved(matrix.after(turn, shift), vec(1, 2, 3)).struct().alias("b")).first()
    assert (tuple(row.a), tuple(row.b)) == ((3.0, 1.0, 6.0), (-2.0, 6.0, 6.0))


def test_box_of_triangles_and_rays(spark):
    """A long thin sheet of many small triangles at one end: their number doesn't turn the box."""
    a = math.radians(30)
    at = lambda u, v: (u * math.cos(a) - v * math.sin(a), u * math.sin(a) + v * math.cos(a), 1.0)
    sheet = [(1, [at(0, 0), at(10, 0), at(10, 2)]), (1, [at(0, 0), at(10, 2), at(0, 2)])]
    tiny = [(1, [at(1e-3 * i, 0), at(1e-3 * i + 1e-3, 0), at(1e-3 * i, 2)]) for i in range(200)]
    boxes = obb.of_triangles(spark.createDataFrame(sheet + tiny, "group long, p array<struct<x:double,y:double,z:double>>"))
    r = boxes.first()
    assert list(r.half) == pytest.approx([0, 1, 5], abs=0.02) and tuple(r.center) == pytest.approx(at(5, 1), abs=0.02)
    rays = spark.createDataFrame([(1, at(-5, 1)[:2] + (1.0,), at(1, 0)[:2] + (0.0,), 100.0), (2, (0.0, 0.0, 50.0), (0.0, 0.0, -1.0), 40.0), (3, at(5, 1)[:2] + (9.0,), (0.0, 0.0, -2.0), 40.0)], "ray long, origin struct<x:double,y:double,z:double>, direction struct<x:double,y:double,z:double>, length double")
    got = {h.ray: (h.enter, h.leave) for h in obb.hits(boxes, rays, 4.0).collect()}
    assert set(got) == {1, 3} and got[1] == pytest.approx((5, 15), abs=0.05) and got[3] == pytest.approx((4, 4), abs=1e-6)


def torus(spark, n):
    m = 2 * n
    point = lambda i, j: ((2 + math.cos(2 * math.pi * j / n)) * math.cos(2 * math.pi * i / m), (2 + math.cos(2 * math.pi * j / n)) * math.sin(2 * math.pi * i / m), math.sin(2 * math.pi * j / n))
    vertex = spark.createDataFrame([(i * n + j, *point(i, j)) for i in range(m) for j in range(n)], "id long, x double, y double, z double")
    faces = [(ETYPES["QUAD"], i * n + j, [i * n + j, (i + 1) % m * n + j, (i + 1) % m * n + (j + 1) % n, i * n + (j + 1) % n]) for i in range(m) for j in range(n)]
    return Mesh(vertex, spark.createDataFrame(faces, "etype int, id long, conn array<long>"))


def test_reconstruction_gets_better_with_the_degree(spark):
    mesh, error = torus(spark, 16), {}
    points = mesh.elem.select(F.col("id").alias("pid"), "etype", "id", F.array(*[F.lit(0.25)] * 4).alias("weight"))
    off = F.abs(F.sqrt(F.pow(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - 2, 2) + F.col("z") * F.col("z")) - 1)
    for degree in (1, 2, 4):
        out = reconstruct.moved(mesh, reconstruct.fit(mesh, degree), degree, points)
        error[degree] = out.agg(F.max(off)).first()[0]
    assert error[1] > 3 * error[2] > 6 * error[4] and error[4] < 2e-3
    with pytest.raises(MeshError):
        reconstruct.fit(mesh, 0)
