"""Shape functions of first and second order and spectral elements: nodes, polynomials, inverse maps, integrals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import shape, spectral
from meshloom.model import ETYPES, Mesh, MeshError
from meshloom.operators import couple

FORMS = [(k, None) for k in shape.KINDS] + [(k, n) for k, sizes in shape.SECOND.items() for n in sizes]


def nodes(name, n):
    if name in shape.SIMPLEX:
        d = shape.SIMPLEX[name]
        corner = [(0.0,) * d, *[tuple(float(i == k) for k in range(d)) for i in range(d)]]
    elif name == "PRISM":
        corner = [(a, b, w) for w in (-1.0, 1.0) for a, b in ((0, 0), (1, 0), (0, 1))]
    elif name == "PYRAMID":
        corner = [(a, b, -1.0) for a, b in shape.CUBE["QUAD"]] + [(0, 0, 1.0)]
    else:
        corner = [tuple(map(float, c)) for c in shape.CUBE[name]]
    out = list(corner)
    if n:
        pairs = shape.positions_of(name, 1) if name != "EDGE" else [(0, 1)]
        out += [tuple((np.array(corner[i]) + corner[j]) / 2) for i, j in pairs]
        if n in (9, 27):
            out += [tuple(np.mean([corner[i] for i in f], axis=0)) for f in (shape.positions_of(name, 2) if n == 27 else [])] + [(0.0,) * len(corner[0])]
    return [(*map(float, p), 0.0, 0.0)[:3] for p in out]


@pytest.mark.parametrize(("name", "n"), FORMS)
def test_weights_are_one_at_their_node_and_reproduce_fields(name, n):
    """On plain numbers, with the same code that makes columns."""
    weights = lambda q: shape._at_point(name, n, (*q, 0.0))
    spots, d = nodes(name, n), shape.dimension_of(name)
    assert np.allclose([weights(q)["w"] for q in spots], np.eye(len(spots)), atol=1e-12)
    rng, inner = np.random.default_rng(1), (0.2, 0.3, 0.1)
    w = weights(inner)
    assert sum(w["w"]) == pytest.approx(1) and np.allclose(np.sum(w["s"], axis=1), 0)
    if n:
        c = rng.normal(size=(3, 3))
        f = lambda q: sum(c[i, j] * q[i] * q[j] for i in range(d) for j in range(d))
        assert np.dot(w["w"], [f(q) for q in spots]) == pytest.approx(f(inner))
    step = 1e-6
    for i in range(d):
        up, down = ([x + s * (k == i) for k, x in enumerate(inner)] for s in (step, -step))
        assert np.allclose((np.array(weights(up)["w"]) - weights(down)["w"]) / (2 * step), w["s"][i], atol=1e-6)


def test_rules_integrate_exactly():
    size = {"EDGE": 2, "TRI": 0.5, "QUAD": 4, "TET": 1 / 6, "PRISM": 1, "HEX": 8}
    for name, total in size.items():
        q = shape.rule(name, 4)
        assert sum(k for *_, k in q) == pytest.approx(total)
    assert sum(k * u**3 * v for u, v, _, k in shape.rule("TRI", 4)) == pytest.approx(6 / 720)
    x, k = spectral.lobatto(5)
    assert np.allclose(x, (-1, -np.sqrt(3 / 7), 0, np.sqrt(3 / 7), 1)) and np.dot(k, np.array(x) ** 6) == pytest.approx(2 / 7)
    with pytest.raises(MeshError):
        shape._second_order("PRISM", 15, [0.0] * 3)
    with pytest.raises(MeshError):
        spectral.lobatto(1)


def test_location_in_prisms_and_pyramids(spark):
    """A cube cut into two prisms, and six pyramids around the middle of another: every point inside is found and mapped back."""
    cube = [(x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    vertex = [(i, *map(float, p)) for i, p in enumerate(cube)] + [(10 + i, p[0] + 1.0, float(p[1]), float(p[2])) for i, p in enumerate(cube)] + [(18, 1.5, 0.5, 0.5)]
    prisms = [(0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7)]
    faces = ["0123", "4765", "0451", "1562", "2673", "3740"]
    pyramids = [tuple(10 + int(c) for c in f) + (18,) for f in faces]
    elem = [(ETYPES["PRISM"], i, list(c)) for i, c in enumerate(prisms)] + [(ETYPES["PYRAMID"], i, list(c)) for i, c in enumerate(pyramids)]
    mesh = Mesh(spark.createDataFrame(vertex, "id long, x double, y double, z double"), spark.createDataFrame(elem, "etype int, id long, conn array<long>"))
    rng = np.random.default_rng(2)
    spots = [tuple(map(float, rng.uniform(0, 1, 3) * (2, 1, 1))) for _ in range(60)] + [(1.5, 0.5, 0.5), (0.0, 0.0, 0.0), (2.0, 1.0, 1.0), (1.5, 0.5, 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(99, 2.1, 0.5, 0.5)], "pid long, x double, y double, z double")
    found = couple.locate(points, mesh, 1.0)
    nodal = mesh.vertex.select(F.col("id").alias("vid"), (F.col("x") + 2 * F.col("y") - F.col("z")).alias("value"))
    got = {r.pid: r.value for r in couple.interpolate(found, mesh.elem, nodal).collect()}
    assert got.pop(99) is None and all(got[i] == pytest.approx(x + 2 * y - z, abs=1e-9) for i, (x, y, z) in enumerate(spots))
    total = couple.integrals(mesh, nodal).groupBy("etype").agg(F.sum("integral").alias("t")).collect()
    assert {r.etype: round(r.t, 9) for r in total} == {ETYPES["PRISM"]: 1.0, ETYPES["PYRAMID"]: 2.0}
    with pytest.raises(MeshError):
        couple.locate(points, Mesh(mesh.vertex, spark.createDataFrame([(ETYPES["KNIFE"], 1, list(range(7)))], mesh.elem.schema)), 1.0)
