import math

import pytest
from pyspark.sql import functions as F

from meshloom.functions import quality

KIND = "p array<struct<x:double,y:double,z:double>>"


def values(spark, points, metrics):
    rows = spark.createDataFrame([([tuple(map(float, q)) for q in points],)], KIND)
    if isinstance(metrics, str):
        return rows.select(quality.measures(metrics, F.col("p")).alias("m")).first().m.asDict()
    return rows.select(*[m.alias(k) for k, m in metrics(F.col("p")).items()]).first().asDict()


def test_regular_shapes_are_ideal(spark):
    r = math.sqrt(3)
    got = values(spark, [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], quality.triangle)
    assert abs(got.pop("area") - r / 2) < 1e-12 and abs(got.pop("minimum_angle") - 60) < 1e-9 and abs(got.pop("maximum_angle") - 60) < 1e-9
    assert abs(got.pop("relative_size_squared") - 0.75) < 1e-9 and abs(got.pop("shape_and_size") - 0.75) < 1e-9
    assert abs(got.pop("radius_ratio") - 4) < 1e-9  # grows with the fourth power of the side, here sqrt(2)
    assert all(abs(v - 1) < 1e-9 for v in got.values())
    got = values(spark, [(1.0, 1.0, 1.0), (-1.0, 1.0, -1.0), (1.0, -1.0, -1.0), (-1.0, -1.0, 1.0)], quality.tetrahedron)
    volume, jacobian = got.pop("volume"), got.pop("jacobian")
    assert abs(abs(volume) - 8 / 3) < 1e-12 and abs(jacobian - 6 * volume) < 1e-12
    names = ("scaled_jacobian", "edge_ratio", "radius_ratio", "aspect_ratio", "aspect_gamma", "aspect_frobenius", "condition")
    assert all(abs(abs(got[v]) - 1) < 1e-9 for v in names)


def test_collapsed_triangle_has_nulls(spark):
    got = values(spark, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)], quality.triangle)
    assert got["area"] == 0 and got["aspect_ratio"] is None and got["condition"] is None


# values of known elements, to be met
KNOWN = {
    "EDGE": ([(0, 0, 0), (1, 1, 1)], {"length": 1.732050807568877}),
    "PRISM": ([(0, 0, 0), (-1, 1, 0), (-1, 0, 0), (0, 0, 1), (-1, 1, 1), (-1, 0, 1)], {"volume": 0.5}),
    "TRI": ([(0, 0, 0), (5, 0, 0), (2.5, 4.330127, 0)], {"area": 10.8253175, "minimum_angle": 59.99999989158383, "maximum_angle": 60.00000021683238, "relative_size_squared": 8.533333407912848e-03, "distortion": 1.0}),
    "QUAD": ([(2, 0, 0), (1, 1, 2), (0, 1, 0), (0, 0, 0)], {"aspect_ratio": 1.4299641717623643, "skew": 0.09245003270420482, "taper": 0.7453559924999299, "warpage": 0.008, "area": 2.6925824035672523, "stretch": 0.5773502691896258, "maximum_angle": 90.0, "minimum_angle": 56.78908923910092, "condition": 2.307927774486216, "jacobian": 1.1141720290623112, "scaled_jacobian": 0.5570860145311556, "shear": 0.5570860145311556, "shape": 0.4332891224131210, "relative_size_squared": 1.0}),
    "TET": ([(-5, -5, -5), (-5, 5, -5), (-5, -5, 5), (5, -5, -5)], {"volume": 166.66666666666666, "condition": 1.2247448713915894, "jacobian": 1000.0, "shape": 0.8399473665965819, "relative_size_squared": 3.6e-05, "distortion": 1.0}),
    "HEX": ([(-0.2, -0.7, -0.3), (-0.7, 0.4, -0.6), (-0.5, 0.5, 0.3), (-0.3, -0.5, 0.5), (0.5, -0.8, -0.2), (0.4, 0.4, -0.6), (0.2, 0.5, 0.2), (0.5, -0.3, 0.8)], {"skew": 0.2458897037399689, "taper": 0.1784576525620624, "volume": 0.8130625, "stretch": 0.6209702997008308, "diagonal": 0.6896219298787313, "dimension": 0.5245942005845132, "condition": 1.2730598256735062, "jacobian": 0.477, "scaled_jacobian": 0.7778495101180594, "shear": 0.7778495101180594, "shape": 0.7897852810190353, "relative_size_squared": 0.6738357656250002, "shear_and_size": 0.5241428201914339, "shape_and_size": 0.5321855695148177, "distortion": 0.5847977114834493}),
}


@pytest.mark.parametrize("name", KNOWN)
def test_known_values(spark, name):
    points, want = KNOWN[name]
    got = values(spark, points, name)
    assert all(abs(got[k] - v) < 1e-9 * max(1, abs(v)) for k, v in want.items()), got
