"""More registered queries: location, interpolation, geometry models, the sphere, quality, refinement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import predicates, quality, sphere
from .functions.vector import Vec, from_lon_lat
from .model import Mesh
from .operators import couple, geometry, measure, refine, remap, spatial
from .plans.views import brick, brick_size, orders_mesh, table
from .registry import _P, _V, BRICK, _points, query
from .storage import written

LEAN = 0.3


def _leaning(spark, sf_dir) -> Mesh:
    """The brick, leaning over: x grows by LEAN with each layer."""
    mesh = brick(spark, brick_size(spark, sf_dir))
    return Mesh(mesh.vertex.withColumn("x", F.col("x") + LEAN * F.col("z")), mesh.elem)


# points a little off all planes between cells
_Q = f"""q AS (SELECT c_custkey AS pid, 0.013 + ((c_custkey * 37) % 1000) / 60.0 AS x, 0.017 + ((c_custkey * 61) % 1000) / 70.0 AS y, 0.019 + ((c_custkey * 17) % 500) / 40.0 AS z FROM customer),
h AS (SELECT pid, x, y, z, CAST(floor(x - {LEAN} * z) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k, n FROM q, s),
f AS (SELECT *, i >= 0 AND i < n AND j < n AND k < n AS inside FROM h)"""


def _inner(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), (0.013 + (k * 37) % 1000 / 60.0).alias("x"), (0.017 + (k * 61) % 1000 / 70.0).alias("y"), (0.019 + (k * 17) % 500 / 40.0).alias("z"))


@query(f"{BRICK}, {_Q} SELECT pid, CASE WHEN inside THEN 1 + i + n * j + n * n * k END AS id, CASE WHEN inside THEN round(2 * (x - {LEAN} * z - i) - 1, 6) END AS u FROM f")
def locate_exactly(spark, sf_dir):
    """The leaning cell that holds each point, whose boxes overlap, and one of its local coordinates."""
    found = couple.locate(_inner(spark, sf_dir), _leaning(spark, sf_dir), 1.0)
    return found.select("pid", "id", F.round("at.u", 6).alias("u"))


@query(f"{BRICK}, {_Q} SELECT pid, CASE WHEN inside THEN round(1 + 2 * x - 3 * y + 0.5 * z, 6) END AS value FROM f")
def interpolate_linear(spark, sf_dir):
    mesh = _leaning(spark, sf_dir)
    nodal = mesh.vertex.select(F.col("id").alias("vid"), (1 + 2 * F.col("x") - 3 * F.col("y") + 0.5 * F.col("z")).alias("value"))
    return couple.interpolate(couple.locate(_inner(spark, sf_dir), mesh, 1.0), mesh.elem, nodal).select("pid", F.round("value", 6).alias("value"))


@query(f"{BRICK} SELECT z AS \"group\", round(sum(1 + z + 0.5), 6) AS total, round(1 / sum(1 + z + 0.5), 9) AS factor FROM b GROUP BY z")
def normalise_groups(spark, sf_dir):
    """The integral of 1 + z over each layer of cells, and what makes it 1."""
    n = brick_size(spark, sf_dir)
    mesh = brick(spark, n)
    groups = mesh.elem.select("etype", "id", F.floor((F.col("id") - 1) / (n * n)).alias("group"))
    out = couple.normalise(mesh, mesh.vertex.select(F.col("id").alias("vid"), (1 + F.col("z")).alias("value")), groups)
    return out.select("group", F.round("total", 6).alias("total"), F.round("factor", 9).alias("factor"))


@query(f"WITH {_P}, {_V}, d AS (SELECT pid, round((v.x - p.x - 300) * (v.x - p.x - 300) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z), 6) AS d2 FROM p, v) SELECT pid, CASE WHEN min(d2) <= 300.0 * 300.0 THEN min(d2) END AS d2 FROM d GROUP BY pid")
def nearest_far_vertex(spark, sf_dir):
    """Points some 300 away from all vertices, within the last radius only, or beyond it."""
    points = _points(spark, sf_dir).withColumn("x", F.col("x") + 300)
    return spatial.nearest(points, orders_mesh(spark, sf_dir).vertex, 32.0, 300.0).select("pid", F.round("d2", 6).alias("d2"))


# a box for each supplier, of sizes 1 to 4, far from one another; six surfaces each, numbered 6 * supplier ..
_BOX = """x AS (SELECT s_suppkey AS k, 10.0 * s_suppkey AS o, 1.0 + s_suppkey % 4 AS a, 1.0 + s_suppkey % 3 AS b, 1.0 + s_suppkey % 2 AS c FROM supplier)"""
# Corners of the box's sides, outwards; bit 0, 1, 2 of a corner is its place along x, y, z.
_SIDES = ((0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6))


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(triangles, senses) of the suppliers' boxes; volumes have the suppliers' keys."""
    k = F.col("k")
    size = [1 + k % 4, 1 + k % 3, 1 + k % 2]

    def corner(bits: int):
        return F.struct(*[((10.0 * k if c == "x" else F.lit(0.0)) + (size[i] if bits >> i & 1 else F.lit(0)).cast("double")).alias(c) for i, c in enumerate("xyz")])

    rows = [F.struct(F.lit(2 * s + t).alias("n"), F.lit(s).alias("s"), *[corner(side[i]).alias(c) for i, c in zip(tri, "abc", strict=True)]) for s, side in enumerate(_SIDES) for t, tri in enumerate(((0, 1, 2), (0, 2, 3)))]
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    triangles = own.select("k", F.explode(F.array(*rows)).alias("t")).select((12 * k + F.col("t.n")).alias("tid"), (6 * k + F.col("t.s")).alias("surface"), "t.a", "t.b", "t.c")
    senses = own.select(F.explode(F.sequence(6 * k, 6 * k + 5)).alias("surface"), F.col("k").alias("volume"), F.lit(1).alias("sense"))
    return triangles, senses


@query(f"WITH {_BOX} SELECT k AS volume, a * b * c AS size FROM x")
def model_volumes(spark, sf_dir):
    return geometry.volumes(*_boxes(spark, sf_dir)).select("volume", F.round("size", 6).alias("size"))


@query(f"WITH {_BOX} SELECT 6 * k + i AS surface, CASE i // 2 WHEN 0 THEN b * c WHEN 1 THEN a * c ELSE a * b END AS area FROM x, (SELECT unnest(range(6)) AS i)")
def model_areas(spark, sf_dir):
    return geometry.surface_areas(_boxes(spark, sf_dir)[0]).select("surface", F.round("area", 6).alias("area"))


@query(f"WITH {_BOX} SELECT k AS rid, 6 * k + 1 AS surface, a / 2 AS distance, CAST(-1 AS BIGINT) AS next FROM x")
def ray_fire(spark, sf_dir):
    """From the middle of each box along x: the side that the ray leaves through, and the outside beyond it."""
    triangles, senses = _boxes(spark, sf_dir)
    k = F.col("s_suppkey")
    middle = F.struct((10.0 * k + (1 + k % 4) / 2).alias("x"), ((1 + k % 3) / 2 + 0.0625).alias("y"), ((1 + k % 2) / 2).alias("z"))
    way = F.struct(*[F.lit(v).alias(c) for v, c in ((1.0, "x"), (0.0, "y"), (0.0, "z"))])
    rays = table(spark, sf_dir, "supplier").select(k.alias("rid"), k.alias("volume"), middle.alias("o"), way.alias("d"), F.lit(8.0).alias("length"))
    found = geometry.ray_fire(rays, triangles, geometry.implicit_complement(senses, -1), 2.0)
    return found.select("rid", "surface", F.round("distance", 6).alias("distance"), "next")


_SPOT = "t AS (SELECT c_custkey AS pid, ((c_custkey * 37) % (10 * (SELECT count(*) FROM supplier))) + 0.53 AS x, (c_custkey % 5) * 0.71 + 0.11 AS y, (c_custkey % 7) * 0.37 + 0.07 AS z FROM customer)"


def _spots(spark, sf_dir) -> DataFrame:
    k, m = F.col("c_custkey"), 10 * table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "customer").select(k.alias("pid"), ((k * 37) % m + 0.53).alias("x"), ((k % 5) * 0.71 + 0.11).alias("y"), ((k % 7) * 0.37 + 0.07).alias("z"))


@query(f"WITH {_BOX}, {_SPOT} SELECT pid, min(k) AS volume FROM t LEFT JOIN x ON t.x BETWEEN o AND o + a AND y BETWEEN 0 AND b AND z BETWEEN 0 AND c GROUP BY pid")
def find_volume(spark, sf_dir):
    return geometry.find_volume(_spots(spark, sf_dir), *_boxes(spark, sf_dir), 2.0, 10.0)


@query("SELECT n_nationkey AS pid, CAST(CASE WHEN n_nationkey % 5 < 1 + n_nationkey % 4 THEN n_nationkey END AS BIGINT) AS volume FROM nation WHERE n_nationkey < (SELECT count(*) FROM supplier)")
def find_volume_direct(spark, sf_dir):
    """By solid angles: a point for each nation, along the lower middle of the box of the supplier of that number."""
    k = F.col("n_nationkey")
    count = table(spark, sf_dir, "supplier").count()
    points = table(spark, sf_dir, "nation").filter(k < count).select(k.alias("pid"), (10.0 * k + k % 5 + 0.25).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    return geometry.find_volume_direct(points, *_boxes(spark, sf_dir)).select("pid", F.col("volume").cast("long").alias("volume"))


@query(f"""WITH {_BOX}, {_SPOT}, g AS (SELECT pid, x.k, t.x, y, z, greatest(o - t.x, 0, t.x - o - a) AS u, greatest(y - b, 0) AS v, greatest(z - c, 0) AS w, least(abs(t.x - o), abs(o + a - t.x), y, abs(b - y), z, abs(c - z)) AS i FROM t JOIN x ON abs(t.x - o) < 20)
SELECT pid, round(min(CASE WHEN u + v + w = 0 THEN i * i ELSE u * u + v * v + w * w END), 6) AS d2 FROM g GROUP BY pid""")
def closest_surface(spark, sf_dir):
    """The squared distance of each point to the nearest triangle."""
    found = geometry.closest(_spots(spark, sf_dir), _boxes(spark, sf_dir)[0], 1.0, 12.0)
    return found.select("pid", F.round("d2", 6).alias("d2"))


@query(f"WITH {_BOX} SELECT 'volume with open edges' AS kind, k AS id, CAST(4 AS BIGINT) AS n FROM x WHERE k % 5 = 0 UNION ALL SELECT 'surface without triangles', 6 * k, 1 FROM x WHERE k % 5 = 0")
def model_check(spark, sf_dir):
    """Boxes of which one side was taken out."""
    triangles, senses = _boxes(spark, sf_dir)
    return geometry.check(triangles.filter("surface % 30 <> 0"), senses)


@query("SELECT s_suppkey AS \"inner\", s_suppkey - 1 AS \"outer\" FROM supplier WHERE s_suppkey % 10 > 0 AND s_suppkey > (SELECT min(s_suppkey) FROM supplier)")
def inclusion_tree(spark, sf_dir):
    """Suppliers nested in those before them of the same ten: each one's next outer one."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("inner"))
    low = own.agg(F.min("inner")).first()[0]
    first = F.greatest(F.col("inner") - F.col("inner") % 10, F.lit(low))
    pairs = own.filter(F.col("inner") > first).select("inner", F.explode(F.sequence(first, F.col("inner") - 1)).alias("outer"))
    return geometry.topology_by_inclusion(pairs).select("inner", "outer")


_SPH = """u AS (SELECT c_custkey AS id, radians((c_custkey * 37) % 360) AS lon, radians((c_custkey * 17) % 120 - 60) AS lat, radians(1 + c_custkey % 9) AS w FROM customer)"""


def _spherical(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.radians((k * 37) % 360).alias("lon"), F.radians((k * 17) % 120 - 60).alias("lat"), F.radians(1 + k % 9).alias("w"))


@query(f"""WITH {_SPH}, c AS (SELECT id, [lon, lon + w, lon] AS lo, [lat, lat, lat + w] AS la FROM u),
p AS (SELECT id, cos(la[1]) * cos(lo[1]) AS ax, cos(la[1]) * sin(lo[1]) AS ay, sin(la[1]) AS az, cos(la[2]) * cos(lo[2]) AS bx, cos(la[2]) * sin(lo[2]) AS b2, sin(la[2]) AS bz, cos(la[3]) * cos(lo[3]) AS cx, cos(la[3]) * sin(lo[3]) AS cy, sin(la[3]) AS cz FROM c)
SELECT id, round(2 * atan2(ax * (b2 * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - b2 * cx), 1 + ax * bx + ay * b2 + az * bz + bx * cx + b2 * cy + bz * cz + ax * cx + ay * cy + az * cz), 7) AS lhuilier FROM p""")
def spherical_area(spark, sf_dir):
    corner = lambda lon, lat: from_lon_lat(lon, lat).struct()
    lon, lat, w = F.col("lon"), F.col("lat"), F.col("w")
    poly = F.array(corner(lon, lat), corner(lon + w, lat), corner(lon, lat + w))
    return _spherical(spark, sf_dir).select("id", F.round(sphere.area(poly), 7).alias("lhuilier"))


@query(f"WITH {_SPH} SELECT id, round(acos(least(1, sin(lat) * sin(lat + w) + cos(lat) * cos(lat + w) * cos(2 * w))), 6) AS angle, round(lon, 6) AS lon, round(lat, 6) AS lat FROM u")
def spherical_distance(spark, sf_dir):
    lon, lat, w = F.col("lon"), F.col("lat"), F.col("w")
    a, b = from_lon_lat(lon, lat), from_lon_lat(lon + 2 * w, lat + w)
    back = sphere.to_lon_lat(a.scale(3.0))
    return _spherical(spark, sf_dir).select("id", F.round(sphere.distance(a, b), 6).alias("angle"), F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query(f"""WITH {_SPH}, p AS (SELECT id, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM u), m AS (SELECT *, greatest(abs(x), abs(y), abs(z)) AS g FROM p),
q AS (SELECT *, CASE WHEN x >= g THEN 1 WHEN y >= g THEN 2 WHEN -x >= g THEN 3 WHEN -y >= g THEN 4 WHEN -z >= g THEN 5 ELSE 6 END AS plane FROM m)
SELECT id, plane, round(CASE plane WHEN 1 THEN y / x WHEN 2 THEN z / y WHEN 3 THEN y / x WHEN 4 THEN z / y WHEN 5 THEN x / z ELSE x / z END, 6) AS c1, 0.0::DOUBLE AS gap FROM q""")
def gnomonic_round_trip(spark, sf_dir):
    p = from_lon_lat(F.col("lon"), F.col("lat"))
    rows = _spherical(spark, sf_dir).select("id", p.struct().alias("p")).withColumn("plane", sphere.plane_of(Vec.of(F.col("p"))))
    rows = rows.withColumn("q", sphere.project(Vec.of(F.col("p")), F.col("plane")))
    back = Vec.of(sphere.unproject(F.col("q"), F.col("plane"))) - Vec.of(F.col("p"))
    return rows.select("id", "plane", F.round("q.x", 6).alias("c1"), F.round(back.norm(), 6).alias("gap"))


def _grids(spark, sf_dir) -> tuple[DataFrame, DataFrame, float]:
    """A cubed sphere and a grid of longitudes and latitudes, with about as many cells as there are customers."""
    n = max(6, brick_size(spark, sf_dir))
    return written(remap.cubed_sphere(spark, n), "cubes"), written(remap.lat_lon(spark, 3 * n, 2 * n), "longitudes"), 2 / n


@query(f"{BRICK} SELECT i AS id, 0.0::DOUBLE AS gap FROM (SELECT unnest(range(6 * greatest(n, 6) * greatest(n, 6))) AS i FROM s)")
def sphere_overlap(spark, sf_dir):
    """For each cell of one grid, what its overlaps with the other leave of its area."""
    source, target, width = _grids(spark, sf_dir)
    rows = remap.overlap_check(remap.overlaps(source, target, width), target, "tgt")
    return rows.select("id", F.round(F.abs(F.col("area") - F.col("covered")), 8).alias("gap"))


@query("SELECT unnest(['inconsistent', 'unconserved', 'nonmonotone']) AS kind, CAST(0 AS BIGINT) AS n")
def sphere_weights(spark, sf_dir):
    """How many rows, columns and entries of the weights between two grids fail the checks."""
    source, target, width = _grids(spark, sf_dir)
    w = measure.weights(remap.overlaps(source, target, width))
    areas = [g.select("id", sphere.area(F.col("poly")).alias("area")) for g in (source, target)]
    return remap.check_weights(w, areas[0], areas[1], 1e-6)


@query(f"{BRICK} SELECT grid, round(4 * pi(), 6) AS area, CAST(CASE grid WHEN 'cubes' THEN 6 * greatest(n, 6) * greatest(n, 6) WHEN 'longitudes' THEN 6 * greatest(n, 6) * greatest(n, 6) ELSE 20 * n * n END AS BIGINT) AS n FROM s, (SELECT unnest(['cubes', 'longitudes', 'triangles']) AS grid)")
def sphere_grids(spark, sf_dir):
    source, target, _ = _grids(spark, sf_dir)
    named = {"cubes": source, "longitudes": target, "triangles": remap.icosahedral(spark, max(2, brick_size(spark, sf_dir)))}
    out = [remap.total_area(g).select(F.lit(k).alias("grid"), F.round("area", 6).alias("area"), "n") for k, g in named.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 5 AS b, 1.0 + c_custkey % 3 AS c, (c_custkey % 4) / 2.0 AS s FROM customer),
u AS (SELECT *, a * b * c AS d, s * s + c * c AS w, a * a + b * b + s * s + c * c AS q FROM t),
v AS (SELECT *, a * a * b * b + b * b * w + a * a * c * c AS r, a * a * a * a + b * b * b * b + w * w + 2 * a * a * s * s AS o, a * b * sqrt(w) AS n FROM u)
SELECT id, round(greatest(a, b, sqrt(w)) / least(a, b, sqrt(w)), 5) AS edge_ratio, round(greatest(a, b, sqrt(w)) / least(a, b, sqrt(w)), 5) AS max_edge_ratio, round(s / sqrt(w), 5) AS skew, 0.0::DOUBLE AS taper,
 round(sqrt(3) * least(a, b, sqrt(w)) / sqrt(greatest((a + s) * (a + s), (a - s) * (a - s)) + b * b + c * c), 5) AS stretch, round(sqrt((a - s) * (a - s) + b * b + c * c) / sqrt((a + s) * (a + s) + b * b + c * c), 5) AS diagonal,
 round(greatest(0, o - q * q / 3) / pow(d, 4 / 3.0), 5) AS oddy, round(sqrt(q * r) / (3 * d), 5) AS condition, round(sqrt(q * r) / (3 * d), 5) AS med_aspect_frobenius, round(d / n, 5) AS scaled_jacobian, round(d / n, 5) AS shear,
 round(3 * pow(d, 2 / 3.0) / q, 5) AS shape, round(1 / (d * d), 5) AS relative_size_squared, 1.0::DOUBLE AS distortion, round(d, 5) AS volume FROM v""")
def leaning_hexahedra(spark, sf_dir):
    """Metrics of parallelepipeds that lean over by s along x."""
    names = ["edge_ratio", "max_edge_ratio", "skew", "taper", "stretch", "diagonal", "oddy", "condition", "med_aspect_frobenius", "scaled_jacobian", "shear", "shape", "relative_size_squared", "distortion", "volume"]
    k = F.col("c_custkey")
    a, b, c, s = 1 + k % 7, 1 + k % 5, 1 + k % 3, (k % 4) / 2
    at = lambda x, y, z: F.struct((x + (s if z is c else 0)).cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    o = F.lit(0)
    points = F.array(*[at(x, y, z) for z in (o, c) for x, y in ((o, o), (a, o), (a, b), (o, b))])
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), points.alias("p")).select("id", quality.measures("HEX", F.col("p")).alias("m"))
    return rows.select("id", *[F.round(f"m.{n}", 5).alias(n) for n in names])


@query("""WITH t AS (SELECT c_custkey AS id, 2.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 2 AS m, 1.0 + c_custkey % 5 AS h FROM customer), u AS (SELECT *, (a - m) / 2 AS e, sqrt(h * h + (a - m) * (a - m) / 4) AS l FROM t)
SELECT id, round((a + m) * h / 2, 5) AS area, round(2 * e / least(a + m, 2 * h) * 2 / 2, 5) AS taper_times, round(greatest(a, m, l) / least(a, m, l), 5) AS edge_ratio, round(degrees(atan2(h, e)), 5) AS minimum_angle, round(180 - degrees(atan2(h, e)), 5) AS maximum_angle,
 round(m * h, 5) AS jacobian, round(h / l, 5) AS scaled_jacobian, round(4 * greatest(a, m) * 0 + greatest((a * a + l * l) / (a * h), (m * m + l * l) / (m * h)) / 2, 5) AS condition FROM u""")
def trapezoid_quality(spark, sf_dir):
    """Symmetric trapezoids with parallel sides a below and m above."""
    k = F.col("c_custkey")
    a, m, h = 2.0 + k % 7, 1.0 + k % 2, 1.0 + k % 5
    e = (a - m) / 2
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1.0).alias("z"))
    points = F.array(at(F.lit(0.0), F.lit(0.0)), at(a, F.lit(0.0)), at(a - e, h), at(e, h))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), points.alias("p")).select("id", quality.measures("QUAD", F.col("p")).alias("q"))
    return rows.select("id", F.round("q.area", 5).alias("area"), F.round("q.taper", 5).alias("taper_times"), *[F.round(f"q.{n}", 5).alias(n) for n in ("edge_ratio", "minimum_angle", "maximum_angle", "jacobian", "scaled_jacobian", "condition")])


@query(f"{BRICK} SELECT 8 * n * n * n AS n_cells, (2 * n + 1) * (2 * n + 1) * (2 * n + 1) AS n_vertices, round(CAST(n * n * n AS DOUBLE), 6) AS volume, 0.125::DOUBLE AS largest FROM s")
def refined_brick(spark, sf_dir):
    mesh, _ = refine.refine(brick(spark, brick_size(spark, sf_dir)))
    size = measure.with_points(mesh).select(measure.measure(F.col("etype"), F.col("p")).alias("size"))
    cells = size.agg(F.count("*").alias("n_cells"), F.round(F.sum("size"), 6).alias("volume"), F.round(F.max("size"), 9).alias("largest"))
    vertices = mesh.vertex.select(*"xyz").distinct().agg(F.count("*").alias("n_vertices"))
    return cells.join(F.broadcast(vertices)).select("n_cells", "n_vertices", "volume", "largest")  # a row each


@query(f"{BRICK} SELECT id, 20 AS n, 4 * (x + y + z + 1.5) AS total FROM b")
def mid_edge_nodes(spark, sf_dir):
    """Each cell's nodes after those in the middle of its edges were added, and the sum of the new ones' coordinates over three."""
    mesh = refine.second_order(brick(spark, brick_size(spark, sf_dir)))
    rows = mesh.elem.select("id", F.posexplode("conn").alias("pos", "vid")).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    new = F.when(F.col("pos") >= 8, F.col("x") + F.col("y") + F.col("z")).otherwise(0.0)
    return rows.groupBy("id").agg(F.count("*").cast("int").alias("n"), (F.sum(new) / 3).alias("total"))


@query(f"{BRICK} SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON c.id IN (a.id + 1, a.id + a.n, a.id + a.n * a.n) AND abs(a.x - c.x) + abs(a.y - c.y) + abs(a.z - c.z) = 1")
def dual_edges(spark, sf_dir):
    rows = refine.dual(brick(spark, brick_size(spark, sf_dir)), 3).elem
    return rows.select(F.get("conn", F.lit(0)).alias("a"), F.get("conn", F.lit(1)).alias("b"))


@query(f"{BRICK} SELECT n + 1 AS size, 3 * n * n AS n FROM s")
def dual_chords(spark, sf_dir):
    """How many chords of opposite faces there are, by their number of faces."""
    rows = refine.chords(brick(spark, brick_size(spark, sf_dir)).elem).groupBy("chord").agg(F.count("*").alias("size"))
    return rows.groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH {_P}, m AS (SELECT *, least(greatest(x, 3), 9) AS u, least(greatest(y, 3), 9) AS v, least(greatest(z, 3), 9) AS w FROM p) SELECT pid, x BETWEEN 3 AND 9 AND y BETWEEN 3 AND 9 AND z BETWEEN 3 AND 9 AS inside, round(sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)), 6) AS distance, round({6 * math.sqrt(3)}, 6) AS diagonal FROM m")
def point_in_box(spark, sf_dir):
    lo, hi = (Vec(*[F.lit(v)] * 3) for v in (3.0, 9.0))
    p = Vec(F.col("x"), F.col("y"), F.col("z"))
    return _points(spark, sf_dir).select("pid", predicates.box_holds(lo, hi, p).alias("inside"), F.round(predicates.box_distance(lo, hi, p), 6).alias("distance"), F.round(predicates.box_diagonal(lo, hi), 6).alias("diagonal"))


