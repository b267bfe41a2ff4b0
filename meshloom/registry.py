"""The registered mesh queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quality
from .model import ETYPES, Mesh
from .operators import adjacency, entities, measure, parts, sets, spatial
from .plans.views import brick, brick_size, orders_mesh, squares, table
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "tag_intersect"

_EV = """ev AS (SELECT l_orderkey AS id, l_partkey AS vid, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)"""
_V = """v AS (SELECT p_partkey AS id, CAST(p_partkey % 20 AS DOUBLE) AS x, CAST((p_partkey // 20) % 20 AS DOUBLE) AS y,
  CAST(p_size AS DOUBLE) AS z FROM part)"""
_EDGES = """n AS (SELECT id, count(*) AS n FROM ev GROUP BY id HAVING count(*) >= 3),
e AS (SELECT a.id, a.pos, least(a.vid, b.vid) AS lo, greatest(a.vid, b.vid) AS hi FROM ev a JOIN n ON n.id = a.id
  JOIN ev b ON b.id = a.id AND b.pos = (a.pos + 1) % n.n WHERE a.vid <> b.vid)"""
_P = """p AS (SELECT c_custkey AS pid, ((c_custkey * 37) % 1000) / 50.0 AS x, ((c_custkey * 61) % 1000) / 50.0 AS y,
  ((c_custkey * 17) % 500) / 10.0 AS z FROM customer)"""

BRICK = """WITH s AS (SELECT greatest(2, CAST(floor(cbrt(count(*) + 0.5)) AS BIGINT)) AS n FROM customer),
b AS (SELECT i + 1 AS id, i % n AS x, (i // n) % n AS y, i // (n * n) AS z, n FROM (SELECT unnest(range(n * n * n)) AS i, n FROM s))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), ((k * 37) % 1000 / 50.0).alias("x"), ((k * 61) % 1000 / 50.0).alias("y"), ((k * 17) % 500 / 10.0).alias("z"))


@query(f"WITH {_EV} SELECT id FROM (SELECT DISTINCT id FROM ev) JOIN orders ON id = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def tag_intersect(spark, sf_dir):
    return entities.by_type_and_tag(orders_mesh(spark, sf_dir), "POLYGON", {"STATUS": "F", "PRIORITY": "1-URGENT"}).select("id")


@query(f"WITH {_EV} SELECT id FROM (SELECT DISTINCT id FROM ev) JOIN orders ON id = o_orderkey WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def tag_union(spark, sf_dir):
    return entities.by_type_and_tag(orders_mesh(spark, sf_dir), "POLYGON", {"STATUS": "F", "PRIORITY": "1-URGENT"}, "UNION").select("id")


@query("SELECT 0 AS etype, count(*) AS n FROM part UNION ALL SELECT 4, count(DISTINCT l_orderkey) FROM lineitem")
def entity_counts(spark, sf_dir):
    return entities.counts(orders_mesh(spark, sf_dir))


@query("SELECT d.doc_id AS id, coalesce(l.quality, -1) AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def tag_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("etype"), F.col("doc_id").alias("id"))
    values = table(spark, sf_dir, "labels").select(F.lit(0).alias("etype"), F.col("doc_id").alias("id"), F.col("quality").alias("value"))
    return entities.tag_data(docs, entities.Tag(values, -1)).select("id", "value")


@query("SELECT o_orderstatus AS status, count(o_totalprice) AS n, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(sum(o_totalprice), 1) AS total, round(sqrt(avg(o_totalprice * o_totalprice)), 4) AS rms FROM orders GROUP BY o_orderstatus")
def tag_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    return entities.tag_stats(rows, F.col("o_totalprice"), ["status"]).withColumn("total", F.round("total", 1)).withColumn("rms", F.round("rms", 4))


@query(f"WITH {_EV} SELECT DISTINCT vid AS id FROM ev")
def connectivity_vertices(spark, sf_dir):
    return entities.connectivity(orders_mesh(spark, sf_dir).elem)


@query(f"WITH {_EV}, {_V}, d AS (SELECT DISTINCT id, vid FROM ev) SELECT d.id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM d JOIN v ON v.id = vid GROUP BY d.id")
def average_position(spark, sf_dir):
    return entities.positions(orders_mesh(spark, sf_dir)).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {_EV} SELECT vid, count(DISTINCT id) AS n FROM ev GROUP BY vid")
def vertex_valence(spark, sf_dir):
    return adjacency.vertex_elements(orders_mesh(spark, sf_dir).elem).groupBy("vid").agg(F.count("*").alias("n"))


_FIRST = "first AS (SELECT DISTINCT vid FROM ev WHERE id = (SELECT min(id) FROM ev WHERE pos = 1) AND pos < 2)"


@query(f"WITH {_EV}, {_FIRST} SELECT id FROM ev WHERE vid IN (SELECT vid FROM first) GROUP BY id HAVING count(DISTINCT vid) = (SELECT count(*) FROM first)")
def adjacent_to_all(spark, sf_dir):
    """Orders with both of the first two parts of the first order of two lines or more."""
    elem = orders_mesh(spark, sf_dir).elem
    one = elem.filter(F.size("conn") > 1).orderBy("id").limit(1)
    wanted = one.select(F.explode(F.slice("conn", 1, 2)).alias("id")).distinct()
    return adjacency.elements_at(elem, wanted, "INTERSECT").select("id")


@query(f"WITH {_EV} SELECT DISTINCT id FROM ev WHERE vid IN (3, 4)")
def adjacent_to_any(spark, sf_dir):
    return adjacency.elements_at(orders_mesh(spark, sf_dir).elem, spark.range(3, 5)).select("id")


@query(f"WITH {_EV}, {_EDGES} SELECT lo, hi, count(*) AS n_up FROM e GROUP BY lo, hi")
def polygon_edges(spark, sf_dir):
    rows = adjacency.side_entities(orders_mesh(spark, sf_dir).elem, 1)
    return rows.select(F.get("key", F.lit(0)).alias("lo"), F.get("key", F.lit(1)).alias("hi"), "n_up")


@query(f"WITH {_EV}, {_EDGES} SELECT lo, hi, min(id) AS id FROM e GROUP BY lo, hi HAVING count(*) = 1")
def polygon_skin(spark, sf_dir):
    rows = adjacency.skin(orders_mesh(spark, sf_dir).elem, 1)
    return rows.select(F.get("key", F.lit(0)).alias("lo"), F.get("key", F.lit(1)).alias("hi"), "id")


@query(f"{BRICK} SELECT 6 * n * n AS n_faces, (n + 1) * (n + 1) * (n + 1) - (n - 1) * (n - 1) * (n - 1) AS n_vertices FROM s")
def brick_skin(spark, sf_dir):
    faces = adjacency.skin(brick(spark, brick_size(spark, sf_dir)).elem, 2)
    every = faces.select(F.lit(0).alias("k"), F.xxhash64("key").alias("v")).unionByName(faces.select(F.lit(1).alias("k"), F.explode("conn").alias("v")).distinct())
    return every.agg(F.count_if(F.col("k") == 0).alias("n_faces"), F.count_if(F.col("k") == 1).alias("n_vertices"))


@query(f"{BRICK} SELECT a.id, b.id AS other_id FROM b a JOIN b ON b.id IN (a.id - 1, a.id + 1, a.id - a.n, a.id + a.n, a.id - a.n * a.n, a.id + a.n * a.n) AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1")
def brick_neighbours(spark, sf_dir):
    return adjacency.neighbours(brick(spark, brick_size(spark, sf_dir)).elem, 2).select("id", "other_id")


@query(f"{BRICK} SELECT id, greatest(x, y, z) AS layer FROM b WHERE greatest(x, y, z) <= 3")
def bridge_layers(spark, sf_dir):
    start = spark.range(1, 2).select(F.lit(ETYPES["HEX"]).alias("etype"), "id")
    return adjacency.bridge(brick(spark, brick_size(spark, sf_dir)).elem, start, 0, 3).select("id", F.col("layer").cast("long").alias("layer"))


@query(f"{BRICK} SELECT id, x + y + z AS layer FROM b WHERE x + y + z <= 3")
def bridge_faces(spark, sf_dir):
    start = spark.range(1, 2).select(F.lit(ETYPES["HEX"]).alias("etype"), "id")
    return adjacency.bridge(brick(spark, brick_size(spark, sf_dir)).elem, start, 2, 3).select("id", F.col("layer").cast("long").alias("layer"))


@query("""SELECT lo, hi, hi - lo + 1 AS n FROM (SELECT min(id) AS lo, max(id) AS hi FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g
FROM (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O')) GROUP BY g)""")
def id_runs(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.lit(0).alias("etype"), F.col("o_orderkey").alias("id"))
    return sets.runs(ids, 256).select("lo", "hi", "n")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O')
SELECT 'intersect' AS op, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'subtract', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
UNION ALL SELECT 'unite', id FROM (SELECT id FROM a UNION SELECT id FROM b)""")
def set_algebra(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.filter(c).select(F.lit(4).alias("etype"), F.col("l_orderkey").alias("id")) for c in ("l_returnflag = 'R'", "l_linestatus = 'O'"))
    named = [f(a, b).select(F.lit(f.__name__).alias("op"), "id") for f in (sets.intersect, sets.subtract, sets.unite)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def set_contents(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    inner = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("set_id"), F.lit(ETYPES["ENTITYSET"]).alias("etype"), F.col("n_nationkey").cast("long").alias("id"))
    own = customer.select(F.col("c_nationkey").cast("long").alias("set_id"), F.lit(0).alias("etype"), F.col("c_custkey").alias("id"))
    return sets.contents(inner.unionByName(own), spark.range(1001, 1002).withColumnRenamed("id", "set_id")).select("id")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS new_id FROM part")
def reorder_ids(spark, sf_dir):
    return sets.reorder(table(spark, sf_dir, "part").select(F.lit(0).alias("etype"), F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))).select("id", "new_id")


@query(f"WITH {_V} SELECT id, min(id) OVER (PARTITION BY x, z) AS keep FROM v")
def merge_coincident(spark, sf_dir):
    return sets.merge_coincident(orders_mesh(spark, sf_dir).vertex.withColumn("y", F.lit(0.0)), 0.5)


@query(f"WITH {_EV}, {_V} SELECT ev.id, min(x) AS xlo, max(x) AS xhi, min(y) AS ylo, max(y) AS yhi, min(z) AS zlo, max(z) AS zhi FROM ev JOIN v ON v.id = vid GROUP BY ev.id")
def bounding_boxes(spark, sf_dir):
    return spatial.boxes(orders_mesh(spark, sf_dir)).drop("etype")


@query(f"""WITH {_P}, b AS (SELECT i + 1 AS id, i % 20 AS x, (i // 20) % 20 AS y, i // 400 AS z FROM range(8000) t(i))
SELECT pid, min(b.id) AS id FROM p LEFT JOIN b ON p.x BETWEEN b.x AND b.x + 1 AND p.y BETWEEN b.y AND b.y + 1 AND p.z BETWEEN b.z AND b.z + 1 GROUP BY pid""")
def locate_points(spark, sf_dir):
    return spatial.locate(_points(spark, sf_dir), spatial.boxes(brick(spark, 20)), 1.0)


@query(f"WITH {_P}, {_V} SELECT pid, id, round((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z), 6) AS d2 FROM p JOIN v ON (v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z) <= 2.25")
def within_distance(spark, sf_dir):
    return spatial.within(_points(spark, sf_dir), orders_mesh(spark, sf_dir).vertex, 1.5).withColumn("d2", F.round("d2", 6))


@query(f"WITH {_P}, {_V}, d AS (SELECT pid, round((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z), 6) AS d2 FROM p, v) SELECT pid, min(d2) AS d2 FROM d GROUP BY pid")
def nearest_vertex(spark, sf_dir):
    return spatial.nearest(_points(spark, sf_dir), orders_mesh(spark, sf_dir).vertex, 2.0, 500.0).select("pid", F.round("d2", 6).alias("d2"))


@query(f"{BRICK} SELECT id, CAST(1 + 0.5 * (z % 2) AS DOUBLE) AS size FROM b")
def brick_volumes(spark, sf_dir):
    """Sizes of cells whose layers are 1 and 1.5 thick in turn and lean over."""
    mesh = brick(spark, brick_size(spark, sf_dir))
    lean = mesh.vertex.withColumn("x", F.col("x") + 0.3 * F.col("z")).withColumn("z", F.col("z") + 0.5 * F.floor(F.col("z") / 2))
    rows = measure.with_points(Mesh(lean, mesh.elem))
    return rows.select("id", F.round(measure.measure(F.col("etype"), F.col("p")), 9).alias("size"))


_GRIDS = """c AS (SELECT greatest(2, CAST(floor(sqrt(count(*) + 0.5)) AS BIGINT)) AS a FROM customer), d AS (SELECT greatest(2, CAST(floor(sqrt(3 * count(*) + 0.5)) AS BIGINT)) AS b FROM supplier),
s AS (SELECT i AS id, (i % a) / a::DOUBLE AS x, (i // a) / a::DOUBLE AS y, 1 / a::DOUBLE AS w, i % a + 2 * (i // a) AS f FROM (SELECT unnest(range(a * a)) AS i, a FROM c)),
g AS (SELECT i AS id, (i % b) / b::DOUBLE AS x, (i // b) / b::DOUBLE AS y, 1 / b::DOUBLE AS w FROM (SELECT unnest(range(b * b)) AS i, b FROM d)),
o AS (SELECT s.id AS src, g.id AS tgt, f, g.w * g.w AS whole, (least(s.x + s.w, g.x + g.w) - greatest(s.x, g.x)) * (least(s.y + s.w, g.y + g.w) - greatest(s.y, g.y)) AS area
 FROM s JOIN g ON least(s.x + s.w, g.x + g.w) - greatest(s.x, g.x) > 1e-9 AND least(s.y + s.w, g.y + g.w) - greatest(s.y, g.y) > 1e-9)"""


def _root(count: int) -> int:
    return max(2, int((count + 0.5) ** 0.5))


def _overlap(spark, sf_dir):
    a, b = _root(table(spark, sf_dir, "customer").count()), _root(3 * table(spark, sf_dir, "supplier").count())
    return a, measure.overlaps(squares(spark, a), squares(spark, b), 1 / min(a, b))


@query(f"WITH {_GRIDS} SELECT src, tgt, round(area, 9) AS area FROM o")
def mesh_overlap(spark, sf_dir):
    return _overlap(spark, sf_dir)[1].select("src", "tgt", F.round("area", 9).alias("area"))


@query(f"WITH {_GRIDS} SELECT tgt AS id, round(sum(area * f / whole), 6) AS value FROM o GROUP BY tgt")
def remap_field(spark, sf_dir):
    a, overlap = _overlap(spark, sf_dir)
    field = spark.range(a * a).select("id", (F.col("id") % a + 2 * F.floor(F.col("id") / a)).alias("value"))
    return measure.apply_weights(measure.weights(overlap), field).select("id", F.round("value", 6).alias("value"))


@query(f"WITH {_GRIDS} SELECT src AS id, round(sum(area), 6) AS value FROM o GROUP BY src")
def remap_transposed(spark, sf_dir):
    """Target areas carried back by the transposed weights: what each source cell covers."""
    a, overlap = _overlap(spark, sf_dir)
    overlap = written(overlap, "overlap")  # three plans read it
    own = overlap.groupBy(F.col("tgt").alias("id")).agg(F.sum("area").alias("value"))
    return measure.apply_weights(measure.weights(overlap), own, transpose=True).select("id", F.round("value", 6).alias("value"))


_PART = f"WITH {_EV}, vp AS (SELECT DISTINCT vid, id % 7 AS part FROM ev)"


def _parted(spark, sf_dir) -> tuple[Mesh, DataFrame]:
    mesh = orders_mesh(spark, sf_dir)
    return mesh, mesh.elem.select("etype", "id", (F.col("id") % 7).alias("value"))


@query(f"{_PART} SELECT vid, min(part) AS owner, count(*) AS n_parts FROM vp GROUP BY vid HAVING count(*) > 1")
def shared_vertices(spark, sf_dir):
    mesh, part = _parted(spark, sf_dir)
    return parts.shared(mesh.elem, part)


@query(f"{_PART} SELECT part, count(*) AS n FROM (SELECT DISTINCT vp.part, ev.id FROM ev JOIN vp ON vp.vid = ev.vid WHERE ev.id % 7 <> vp.part) GROUP BY part")
def ghost_layer(spark, sf_dir):
    mesh, part = _parted(spark, sf_dir)
    return parts.ghosts(mesh.elem, part).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS id, l_suppkey AS part, sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS value FROM lineitem GROUP BY l_partkey, l_suppkey")
def reduce_tag(spark, sf_dir):
    copies = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("part")).agg(F.sum("l_quantity").alias("value"))
    return parts.reduce_tags(copies)


@query("SELECT l_partkey AS id, l_suppkey AS part, first_value(sum(l_quantity)) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS value FROM lineitem GROUP BY l_partkey, l_suppkey")
def exchange_tag(spark, sf_dir):
    copies = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("part")).agg(F.sum("l_quantity").alias("value"))
    return parts.exchange_tags(copies)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (ORDER BY o_orderkey) AS gid FROM orders")
def global_ids(spark, sf_dir):
    return entities.assign_ids(table(spark, sf_dir, "orders").select(F.lit(4).alias("etype"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))).select("id", "priority", "gid")


@query(f"WITH {_P} SELECT pid, x BETWEEN 0 AND 12 AND y BETWEEN 0 AND 12 AND z BETWEEN 0 AND 12 AS inside FROM p")
def point_in_volume(spark, sf_dir):
    mesh = brick(spark, 12)
    points = _points(spark, sf_dir)
    quads = adjacency.skin(mesh.elem, 2).select(F.monotonically_increasing_id().alias("q"), F.explode(F.array(F.array(F.get("conn", F.lit(0)), F.get("conn", F.lit(1)), F.get("conn", F.lit(2))), F.array(F.get("conn", F.lit(0)), F.get("conn", F.lit(2)), F.get("conn", F.lit(3))))).alias("conn"))
    tri = quads.select(F.lit(ETYPES["TRI"]).alias("etype"), F.xxhash64("conn").alias("id"), "conn")
    corner = measure.with_points(Mesh(mesh.vertex, tri)).select(F.col("id").alias("tid"), *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("abc")])
    return spatial.inside_surface(points, corner, 4.0, 80.0)



def _shapes(spark: SparkSession, sf_dir: str, corners: list[tuple[str, str, str]]) -> DataFrame:
    """(id, p): a shape for each customer, with points from expressions in k."""
    points = ", ".join(f"struct(double({x}) AS x, double({y}) AS y, double({z}) AS z)" for x, y, z in corners)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).selectExpr("k AS id", f"array({points}) AS p")


def _metrics(rows: DataFrame, kind: str, names: str) -> DataFrame:
    met = rows.select("id", quality.measures(kind, F.col("p")).alias("m"))
    return met.select("id", *[F.round(f"m.{n}", 5).alias(n) for n in names.split()])


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 5 AS b FROM customer),
u AS (SELECT id, a, b, sqrt(a * a + b * b) AS c FROM t)
SELECT id, a * b / 2 AS area, round(c / least(a, b), 5) AS edge_ratio, round(sqrt(3) / 6 * c * (a + b + c) / (a * b), 5) AS aspect_ratio, round(c * c * 2 * c * c / 4, 5) AS radius_ratio,
 round(c * c / (sqrt(3) * a * b), 5) AS aspect_frobenius, round(c * c / (sqrt(3) * a * b), 5) AS condition, round(sqrt(3) * a * b / (c * c), 5) AS shape,
 round(a * b * 2 / sqrt(3) / (c * greatest(a, b)), 5) AS scaled_jacobian, round(degrees(atan(least(a, b) / greatest(a, b))), 5) AS minimum_angle FROM u""")
def triangle_quality(spark, sf_dir):
    rows = _shapes(spark, sf_dir, [("0", "0", "k % 3"), ("1 + k % 7", "0", "k % 3"), ("0", "1 + k % 5", "k % 3")])
    return _metrics(rows, "TRI", "area edge_ratio aspect_ratio radius_ratio aspect_frobenius condition shape scaled_jacobian minimum_angle")


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 5 AS b, (c_custkey % 4) / 2.0 AS s FROM customer),
u AS (SELECT *, sqrt(s * s + b * b) AS c, sqrt(greatest((a + s) * (a + s), (a - s) * (a - s)) + b * b) AS d FROM t)
SELECT id, a * b AS area, round(greatest(a, c) * (a + c) / (2 * a * b), 5) AS aspect_ratio, round(s / c, 5) AS skew, 0.0::DOUBLE AS taper, 1.0::DOUBLE AS warpage, round(sqrt(2) * least(a, c) / d, 5) AS stretch,
 a * b AS jacobian, round(b / c, 5) AS scaled_jacobian, round((a * a + c * c) / (2 * a * b), 5) AS condition FROM u""")
def quadrilateral_quality(spark, sf_dir):
    rows = _shapes(spark, sf_dir, [("0", "0", "1"), ("1 + k % 7", "0", "1"), ("1 + k % 7 + (k % 4) / 2", "1 + k % 5", "1"), ("(k % 4) / 2", "1 + k % 5", "1")])
    return _metrics(rows, "QUAD", "area aspect_ratio skew taper warpage stretch jacobian scaled_jacobian condition")


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 5 AS b, 1.0 + c_custkey % 3 AS c FROM customer),
u AS (SELECT *, a * b * c AS j, sqrt(a * a + b * b) AS ab, sqrt(b * b + c * c) AS bc, sqrt(a * a + c * c) AS ac, a * a + b * b + c * c AS q FROM t),
w AS (SELECT *, greatest(ab, bc, ac) AS h, a * b + b * c + a * c + sqrt(a * a * b * b + b * b * c * c + a * a * c * c) AS f FROM u)
SELECT id, round(j / 6, 5) AS volume, j AS jacobian, round(sqrt(2) * j / greatest(j, a * ab * ac, b * ab * bc, c * ac * bc), 5) AS scaled_jacobian, round(h / least(a, b, c), 5) AS edge_ratio,
 round(j * sqrt(q) * f / (6 * j * j), 5) AS radius_ratio, round(sqrt(6) / 12 * h * f / j, 5) AS aspect_ratio, round(pow(sqrt(q / 2), 3) / (sqrt(2) * j), 5) AS aspect_gamma,
 round(1.5 * q / (3 * cbrt(2 * j * j)), 5) AS aspect_frobenius FROM w""")
def tetrahedron_quality(spark, sf_dir):
    rows = _shapes(spark, sf_dir, [("2", "3", "4"), ("3 + k % 7", "3", "4"), ("2", "4 + k % 5", "4"), ("2", "3", "5 + k % 3")])
    return _metrics(rows, "TET", "volume jacobian scaled_jacobian edge_ratio radius_ratio aspect_ratio aspect_gamma aspect_frobenius")


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 7 AS a, 1.0 + c_custkey % 5 AS b, 1.0 + c_custkey % 3 AS c FROM customer)
SELECT id, a * b * c AS volume, 0.0::DOUBLE AS skew, round(sqrt(3) * least(a, b, c) / sqrt(a * a + b * b + c * c), 5) AS stretch, 1.0::DOUBLE AS diagonal, a * b * c AS jacobian FROM t""")
def hexahedron_quality(spark, sf_dir):
    a, b, c = "1 + k % 7", "1 + k % 5", "1 + k % 3"
    base = [("0", "0"), (a, "0"), (a, b), ("0", b)]
    rows = _shapes(spark, sf_dir, [(x, y, z) for z in ("0", c) for x, y in base])
    return _metrics(rows, "HEX", "volume skew stretch diagonal jacobian")
