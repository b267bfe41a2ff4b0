"""Registered queries of entities, sets, tags and remapping that the other registries leave out, over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import sphere
from .functions.vector import from_lon_lat
from .model import ETYPES, Tag
from .operators import adjacency, entities, geometry, parts, remap, sets
from .plans.views import orders_mesh, table
from .registry import _EV, query
from .registry_build import _CUTS, lattice, overlay
from .registry_model import _nations
from .storage import written

POLYGON, SET, EDGE, TRI, VERTEX = (ETYPES[x] for x in ("POLYGON", "ENTITYSET", "EDGE", "TRI", "VERTEX"))


def _customers(spark, sf_dir, etype: int = VERTEX) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit(etype).alias("etype"), F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS set_id FROM customer")
def adjacent_sets(spark, sf_dir):
    """The sets that hold each customer, as adjacency of dimension 4."""
    mesh = replace(orders_mesh(spark, sf_dir), member=_nations(spark, sf_dir))
    return adjacency.adjacent(mesh, _customers(spark, sf_dir), 4).select(F.col("src_id").alias("id"), F.col("id").alias("set_id"))


_NEXT = "n AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)"


@query(f"WITH {_EV}, {_NEXT}, m AS (SELECT a, b, min(x.vid) AS vid FROM n JOIN ev x ON x.id = a JOIN ev y ON y.id = b AND x.vid = y.vid GROUP BY a, b) SELECT n.a, n.b, m.vid FROM n LEFT JOIN m ON m.a = n.a AND m.b = n.b WHERE n.b IS NOT NULL")
def common_vertices(spark, sf_dir):
    """The least part that each order of a customer has in common with the customer's next order."""
    of = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a_id"), F.lead("o_orderkey").over(of).alias("b_id")).filter("b_id is not null")
    pairs = rows.select(F.lit(POLYGON).alias("a_etype"), "a_id", F.lit(POLYGON).alias("b_etype"), "b_id")
    return adjacency.common(orders_mesh(spark, sf_dir), pairs, 0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("id").alias("vid"))


@query("SELECT user_id AS id, p_partkey IS NOT NULL AS valid FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN part ON p_partkey = user_id")
def valid_entities(spark, sf_dir):
    """Whether the numbers of the events' users are vertices of the mesh of parts."""
    wanted = table(spark, sf_dir, "events").select(F.lit(VERTEX).alias("etype"), F.col("user_id").alias("id")).distinct()
    return entities.existing(orders_mesh(spark, sf_dir), wanted).select("id", "valid")


@query("SELECT DISTINCT l_orderkey AS id, l_partkey AS vid FROM lineitem")
def entity_vertices(spark, sf_dir):
    mesh = orders_mesh(spark, sf_dir)
    return entities.vertices(mesh, mesh.elem.select("etype", "id")).select("id", "vid")


@query("SELECT o_orderkey AS id, 'OPEN' AS tag FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'LARGE' FROM orders WHERE o_totalprice > 200000")
def tags_present(spark, sf_dir):
    """The names of the tags of which each order has a value."""
    rows = table(spark, sf_dir, "orders").select(F.lit(POLYGON).alias("etype"), F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    tags = {"OPEN": Tag(rows.filter("o_orderstatus = 'O'").select("etype", "id", "value")), "LARGE": Tag(rows.filter("value > 200000").select("etype", "id", "value"))}
    mesh = replace(orders_mesh(spark, sf_dir), tags=tags)
    return entities.tags_on(mesh, rows.select("etype", "id")).select("id", "tag")


@query("SELECT 'GID' AS tag, 'bigint' AS type, 8 AS bytes, '0' AS \"default\", count(*) AS n FROM customer UNION ALL SELECT 'NAME', 'string', NULL, NULL, count(*) FROM orders UNION ALL SELECT 'NEW', 'double', 8, '1.5', 0")
def tag_information(spark, sf_dir):
    """Type, size, default and number of values of a mesh's tags, one of which was just created."""
    name = orders_mesh(spark, sf_dir).tag("PRIORITY")
    gid = _customers(spark, sf_dir).withColumn("value", F.col("id").cast("long"))
    mesh = replace(orders_mesh(spark, sf_dir), tags={"NAME": name, "GID": Tag(gid, 0)})
    return entities.tag_info(entities.tag_create(mesh, "NEW", "double", 1.5))


@query("SELECT CAST(c_nationkey AS BIGINT) AS set_id, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id FROM customer")
def swapped_members(spark, sf_dir):
    """Every third customer replaced in its set, at its place."""
    pairs = _customers(spark, sf_dir).filter("id % 3 = 0").withColumn("new_id", F.col("id") + 1_000_000)
    return sets.swap(_nations(spark, sf_dir), pairs).select("set_id", "pos", "id")


@query("SELECT CAST(1000 + n_regionkey AS BIGINT) AS set_id, 1 AS hops FROM nation GROUP BY n_regionkey UNION ALL SELECT CAST(n_nationkey AS BIGINT), 2 FROM nation")
def contained_sets(spark, sf_dir):
    """The sets inside a set of regions that hold nations that hold customers, with their depth."""
    nation = table(spark, sf_dir, "nation").select((1000 + F.col("n_regionkey")).cast("long").alias("set_id"), F.col("n_nationkey").cast("long").alias("id"))
    top = nation.select(F.lit(2000).cast("long").alias("set_id"), F.col("set_id").alias("id")).distinct()
    inner = nation.unionByName(top).select("set_id", F.col("id").alias("pos"), F.lit(SET).alias("etype"), "id")
    found = sets.contained(_nations(spark, sf_dir).unionByName(inner), spark.range(1).select(F.lit(2000).cast("long").alias("set_id")))
    return found.filter("hops > 0").select("set_id", F.col("hops").cast("int").alias("hops"))


@query("""WITH m AS (SELECT CAST(c_nationkey AS BIGINT) AS s, c_custkey AS id FROM customer UNION ALL SELECT CAST(c_nationkey AS BIGINT), c_custkey FROM customer WHERE c_custkey % 5 = 0)
SELECT s AS set_id, count(*) AS n, sum(p) AS places FROM (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS p FROM (SELECT DISTINCT s, id FROM m WHERE s % 2 = 0 AND s % 3 <> 0)) GROUP BY s
UNION ALL SELECT s, count(*), sum(id) FROM m WHERE s % 2 = 1 AND s % 3 <> 0 GROUP BY s""")
def sets_by_options(spark, sf_dir):
    """Sets that keep order and repeats, and sets that hold each member once in the order of ids; every third set is emptied."""
    member = _nations(spark, sf_dir)
    member = member.unionByName(member.filter("id % 5 = 0"))
    options = member.select("set_id").distinct().select("set_id", (F.col("set_id") % 2 == 1).alias("ordered"), F.lit(False).alias("tracking"))
    kept = sets.clear(sets.set_options(member, options), options.filter("set_id % 3 = 0"))
    return kept.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("SELECT rn AS id, min(rn) OVER (PARTITION BY least(a, b), greatest(a, b)) AS keep FROM (SELECT l_orderkey * 8 + l_linenumber AS rn, l_suppkey % 40 AS a, l_partkey % 30 AS b FROM lineitem)")
def merged_edges(spark, sf_dir):
    """Lines as edges between few vertices: those on the same two are one, whichever way they run."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(EDGE).alias("etype"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_suppkey") % 40, F.col("l_partkey") % 30).alias("conn"))
    return sets.merge_sides(rows).select("id", "keep")


_FACES = """s AS (SELECT greatest(2, CAST(floor(sqrt(count(*) + 0.5)) AS BIGINT)) AS n FROM customer), c AS (SELECT c_custkey % (n * n) AS q, n, sum(c_nationkey) % 3 > 0 AS here FROM customer, s GROUP BY ALL), f AS (SELECT q % n AS i, q // n AS j, n FROM c WHERE here)"""


@query(f"""WITH {_FACES}, v AS (SELECT i + di AS x, j + dj AS y, n, 1 << (CASE WHEN di = 0 THEN (CASE WHEN dj = 0 THEN 0 ELSE 3 END) ELSE (CASE WHEN dj = 0 THEN 1 ELSE 2 END) END) AS bit FROM f, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj))
SELECT 1 + x + (n + 1) * y AS id FROM v GROUP BY x, y, n HAVING sum(bit) IN (5, 10)""")
def pinched_vertices(spark, sf_dir):
    """Vertices of a lattice with holes at which two faces meet by a corner alone."""
    mesh = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = mesh.elem.count()  # n * n faces, numbered from 0
    here = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % n).alias("id")).agg((F.sum("c_nationkey") % 3 > 0).alias("here")).filter("here")
    return adjacency.nonmanifold_vertices(mesh.elem.join(here.select("id"), "id", "left_semi").select("etype", "id", "conn"))


@query("SELECT c_custkey AS tid, round(-s / sqrt(s * s + a * a), 9) AS x, 0.0::DOUBLE AS y, round(a / sqrt(s * s + a * a), 9) AS z FROM (SELECT c_custkey, 1.0 + c_custkey % 7 AS a, c_nationkey - 0.5 AS s FROM customer)")
def triangle_normals(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("c_nationkey") - 0.5
    at = lambda x, y, z: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    o = F.lit(0.0)
    rows = table(spark, sf_dir, "customer").select(k.alias("tid"), at(o, o, o).alias("a"), at(1.0 + k % 7, o, s).alias("b"), at(o, 2.0 + k % 3, o).alias("c"))
    return geometry.normals(rows).select("tid", *[F.round(F.col(f"normal.{c}") + 0.0, 9).alias(c) for c in "xyz"])


@query("SELECT c_custkey AS id, CASE WHEN m BETWEEN 10 AND 10 + w AND lat > 0 THEN round(cos(radians(m)), 9) END AS x, CASE WHEN m BETWEEN 10 AND 10 + w AND lat > 0 THEN round(sin(radians(m)), 9) END AS y FROM (SELECT c_custkey, 0.5 + c_custkey % 100 AS m, 20 + c_nationkey AS w, c_custkey % 40 - 9.5 AS lat FROM customer)")
def arc_crossings(spark, sf_dir):
    """Where arcs along the equator cross arcs along meridians, if they do."""
    k = F.col("c_custkey")
    lon = lambda d: F.radians(d)
    m, w, lat = 0.5 + k % 100, 20 + F.col("c_nationkey"), k % 40 - 9.5
    a, b = from_lon_lat(lon(F.lit(10.0)), F.lit(0.0)), from_lon_lat(lon(10.0 + w), F.lit(0.0))
    c, d = from_lon_lat(lon(m), lon(F.lit(-30.0))), from_lon_lat(lon(m), lon(lat))
    return table(spark, sf_dir, "customer").select(k.alias("id"), sphere.arcs_meet(a, b, c, d).alias("p")).select("id", F.round("p.x", 9).alias("x"), F.round("p.y", 9).alias("y"))


@query("SELECT round(avg(e), 6) AS l1, round(sqrt(avg(e * e)), 6) AS l2, round(max(e), 6) AS linf, count(*) AS n FROM (SELECT c_custkey % 7 / 10.0 AS e FROM customer)")
def remap_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("value"))
    out = remap.error_norms(rows, rows.withColumn("value", F.col("value") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1) * (F.col("id") % 7) / 10))
    return out.select(F.round("l1", 6).alias("l1"), F.round("l2", 6).alias("l2"), F.round("linf", 6).alias("linf"), "n")


@query("SELECT s_suppkey AS row, c_custkey AS col, 1.0::DOUBLE AS w FROM supplier JOIN customer ON c_custkey * 7 = s_suppkey * 14")
def matched_ids(spark, sf_dir):
    """Weights between suppliers and the customers with the same global id."""
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7).alias("gid"))
    return remap.match_ids(source, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 14).alias("gid")))


@query("""WITH w AS (SELECT l_orderkey AS row, l_linenumber AS col, l_quantity / 10.0 AS w FROM lineitem), a AS (SELECT row, col, max(w) AS w FROM w GROUP BY ALL), b AS (SELECT row, col, w + CASE WHEN row % 5 = 0 THEN 0.25 ELSE 0 END AS w FROM a WHERE col < 5)
SELECT a.row, CAST(a.col AS BIGINT) AS col, round(a.w, 6) AS a, round(b.w, 6) AS b FROM a LEFT JOIN b ON a.row = b.row AND a.col = b.col WHERE b.w IS NULL OR abs(a.w - b.w) > 0.01""")
def compared_maps(spark, sf_dir):
    """Entries in which two sets of weights differ, or that one of them lacks."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.max(F.col("l_quantity") / 10.0).cast("double").alias("w"))
    b = a.filter("col < 5").withColumn("w", F.col("w") + F.when(F.col("row") % 5 == 0, 0.25).otherwise(0.0))
    return remap.compare_maps(a, b, 0.01).select("row", "col", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""{_CUTS}, m AS (SELECT x.t + nb.n * y.t AS id, x.s + na.n * y.s AS src, (x.hi - x.lo) * (y.hi - y.lo) AS area FROM o x, o y, na, nb) SELECT id, round(sum(area * (src % 10)) / sum(area), 6) AS value FROM m GROUP BY id""")
def advected_means(spark, sf_dir):
    """Means over the overlap mesh of two lattices of a value of each source face."""
    source, target = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lattice(spark, sf_dir, "part", "p_partkey", "p_size")
    out = overlay.overlay(source, target, 5.0)
    values = source.elem.select("id", (F.col("id") % 10).cast("double").alias("value"))
    return remap.advected(out.parents, values).select("id", F.round("value", 6).alias("value"))


@query(f"{_CUTS} SELECT DISTINCT x.s + na.n * y.s AS id FROM o x, o y, na, nb")
def covering_faces(spark, sf_dir):
    """The faces of one lattice whose boxes touch the other's, of those that lean alike: at least all that overlap it."""
    source, target = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lattice(spark, sf_dir, "part", "p_partkey", "p_size")
    enough = overlay.covering(source, target, 5.0)
    kept = replace(source, elem=source.elem.join(enough, "id", "left_semi").select("etype", "id", "conn"))
    return overlay.overlay(kept, target, 5.0).parents.select(F.col("src").alias("id")).distinct()


@query("SELECT 'vertex' AS kind, count(*) AS n FROM part UNION ALL SELECT 'face', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'solid', 0")
def counts_by_dimension(spark, sf_dir):
    mesh = orders_mesh(spark, sf_dir)
    out = [entities.by_dimension(mesh, d).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for d, k in ((0, "vertex"), (2, "face"), (3, "solid"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem) SELECT a, b FROM e WHERE (a + b) % 4 <> 0""")
def explicit_pairs(spark, sf_dir):
    """Orders made adjacent to suppliers by hand, a quarter of the pairs taken back, asked from the orders."""
    pairs = table(spark, sf_dir, "lineitem").select(F.lit(POLYGON).alias("src_etype"), F.col("l_orderkey").alias("src_id"), F.lit(TRI).alias("etype"), F.col("l_suppkey").alias("id"))
    explicit = adjacency.add_explicit(pairs.limit(0), pairs)
    gone = pairs.filter((F.col("src_id") + F.col("id")) % 4 == 0).select(F.col("etype").alias("src_etype"), F.col("id").alias("src_id"), F.col("src_etype").alias("etype"), F.col("src_id").alias("id"))
    explicit = written(adjacency.remove_explicit(explicit, gone), "explicit")
    mesh = orders_mesh(spark, sf_dir)
    found = adjacency.adjacent(mesh, mesh.elem.select("etype", "id"), 2, explicit=explicit)
    return found.filter(F.col("etype") == TRI).select(F.col("src_id").alias("a"), F.col("id").alias("b"))


@query("SELECT c_custkey % 5 AS part, c_custkey AS id, 1 + CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN c_nationkey % 3 = 0 THEN 4 ELSE 0 END AS status FROM customer WHERE c_nationkey % 2 = 0 OR c_nationkey % 3 = 0")
def status_bits(spark, sf_dir):
    """Entities with any of two bits of their status."""
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select((k % 5).alias("part"), F.lit(0).alias("etype"), k.alias("id"), (1 + F.when(c % 2 == 0, 2).otherwise(0) + F.when(c % 3 == 0, 4).otherwise(0)).alias("status"))
    return parts.with_status(rows, 6, "OR").select("part", "id", "status")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, round(2 + cos(b) * cos(b) * cos(2 * a), 6) AS value FROM (SELECT c_custkey, radians(c_custkey % 350 + 0.5) AS a, radians(c_custkey % 160 - 79.5) AS b FROM customer)")
def analytic_field(spark, sf_dir):
    """A known field at the middle of small cells around places that the customers' numbers name."""
    k = F.col("c_custkey")
    lon, lat, d = F.radians(k % 350 + 0.5), F.radians(k % 160 - 79.5), 1e-7
    poly = F.array(*[from_lon_lat(lon + u * d, lat + v * d).struct() for u, v in ((-1, 0), (0, -1), (1, 0), (0, 1))])
    cells = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), poly.alias("poly"))
    return remap.analytic(cells, "wave").select("id", F.round("value", 6).alias("value"))
