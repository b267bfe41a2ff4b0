"""More registered queries: tags, sets, adjacency, partitions, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import numbering
from .model import ETYPES, Mesh, Tag, elem_vertex
from .operators import adjacency, entities, parts, refine, sets
from .plans.views import brick, brick_size, orders_mesh, table
from .registry import _EDGES, _EV, _PART, _V, BRICK, _parted, query
from .sources import gmsh, layout, obj, stl, vtk
from .storage import new_path
from .streaming import taglog

HEX, QUAD, POLYGON, SET = (ETYPES[x] for x in ("HEX", "QUAD", "POLYGON", "ENTITYSET"))


def _ids(rows, etype: int, column: str, name: str = "id"):
    return rows.select(F.lit(etype).alias("etype"), F.col(column).cast("long").alias(name))


def _nations(spark, sf_dir):
    """Members (set_id, pos, etype, id): customers in the sets of their nations."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("set_id"), F.col("c_custkey").alias("pos"), F.lit(0).alias("etype"), F.col("c_custkey").alias("id"))


@query("SELECT c_custkey AS id, n_regionkey AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def propagate_tag(spark, sf_dir):
    values = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("set_id"), F.col("n_regionkey").alias("value"))
    return entities.propagate(_nations(spark, sf_dir), values).select("id", "value")


@query("""SELECT 'set' AS op, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS value FROM orders
UNION ALL SELECT 'clear', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE o_orderstatus END FROM orders
UNION ALL SELECT 'delete', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0""")
def tag_edits(spark, sf_dir):
    tag = orders_mesh(spark, sf_dir).tag("STATUS")
    third = tag.values.filter("id % 3 = 0")
    twice = third.withColumn("value", F.lit("X")).unionByName(third.withColumn("value", F.lit("W")))
    named = {"set": entities.tag_set(tag, twice), "clear": entities.tag_clear(tag, third, "Y"), "delete": entities.tag_delete(tag, third)}
    out = [t.values.select(F.lit(k).alias("op"), "id", "value") for k, t in named.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 'STATUS' AS tag, 4 AS etype, count(*) AS n FROM orders UNION ALL SELECT 'PRIORITY', 4, count(*) FROM orders")
def tag_counts(spark, sf_dir):
    return entities.tag_counts(orders_mesh(spark, sf_dir))


@query("SELECT doc_id AS id, quality AS a, toxic AS b FROM labels WHERE quality IS DISTINCT FROM toxic")
def compare_tags(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    a, b = (Tag(labels.select(F.lit(0).alias("etype"), F.col("doc_id").alias("id"), F.col(c).alias("value"))) for c in ("quality", "toxic"))
    return entities.compare_tags(a, b).select("id", "a", "b")


@query(f"WITH {_EV} SELECT id, pos, vid FROM ev WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_elements(spark, sf_dir):
    mesh = orders_mesh(spark, sf_dir)
    gone = entities.by_type_and_tag(mesh, "POLYGON", {"STATUS": "F"})
    return elem_vertex(entities.delete(mesh, gone).elem).select("id", F.col("pos").cast("long").alias("pos"), "vid")


@query(f"WITH {_EV} SELECT id, pos, CASE WHEN vid % 5 = 4 THEN vid - 4 ELSE vid END AS vid FROM ev")
def replace_vertices(spark, sf_dir):
    mesh = orders_mesh(spark, sf_dir)
    keep = F.when(F.col("id") % 5 == 4, F.col("id") - 4).otherwise(F.col("id"))
    return elem_vertex(entities.replace_vertices(mesh, mesh.vertex.select("id", keep.alias("keep"))).elem).select("id", F.col("pos").cast("long").alias("pos"), "vid")


@query(f"WITH {_V} SELECT id, x + CASE WHEN id % 2 = 0 THEN 100 ELSE 0 END AS x, y, z FROM v")
def move_vertices(spark, sf_dir):
    mesh = orders_mesh(spark, sf_dir)
    moved = mesh.vertex.filter("id % 2 = 0").withColumn("x", F.col("x") + 100)
    return entities.set_coords(mesh, moved).vertex


@query(f"WITH {_V}, top AS (SELECT max(id) AS t FROM v) SELECT id, x, y, z FROM v UNION ALL SELECT t + row_number() OVER (ORDER BY s_suppkey), CAST(s_suppkey AS DOUBLE), 1.0, 2.0 FROM supplier, top")
def create_vertices(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    return entities.create_vertices(orders_mesh(spark, sf_dir), points).vertex


@query("SELECT c_nationkey AS set_id FROM customer WHERE c_custkey IN (5, 6, 7) GROUP BY c_nationkey")
def sets_with_any(spark, sf_dir):
    wanted = spark.range(5, 8).select(F.lit(0).alias("etype"), "id")
    return sets.contains(_nations(spark, sf_dir), wanted, "UNION").select(F.col("set_id").cast("int").alias("set_id"))


@query("""WITH m AS (SELECT c_nationkey AS s, c_custkey AS id FROM customer), f AS (SELECT id FROM m WHERE s = (SELECT s FROM m WHERE id = 5) ORDER BY id LIMIT 2)
SELECT CAST(s AS BIGINT) AS set_id FROM m WHERE id IN (SELECT id FROM f) GROUP BY s HAVING count(*) = 2""")
def sets_with_all(spark, sf_dir):
    member = _nations(spark, sf_dir)
    home = member.filter("id = 5").select("set_id")
    wanted = member.join(home, "set_id", "left_semi").orderBy("id").limit(2)
    return sets.contains(member, wanted.select("etype", "id"))


@query("""SELECT 'add' AS op, CAST(s AS BIGINT) AS set_id, count(*) AS n FROM (SELECT c_nationkey AS s, c_custkey FROM customer UNION SELECT 0, c_custkey FROM customer) GROUP BY s
UNION ALL SELECT 'remove', c_nationkey, count(*) FROM customer WHERE c_custkey % 2 = 1 GROUP BY c_nationkey
UNION ALL SELECT 'ordered', c_nationkey, 2 * count(*) FROM customer GROUP BY c_nationkey""")
def set_edits(spark, sf_dir):
    member = _nations(spark, sf_dir)
    even = member.filter("id % 2 = 0")
    named = {"add": sets.add(member, member.withColumn("set_id", F.lit(0).cast("long"))), "remove": sets.remove(member, even), "ordered": sets.add(member, member, ordered=True)}
    out = [rows.groupBy("set_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "set_id", "n") for k, rows in named.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT CAST(1000 AS BIGINT) AS start, CAST(n_regionkey + 1000 AS BIGINT) AS set_id, 1 AS hops FROM nation GROUP BY n_regionkey
UNION ALL SELECT 1000, CAST(n_nationkey AS BIGINT), 2 FROM nation""")
def set_descendants(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = nation.select(F.lit(1000 - 1).cast("long").alias("parent_id"), (F.col("n_regionkey") + 1000).cast("long").alias("child_id"))
    link = sets.add_links(region, nation.select((F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("child_id")))
    start = spark.range(999, 1000).withColumnRenamed("id", "set_id")
    return sets.hops(link, start).select(F.lit(1000).cast("long").alias("start"), "set_id", "hops")


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS keep FROM part")
def merge_by_tag(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("etype"), F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_size").alias("value"))
    return sets.merge_by_value(rows).select("id", "keep")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS new_id FROM customer")
def order_by_sets(spark, sf_dir):
    member = _nations(spark, sf_dir)
    return sets.reorder(sets.order_from_sets(member, member)).select("id", "new_id")


@query(f"WITH {_EV}, o AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size, p_partkey) AS new_id FROM part) SELECT ev.id, pos, new_id AS vid FROM ev JOIN o ON o.id = vid")
def apply_order(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(F.lit(0).alias("etype"), F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))
    return elem_vertex(sets.apply_order(orders_mesh(spark, sf_dir), sets.reorder(values)).elem).select("id", F.col("pos").cast("long").alias("pos"), "vid")


@query("SELECT DISTINCT o_custkey AS id, dense_rank() OVER (ORDER BY o_custkey) - 1 AS pos FROM orders")
def set_index(spark, sf_dir):
    return sets.indexed(_ids(table(spark, sf_dir, "orders"), 0, "o_custkey")).select("id", "pos")


@query(f"{BRICK} SELECT 1 AS n_up, 6 * n * n AS n FROM s UNION ALL SELECT 2, 3 * n * n * (n - 1) FROM s")
def face_valence(spark, sf_dir):
    mesh = adjacency.construct(brick(spark, brick_size(spark, sf_dir)), 2)
    faces = mesh.elem.filter(F.col("etype") == QUAD)
    up = adjacency.adjacent(mesh, faces, 3).groupBy("src_id").agg(F.count("*").cast("int").alias("n_up"))
    return up.groupBy("n_up").agg(F.count("*").alias("n"))


@query(f"{BRICK} SELECT id, (CASE WHEN x = 0 THEN 0 ELSE 1 END + CASE WHEN y = 0 THEN 0 ELSE 1 END + CASE WHEN z = 0 THEN 0 ELSE 1 END) AS n FROM b WHERE x + y + z > 0")
def cell_lower_faces(spark, sf_dir):
    """Of each cell the faces that it shares with a cell of lesser id, by adjacency from cells to faces to cells."""
    mesh = adjacency.construct(brick(spark, brick_size(spark, sf_dir)), 2)
    cells = mesh.elem.filter(F.col("etype") == HEX)
    down = adjacency.adjacent(mesh, cells, 2).select(F.col("src_id").alias("cell"), "etype", "id")
    other = down.select(F.col("cell").alias("other"), "etype", "id")
    return down.join(other, ["etype", "id"]).filter("other < cell").groupBy(F.col("cell").alias("id")).agg(F.count("*").cast("int").alias("n"))


@query(f"{BRICK} SELECT id FROM b WHERE x = 0 AND y = 0 AND z IN (0, 1)")
def cells_at_all(spark, sf_dir):
    """Cells with both ends of the first edge along x of the second layer of vertices."""
    n = brick_size(spark, sf_dir)
    m = n + 1
    mesh = brick(spark, n)
    ends = spark.createDataFrame([(0, 1 + m * m), (0, 2 + m * m)], "etype int, id long")
    return adjacency.adjacencies(mesh, ends, 3).select("id")


@query(f"{BRICK} SELECT id, 1 + least(x, y, z, n - 1 - x, n - 1 - y, n - 1 - z) AS layer FROM b")
def depth_layers(spark, sf_dir):
    n = brick_size(spark, sf_dir)
    return adjacency.depth(brick(spark, n).elem, 2, (n + 1) // 2 + 1).select("id", F.col("layer").cast("long").alias("layer"))


@query(f"WITH {_EV}, {_EDGES} SELECT lo, hi FROM e GROUP BY lo, hi HAVING count(*) = 1")
def manifold_edges(spark, sf_dir):
    rows = adjacency.manifold(orders_mesh(spark, sf_dir).elem, 1)
    return rows.select(F.get("key", F.lit(0)).alias("lo"), F.get("key", F.lit(1)).alias("hi"))


@query(f"{BRICK} SELECT 2 * 3 * n * n * (n - 1) AS n, 0 AS odd FROM s")
def sibling_faces(spark, sf_dir):
    """How many face sides have a sibling, and for how many the sibling of the sibling is another side."""
    rows = adjacency.siblings(brick(spark, brick_size(spark, sf_dir)).elem, 2)
    back = rows.select(F.col("id").alias("other_id"), F.col("side").alias("other_side"), F.col("other_id").alias("b_id"), F.col("other_side").alias("b_side"))
    met = rows.join(back, ["other_id", "other_side"])
    return met.agg(F.count("*").alias("n"), F.count_if((F.col("id") != F.col("b_id")) | (F.col("side") != F.col("b_side"))).cast("int").alias("odd"))


@query(f"{BRICK} SELECT 12 * n AS n, round(pi() / 2, 6) AS angle FROM s")
def sharp_edges(spark, sf_dir):
    mesh = brick(spark, brick_size(spark, sf_dir))
    skin = adjacency.skin(mesh.elem, 2).select("conn").withColumn("id", F.xxhash64("conn")).select(F.lit(QUAD).alias("etype"), "id", "conn")
    return adjacency.sharp_edges(Mesh(mesh.vertex, skin), 0.5).agg(F.count("*").alias("n"), F.round(F.max("angle"), 6).alias("angle"))


@query(f"{BRICK} SELECT valence, n FROM (SELECT CAST(3 AS BIGINT) AS valence, CAST(8 AS BIGINT) AS n UNION ALL SELECT 4, 6 * n * n + 2 - 8 FROM s)")
def vertex_stars(spark, sf_dir):
    """Valences of the skin's vertices; each star is one closed fan in which neighbours share an edge."""
    elem = adjacency.skin(brick(spark, brick_size(spark, sf_dir)).elem, 2).select(F.lit(QUAD).alias("etype"), F.xxhash64("conn").alias("id"), "conn")
    each = adjacency.stars(elem).filter("closed and fans = 1").groupBy("vid").agg(F.count("*").alias("valence"))
    return each.groupBy("valence").agg(F.count("*").alias("n"))


@query(f"{BRICK} SELECT side, sense, n * n * n AS n FROM s, (SELECT unnest(range(6)) AS side), (SELECT unnest([1, -1]) AS sense)")
def side_numbers(spark, sf_dir):
    """The side and sense of each cell's faces, once as they are and once turned round."""
    elem = brick(spark, brick_size(spark, sf_dir)).elem
    rows = elem.select("etype", "conn", F.explode(numbering.sides(F.col("etype"), F.col("conn"), 2)).alias("child"))
    both = rows.unionByName(rows.withColumn("child", F.reverse("child")))
    found = both.select(numbering.side_number(F.col("etype"), F.col("conn"), F.col("child"), 2).alias("s"))
    return found.groupBy(F.col("s.side").cast("long").alias("side"), F.col("s.sense").cast("int").alias("sense")).agg(F.count("*").alias("n"))


@query(f"{_PART}, g AS (SELECT vid, string_agg(part, ',' ORDER BY part) AS parts FROM vp GROUP BY vid HAVING count(*) > 1) SELECT parts, count(*) AS n FROM g GROUP BY parts")
def part_interfaces(spark, sf_dir):
    mesh, part = _parted(spark, sf_dir)
    return parts.interfaces(mesh.elem, part).select(F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"), "n")


def _halves(spark, sf_dir):
    """The brick, with its cells in two parts, by x."""
    n = brick_size(spark, sf_dir)
    mesh = brick(spark, n)
    return mesh, mesh.elem.select("etype", "id", ((F.col("id") - 1) % n >= n // 2).cast("int").alias("value"))


@query(f"""{BRICK}, p AS (SELECT id, x, CASE WHEN x >= n // 2 THEN 0 ELSE 1 END AS part, CASE WHEN x >= n // 2 THEN x - n // 2 + 1 ELSE n // 2 - x END AS layer FROM b)
SELECT part, id, layer FROM p WHERE layer <= 2""")
def ghost_layers(spark, sf_dir):
    mesh, part = _halves(spark, sf_dir)
    return parts.ghosts(mesh.elem, part, layers=2, bridge_dim=2).select("part", "id", F.col("layer").cast("long").alias("layer"))


@query(f"""{BRICK}, c AS (SELECT CASE WHEN x >= n // 2 THEN 1 ELSE 0 END AS part, CASE WHEN x = n // 2 OR x = n // 2 - 1 THEN 2 ELSE 0 END AS status FROM b
 UNION ALL SELECT CASE WHEN x >= n // 2 THEN 0 ELSE 1 END, 2 + 16 + 1 FROM b WHERE x = n // 2 OR x = n // 2 - 1),
 v AS (SELECT unnest(range(n + 1)) AS x, n FROM s), w AS (SELECT CASE WHEN x < n // 2 THEN 0 ELSE 1 END AS part, CASE WHEN x = n // 2 THEN 11 ELSE 0 END AS status, (n + 1) * (n + 1) AS k FROM v UNION ALL SELECT 0, 10, (n + 1) * (n + 1) FROM s)
SELECT part, status, CAST(sum(k) AS BIGINT) AS n FROM (SELECT part, status, 1 AS k FROM c UNION ALL SELECT part, status, k FROM w) GROUP BY part, status""")
def part_status(spark, sf_dir):
    mesh, part = _halves(spark, sf_dir)
    rows = parts.status(mesh.elem, part, parts.ghosts(mesh.elem, part, bridge_dim=2))
    return rows.groupBy("part", "status").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey % 4 AS sender, c_custkey % 4 AS receiver, count(*) AS n FROM customer GROUP BY ALL")
def part_migration(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    old, new = (rows.select(F.lit(0).alias("etype"), F.col("c_custkey").alias("id"), v.cast("long").alias("value")) for v in (F.col("c_nationkey") % 4, F.col("c_custkey") % 4))
    return parts.migration(old, new).select(F.col("sender").cast("int").alias("sender"), "receiver", "n")


@query("SELECT CAST(c_nationkey AS BIGINT) AS set_id, min(c_custkey % 5) AS owner, count(DISTINCT c_custkey % 5) AS n_parts FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey % 5) > 1")
def shared_sets(spark, sf_dir):
    member = _nations(spark, sf_dir)
    return parts.shared_sets(member, member.select("etype", "id", (F.col("id") % 5).alias("value")))


@query("SELECT o_orderkey AS id, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders")
def even_blocks(spark, sf_dir):
    return refine.blocks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"], 7)


@query("""WITH p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x FROM customer), a AS (SELECT *, CASE WHEN x > (SELECT quantile_disc(x, 0.5) FROM p) THEN 1 ELSE 0 END AS h FROM p)
SELECT id, CAST(2 * h + CASE WHEN x > quantile_disc(x, 0.5) OVER (PARTITION BY h) THEN 1 ELSE 0 END AS BIGINT) AS part FROM a""")
def bisection(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1009).cast("double").alias("x"))
    return refine.cut(rows, ["x"], 2).select("id", "part")


@query("SELECT user_id AS id, event_type AS value FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def latest_tag(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("etype"), F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("value"))
    return taglog.latest(rows).select("id", "value")


_PAIRS = f"WITH {_EV}, n AS (SELECT id FROM ev GROUP BY id HAVING count(*) >= 3)"


def _faces(spark, sf_dir):
    """Orders of three lines and more as polygons, over all parts."""
    mesh = orders_mesh(spark, sf_dir)
    return Mesh(mesh.vertex, mesh.elem.filter(F.size("conn") >= 3), mesh.tags)


@query(f"{_PAIRS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n), p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT o.k AS id, pos, p.k AS vid FROM ev JOIN o ON o.id = ev.id JOIN p ON p.id = ev.vid")
def vtk_round_trip(spark, sf_dir):
    path = new_path(spark, "vtk")
    vtk.write(_faces(spark, sf_dir), path)
    return elem_vertex(vtk.read(spark, path).elem).select("id", F.col("pos").cast("long").alias("pos"), "vid")


@query(f"{_PAIRS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n), p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT o.k AS id, pos, p.k AS vid FROM ev JOIN o ON o.id = ev.id JOIN p ON p.id = ev.vid")
def obj_round_trip(spark, sf_dir):
    path = new_path(spark, "obj")
    mesh = _faces(spark, sf_dir)
    obj.write(mesh, path)
    return elem_vertex(obj.read(spark, path).elem).select("id", F.col("pos").cast("long").alias("pos"), "vid")


@query(f"{BRICK} SELECT id, 1 + x + (n + 1) * y + (n + 1) * (n + 1) * z AS first, id % 3 AS material FROM b")
def gmsh_round_trip(spark, sf_dir):
    path = new_path(spark, "gmsh")
    mesh = brick(spark, brick_size(spark, sf_dir))
    gmsh.write(Mesh(mesh.vertex, mesh.elem, {"M": Tag(mesh.elem.select("etype", "id", (F.col("id") % 3).alias("value")))}), path, "M")
    again = gmsh.read(spark, path)
    return entities.tag_data(again.elem, again.tag("MATERIAL_SET")).select("id", F.get("conn", F.lit(0)).alias("first"), F.col("value").alias("material"))


@query(f"{BRICK}, v AS (SELECT unnest(range((n + 1) * (n + 1) * (n + 1))) AS i, n + 1 AS m FROM s), w AS (SELECT i % m AS x, (i // m) % m AS y, i // (m * m) AS z, m FROM v) SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM w WHERE x IN (0, m - 1) OR y IN (0, m - 1) OR z IN (0, m - 1)")
def stl_round_trip(spark, sf_dir):
    """The vertices of a brick's skin, written as triangles and read back."""
    path = new_path(spark, "stl")
    mesh = brick(spark, brick_size(spark, sf_dir))
    skin = adjacency.skin(mesh.elem, 2).select(F.explode(F.array(*[F.array(*[F.get("conn", F.lit(i)) for i in t]) for t in ((0, 1, 2), (0, 2, 3))])).alias("conn"))
    stl.write(Mesh(mesh.vertex, skin.select(F.lit(ETYPES["TRI"]).alias("etype"), F.xxhash64("conn").bitwiseAND(F.lit((1 << 58) - 1)).alias("id"), "conn")), path)
    return stl.read(spark, path).vertex.select(*"xyz")


def _stored(spark, sf_dir) -> str:
    """A folder with orders as polygons, in sets by status (1, 2, 3), each tagged MATERIAL with its number."""
    mesh = orders_mesh(spark, sf_dir)
    kind = F.when(F.col("value") == "F", 1).when(F.col("value") == "O", 2).otherwise(3).cast("long")
    member = mesh.tag("STATUS").values.join(mesh.elem.select("etype", "id"), ["etype", "id"]).select(kind.alias("set_id"), F.col("id").alias("pos"), "etype", "id")
    material = Tag(spark.range(1, 4).select(F.lit(SET).alias("etype"), "id", F.col("id").cast("int").alias("value")))
    path = new_path(spark, "layout")
    layout.write(Mesh(mesh.vertex, mesh.elem, {"MATERIAL": material, "PRIORITY": mesh.tag("PRIORITY")}, member, spark.range(0).selectExpr("id AS parent_id", "id AS child_id")), path)
    return path


@query(f"WITH {_EV}, f AS (SELECT ev.id, ev.vid, o_orderpriority FROM ev JOIN orders ON o_orderkey = ev.id WHERE o_orderstatus = 'F') SELECT 'element' AS kind, id, any_value(o_orderpriority) AS value FROM f GROUP BY id UNION ALL SELECT DISTINCT 'vertex', vid, NULL FROM f")
def read_by_set(spark, sf_dir):
    mesh = layout.read_sets(spark, _stored(spark, sf_dir), {"MATERIAL": [1]}, tags={"PRIORITY": None})
    cells = entities.tag_data(mesh.elem, mesh.tag("PRIORITY")).select(F.lit("element").alias("kind"), "id", "value")
    return cells.unionByName(mesh.vertex.select(F.lit("vertex").alias("kind"), "id", F.lit(None).cast("string").alias("value")))
