"""Registered queries that build meshes: overlaps, cuts, refinement, reconstruction, partitions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import polyhedron, shape
from .functions.numbering import positions_of
from .functions.vector import Vec
from .model import ETYPES, Mesh, elem_vertex
from .operators import adapt, adjacency, dual, measure, obb, overlay, partition, reconstruct, refine, spectral, split
from .plans.views import brick, brick_size, table
from .registry import BRICK, query
from .sources import cards, gmsh, lines, smf
from .storage import new_path, written

# Lines across the plane whose distances come from a table: as many as the square root of its rows, each wider
# by what its rows add up to.
_LINES = """{0} AS (SELECT i, CAST(sum(w) OVER (ORDER BY i) AS DOUBLE) - w AS lo, CAST(sum(w) OVER (ORDER BY i) AS DOUBLE) AS hi
  FROM (SELECT {1} % n AS i, 1 + CAST(sum({2}) AS BIGINT) % 3 AS w FROM {3}, (SELECT greatest(2, CAST(floor(sqrt(count(*) + 0.5)) AS BIGINT)) AS n FROM {3}) GROUP BY ALL))"""
_A, _B = _LINES.format("a", "c_custkey", "c_nationkey", "customer"), _LINES.format("b", "p_partkey", "p_size", "part")
#: The plane leans: (x, y) goes to (x + LEAN_X * y, y + LEAN_Y * x), which no count of overlaps notices.
LEAN_X, LEAN_Y = 0.3, 0.2


def lattice(spark, sf_dir: str, name: str, key: str, of: str) -> Mesh:
    """Parallelograms between leaning lines; face i + n * j, vertex i + (n + 1) * j from 1."""
    rows = table(spark, sf_dir, name)
    n = rows.agg(F.greatest(F.lit(2), F.floor(F.sqrt(F.count("*") + 0.5))).alias("n")).first()[0]
    width = rows.groupBy((F.col(key) % n).alias("i")).agg((1 + F.sum(F.col(of).cast("long")) % 3).alias("w"))
    line = width.select("i", F.sum("w").over(Window.orderBy("i")).alias("hi"))  # one row a line, the square root of the rows
    line = line.select((F.col("i") + 1).alias("i"), F.col("hi").cast("double").alias("at")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("at")))
    grid = spark.range((n + 1) * (n + 1)).select((F.col("id") + 1).alias("id"), (F.col("id") % (n + 1)).alias("i"), F.floor(F.col("id") / (n + 1)).alias("j"))
    x, y = line.select("i", F.col("at").alias("u")), line.select(F.col("i").alias("j"), F.col("at").alias("v"))
    vertex = grid.join(x, "i").join(y, "j").select("id", (F.col("u") + LEAN_X * F.col("v")).alias("x"), (F.col("v") + LEAN_Y * F.col("u")).alias("y"), F.lit(0.0).alias("z"))
    v = 1 + F.col("id") % n + (n + 1) * F.floor(F.col("id") / n)
    elem = spark.range(n * n).select(F.lit(ETYPES["QUAD"]).alias("etype"), "id", F.array(v, v + 1, v + n + 2, v + n + 1).alias("conn"))
    return Mesh(vertex, elem)


def _overlay(spark, sf_dir: str) -> overlay.Overlay:
    """Most lines of one lattice lie on lines of the other in places, so vertices and edges coincide."""
    source, target = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lattice(spark, sf_dir, "part", "p_partkey", "p_size")
    return overlay.overlay(source, target, 5.0)


_CUTS = f"""WITH {_A}, {_B}, na AS (SELECT count(*) AS n FROM a), nb AS (SELECT count(*) AS n FROM b),
o AS (SELECT a.i AS s, b.i AS t, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.lo < b.hi AND b.lo < a.hi)"""


@query(f"{_CUTS} SELECT x.s + na.n * y.s AS src, x.t + nb.n * y.t AS tgt, round((x.hi - x.lo) * (y.hi - y.lo) * (1 - {LEAN_X} * {LEAN_Y}), 6) AS area, 4 AS n FROM o x, o y, na, nb")
def overlay_cells(spark, sf_dir) -> DataFrame:
    """Each overlap of two lattices with its parents, area and number of nodes."""
    out = _overlay(spark, sf_dir)
    return out.mesh.elem.join(out.parents, "id").select("src", "tgt", F.round("area", 6).alias("area"), F.size("conn").alias("n"))


@query(f"""{_CUTS}, k AS (SELECT count(*) AS k FROM o) SELECT kind, CAST(CASE kind WHEN 'inner' THEN 2 * k * (k - 1) WHEN 'border' THEN 4 * k ELSE (k + 1) * (k + 1) END AS BIGINT) AS n
FROM k, (SELECT unnest(['inner', 'border', 'nodes']) AS kind)""")
def overlay_edges(spark, sf_dir) -> DataFrame:
    """How many edges of the overlap mesh are inner and on its border, and its nodes: no edge is torn, no node doubled."""
    out = _overlay(spark, sf_dir)
    return overlay.edge_uses(out.mesh.elem).unionByName(out.mesh.vertex.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "n"))


# A share of the squares between the two middle layers of the brick is cut: which ones, the customers' nations tell.
_SQUARES = """c AS (SELECT c_custkey % (n * n) AS q, n, sum(c_nationkey) % 4 > 0 AS cut FROM customer, s GROUP BY ALL),
r AS (SELECT q % n AS i, q // n AS j FROM c WHERE cut),
p AS (SELECT i % (n + 1) AS x, i // (n + 1) AS y, n FROM (SELECT unnest(range((n + 1) * (n + 1))) AS i, n FROM s))"""


def _cut_brick(spark, sf_dir: str) -> tuple[Mesh, DataFrame, int]:
    """The brick, and the cut squares (key) between its layers."""
    n = brick_size(spark, sf_dir)
    mesh, m = brick(spark, n), n + 1
    cells = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % (n * n)).alias("q")).agg(F.sum("c_nationkey").alias("w")).filter("w % 4 > 0")
    v = 1 + F.col("q") % n + m * F.floor(F.col("q") / n) + m * m * (n // 2)
    return mesh, cells.select(F.array(v, v + 1, v + m, v + m + 1).alias("key")), n


@query(f"""{BRICK}, {_SQUARES}, f AS (SELECT p.x, p.y, p.n, count(*) AS cut FROM p JOIN r ON r.i IN (p.x - 1, p.x) AND r.j IN (p.y - 1, p.y) GROUP BY ALL)
SELECT 1 + x + (n + 1) * y + (n + 1) * (n + 1) * (n // 2) AS old, x, y, 1 AS copies FROM f
WHERE cut = (CASE WHEN x IN (0, n) THEN 1 ELSE 2 END) * (CASE WHEN y IN (0, n) THEN 1 ELSE 2 END)""")
def split_vertices(spark, sf_dir) -> DataFrame:
    """The vertices that the cut doubles: those around which every square of the layer is cut."""
    mesh, cut, _ = _cut_brick(spark, sf_dir)
    opened, lineage = split.split(mesh, cut, 3)
    at = opened.vertex.join(lineage, "id").select("old", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return at.groupBy("old", "x", "y").agg(F.count("*").cast("int").alias("copies"))


@query(f"""{BRICK}, {_SQUARES}, f AS (SELECT p.x, p.y FROM p JOIN r ON r.i IN (p.x - 1, p.x) AND r.j IN (p.y - 1, p.y) GROUP BY p.x, p.y, p.n
  HAVING count(*) = (CASE WHEN p.x IN (0, p.n) THEN 1 ELSE 2 END) * (CASE WHEN p.y IN (0, p.n) THEN 1 ELSE 2 END)),
o AS (SELECT r.i, r.j FROM r JOIN f ON f.x IN (r.i, r.i + 1) AND f.y IN (r.j, r.j + 1) GROUP BY ALL)
SELECT i, j, CAST(2 AS BIGINT) AS sides, 1 + i + n * j + n * n * (n // 2 - 1) AS below, 1 + i + n * j + n * n * (n // 2) AS above FROM o, s""")
def split_faces(spark, sf_dir) -> DataFrame:
    """The cut squares that were laid open, with the cells below and above them: those with a doubled corner."""
    mesh, cut, n = _cut_brick(spark, sf_dir)
    opened, lineage = split.split(mesh, cut, 3)
    at = F.array_min("key") - 1
    rows = split.faces_of_cut(mesh, opened, lineage, 3)
    return rows.groupBy((at % (n + 1)).alias("i"), (F.floor(at / (n + 1)) % (n + 1)).alias("j")).agg(F.count("*").alias("sides"), F.min("id").alias("below"), F.max("id").alias("above"))


# Where suppliers' mean balance in a column of cells is high, the mesh is to be finer.
_FINE = """c AS (SELECT c_custkey % (n * n) AS q, sum(c_nationkey) % 3 = 0 AS fine FROM customer, s GROUP BY ALL)"""


def _fine_brick(spark, sf_dir: str):
    n = brick_size(spark, sf_dir)
    mesh = adapt.tetrahedra(brick(spark, n))
    fine = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % (n * n)).alias("q")).agg((F.sum("c_nationkey") % 3 == 0).alias("fine")).filter("fine").select("q")
    return n, mesh, written(fine, "fine-columns")


def _column_of(n: int):
    """The column of cells under a point, the last ones with their far border."""
    return lambda x, y: F.least(F.floor(x), F.lit(n - 1)) + n * F.least(F.floor(y), F.lit(n - 1))


@query(f"{BRICK}, {_FINE} SELECT b.id AS parent, 1.0::DOUBLE AS volume, coalesce(fine, false) AS fine FROM b LEFT JOIN c ON c.q = b.x + b.n * b.y")
def adapted_volumes(spark, sf_dir) -> DataFrame:
    """Each cell's volume after tetrahedra were halved round after round in some columns; whether edges within the column are short."""
    n, mesh, fine = _fine_brick(spark, sf_dir)
    out, lineage, _ = _adapted(n, mesh, fine)
    size = measure.with_points(out).select("etype", "id", "p", measure.measure(F.col("etype"), F.col("p")).alias("size"))
    edge = lambda i, j: (Vec.of(F.get("p", F.lit(i))) - Vec.of(F.get("p", F.lit(j)))).norm()
    longest = F.greatest(*[edge(i, j) for i in range(4) for j in range(i)])
    rows = size.select("etype", "id", "size", longest.alias("longest")).join(lineage, ["etype", "id"])
    sums = rows.groupBy(F.floor(F.col("parent_id") / 6).alias("parent")).agg(F.round(F.sum("size"), 9).alias("volume"), F.max("longest").alias("longest"))
    return sums.select("parent", "volume", (F.col("longest") <= _FINE_SIZE).alias("fine"))


@query(f"""{BRICK} SELECT kind, CASE kind WHEN 'skin' THEN CAST(6 * n * n AS DOUBLE) ELSE 0.0 END AS value FROM s, (SELECT unnest(['skin', 'torn', 'long']) AS kind)""")
def adapted_conformity(spark, sf_dir) -> DataFrame:
    """The area of the refined mesh's skin (a hanging node would add to it), sides of more than two elements, edges left too long."""
    n, mesh, fine = _fine_brick(spark, sf_dir)
    out, _, _ = _adapted(n, mesh, fine)
    faces = adjacency.skin(out.elem, 2).select(F.lit(ETYPES["TRI"]).alias("etype"), F.monotonically_increasing_id().alias("id"), "conn")
    area = measure.with_points(Mesh(out.vertex, faces)).agg(F.round(F.sum(measure.measure(F.col("etype"), F.col("p"))), 6).alias("value"))
    long = _long(n, adapt.edges(out), fine)
    parts = {"skin": area, "torn": adapt.torn(out).agg(F.count("*").cast("double").alias("value")), "long": long.agg(F.count("*").cast("double").alias("value"))}
    out = [rows.select(F.lit(k).alias("kind"), "value") for k, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_FINE_SIZE = 0.9


def _long(n: int, edges: DataFrame, fine: DataFrame) -> DataFrame:
    """The long edges of fine columns: those whose middle is in one, or on its border."""
    step = 1e-9
    spots = F.array_distinct(F.array(*[_column_of(n)(F.greatest(F.col("x") + dx, F.lit(0.0)), F.greatest(F.col("y") + dy, F.lit(0.0))) for dx in (-step, step) for dy in (-step, step)]))
    return edges.filter(F.col("length") > _FINE_SIZE).withColumn("q", F.explode(spots)).join(fine, "q", "left_semi").select("key").distinct()


def _adapted(n: int, mesh: Mesh, fine: DataFrame) -> tuple[Mesh, DataFrame, int]:
    return adapt.refine_where(mesh, lambda edges: _long(n, edges, fine))


def _lines_of(rows: DataFrame, name: str) -> str:
    """Rows (section, at, i, text) as a text file of many parts, in that order; its path."""
    path = new_path(rows.sparkSession, name)
    lines.write(rows.select("section", (F.col("at") * 64 + F.col("i")).alias("at"), "text"), path)
    return path


def _heads(spark, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(s, -1, i, t) for i, (s, t) in enumerate(rows)], "section int, at long, i int, text string")


def _parts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 4).alias("x"), F.col("p_retailprice").cast("double").alias("y"), (F.col("p_partkey") % 20 - 10).cast("double").alias("z"))


def _conn(n: int):
    """So many parts for each customer."""
    return F.array(*[(F.col("c_custkey") * (7 + i) + i * i) % F.col("n") + 1 for i in range(n)])


_CONN = "[(c_custkey * (7 + i) + i * i) % n + 1 FOR i IN range({0})]"
_MADE = "t AS (SELECT c_custkey, c_nationkey, (SELECT count(*) FROM part) AS n FROM customer)"


def _customers(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit(n).alias("n"))


@query(f"""WITH {_MADE} SELECT 9 AS etype, c_custkey AS id, array_to_string({_CONN.format(20)}, ' ') AS conn, 'NATION' || c_nationkey AS name FROM t WHERE c_nationkey % 2 = 0
UNION ALL SELECT 3, c_custkey, array_to_string({_CONN.format(4)}, ' '), 'NATION' || c_nationkey FROM t WHERE c_nationkey % 2 = 1""")
def keyword_file(spark, sf_dir) -> DataFrame:
    """Customers as hexahedra of 20 nodes or quadrilaterals over parts, written as keyword lines that break off at commas, and read back."""
    rows = _customers(spark, sf_dir)
    node = _parts(spark, sf_dir).select(F.lit(0).alias("section"), F.col("id").alias("at"), F.lit(0).alias("i"), F.concat_ws(", ", F.col("id").cast("string"), *[lines.number(F.col(c)) for c in "xyz"]).alias("text"))
    solid, kind = F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")
    order = [*range(12), *range(16, 20), *range(12, 16)]  # the file has the upper edges' nodes before those between
    conn = F.when(solid, F.transform(F.array(*map(F.lit, order)), lambda i: F.get(_conn(20), i))).otherwise(_conn(4)).cast("array<string>")
    cut = F.transform(F.sequence(F.lit(0), F.when(solid, 2).otherwise(0)), lambda k: F.concat(F.when(k == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(", "))).otherwise(""), F.array_join(F.slice(conn, 7 * k + 1, F.lit(7)), ","), F.when(solid & (k < 2), ",").otherwise("")))
    elem = rows.select((1 + kind).alias("section"), F.col("c_custkey").alias("at"), F.posexplode(cut).alias("i", "text"))
    head = rows.select("c_nationkey").distinct().select((1 + kind).alias("section"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("i"), F.concat(F.lit("*ELEMENT, TYPE="), F.when(solid, "C3D20R").otherwise("S4"), F.lit(", ELSET=NATION"), kind.cast("string")).alias("text"))
    out = _heads(spark, [(0, "*NODE")]).unionByName(node).unionByName(head).unionByName(elem)
    mesh = cards.abaqus(spark, _lines_of(out, "keywords"))
    return mesh.elem.join(mesh.tag("NAME").values, ["etype", "id"]).select("etype", "id", F.array_join(F.col("conn").cast("array<string>"), " ").alias("conn"), F.col("value").alias("name"))


@query(f"""WITH {_MADE}, v AS (SELECT p_partkey AS id, p_size / 4 AS x, CAST(p_retailprice AS DOUBLE) AS y, CAST(p_partkey % 20 - 10 AS DOUBLE) AS z FROM part),
e AS (SELECT c_custkey AS id, c_nationkey, unnest({_CONN.format(8)}) AS vid FROM t)
SELECT e.id, c_nationkey AS material, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z FROM e JOIN v ON v.id = e.vid GROUP BY ALL""")
def bulk_data(spark, sf_dir) -> DataFrame:
    """Customers as hexahedra over parts, written as cards with wide and narrow fields over two lines each, and read back with their corners' sums."""
    rows = _customers(spark, sf_dir)
    wide = lambda c: F.lpad(c.cast("string"), 16, " ")
    thin = lambda c: F.lpad(c.cast("string"), 8, " ")
    at = lambda c: wide(F.format_string("%.6f", F.col(c)))
    grid = F.array(F.concat(F.lit("GRID*   "), wide(F.col("id")), wide(F.lit("")), at("x"), at("y")), F.concat(F.lit("*       "), at("z")))
    node = _parts(spark, sf_dir).select(F.lit(0).alias("section"), F.col("id").alias("at"), F.posexplode(grid).alias("i", "text"))
    conn = [F.get(_conn(8), F.lit(i)) for i in range(8)]
    hexa = F.array(F.concat(F.lit("CHEXA   "), *map(thin, (F.col("c_custkey"), F.col("c_nationkey"), *conn[:6]))), F.concat(F.lit("+       "), *map(thin, conn[6:])))
    elem = rows.select(F.lit(1).alias("section"), F.col("c_custkey").alias("at"), F.posexplode(hexa).alias("i", "text"))
    mesh = cards.nastran(spark, _lines_of(node.unionByName(elem), "cards"))
    met = elem_vertex(mesh.elem).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid").join(mesh.tag("MATERIAL_SET").values, ["etype", "id"])
    return met.groupBy("id", F.col("value").alias("material")).agg(*[F.round(F.sum(c), 3).alias(c) for c in "xyz"])


@query(f"""WITH {_MADE} SELECT CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END AS etype, c_custkey AS id, c_nationkey AS material,
  array_to_string(CASE c_nationkey % 3 WHEN 0 THEN {_CONN.format(2)} WHEN 1 THEN {_CONN.format(4)} ELSE {_CONN.format(8)} END, ' ') AS conn FROM t""")
def universal_file(spark, sf_dir) -> DataFrame:
    """Customers as beams, quadrilaterals and hexahedra in records of two and three lines, which only the record before tells apart, read back."""
    rows = _customers(spark, sf_dir)
    ten = lambda *c: F.concat(*[F.lpad((x if not isinstance(x, int) else F.lit(x)).cast("string"), 10, " ") for x in c])
    pair = F.array(ten(F.col("id"), 1, 1, 11), F.concat_ws("  ", F.lit(""), *[F.format_string("%.6fD+00", F.col(c)) for c in "xyz"]))
    node = _parts(spark, sf_dir).select(F.lit(0).alias("section"), F.col("id").alias("at"), F.posexplode(pair).alias("i", "text"))
    key, kind = F.col("c_custkey"), F.col("c_nationkey") % 3
    first = lambda number, n: ten(key, number, 2, F.col("c_nationkey"), 7, n)
    line = lambda n: ten(*[F.get(_conn(n), F.lit(i)) for i in range(n)])
    text = F.when(kind == 0, F.array(first(21, 2), ten(0, 1, 1), line(2))).when(kind == 1, F.array(first(44, 4), line(4))).otherwise(F.array(first(115, 8), line(8)))
    elem = rows.select(F.lit(1).alias("section"), key.alias("at"), F.posexplode(text).alias("i", "text"))
    heads = [(0, "    -1"), (0, "  2411"), (1, "    -1"), (1, "    -1"), (1, "  2412")]
    end = spark.createDataFrame([(2, 0, 0, "    -1")], "section int, at long, i int, text string")
    mesh = cards.ideas(spark, _lines_of(_heads(spark, heads).unionByName(node).unionByName(elem).unionByName(end), "universal"))
    met = mesh.elem.join(mesh.tag("MATERIAL_SET").values, ["etype", "id"])
    return met.select("etype", "id", F.col("value").alias("material"), F.array_join(F.col("conn").cast("array<string>"), " ").alias("conn"))


@query(f"""WITH {_MADE} SELECT 9 AS etype, c_custkey AS id, array_to_string({_CONN.format(27)}, ' ') AS conn FROM t""")
def second_order_file(spark, sf_dir) -> DataFrame:
    """Customers as hexahedra of 27 nodes, written and read back."""
    elem = _customers(spark, sf_dir).select(F.lit(9).alias("etype"), F.col("c_custkey").alias("id"), _conn(27).alias("conn"))
    path = new_path(spark, "second-order")
    gmsh.write(Mesh(_parts(spark, sf_dir), elem), path)
    return gmsh.read(spark, path).elem.select("etype", "id", F.array_join(F.col("conn").cast("array<string>"), " ").alias("conn"))


# A plane through a box of sizes l with normal n and distance d leaves of it, by inclusion and exclusion over its corners,
_SLICE = "(" + " + ".join(f"{(-1) ** bin(k).count('1')} * pow(greatest(d{''.join(f' - n{i} * l{i}' for i in range(3) if k >> i & 1)}, 0), 3)" for k in range(8)) + ") / (6 * n0 * n1 * n2)"


@query(f"""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 5 AS l0, 1.0 + c_custkey % 3 AS m1, 1.0 + c_custkey % 4 AS l2, 1.0 + c_nationkey % 2 AS n0, 1.0 + c_nationkey % 3 AS n1, 1.0 + c_nationkey % 5 AS n2,
  0.531 + c_custkey % 11 AS d, 0.472 + (c_custkey % 9) / 4.0 AS h FROM customer), u AS (SELECT *, least(m1, h) AS l1 FROM t)
SELECT id, round({_SLICE}, 6) AS volume, d > 0.1 * (n0 * l0 + n1 * m1 + n2 * l2) AND h > 0.1 * m1 AS holds FROM u""")
def polyhedron_cuts(spark, sf_dir) -> DataFrame:
    """Boxes cut by a slanted plane and by an upright one: what is left, and whether it holds a point near a corner."""
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    size = Vec(1.0 + k % 5, 1.0 + k % 3, 1.0 + k % 4)
    n = Vec(1.0 + c % 2, 1.0 + c % 3, 1.0 + c % 5)
    planes = F.array(polyhedron.plane(n.x, n.y, n.z, 0.531 + k % 11), polyhedron.plane(0, 1, 0, 0.472 + (k % 9) / 4.0))
    whole = polyhedron.box(Vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)), size)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), whole.alias("whole"), planes.alias("planes"), size.scale(0.1).struct().alias("p"))
    rows = rows.select("id", "p", polyhedron.cut_all(F.col("whole"), F.col("planes")).alias("left"))
    return rows.select("id", F.round(polyhedron.volume(F.col("left")), 6).alias("volume"), polyhedron.holds(F.col("left"), Vec.of(F.col("p"))).alias("holds"))


# The orthonormal frame in which the customers of a nation spread.
_FRAME = ((2 / 3, -1 / 3, 2 / 3), (2 / 3, 2 / 3, -1 / 3), (-1 / 3, 2 / 3, 2 / 3))
_SPREAD = "t AS (SELECT c_nationkey AS \"group\", max(40 + c_custkey % 9) AS u, max(10 + c_custkey % 5) AS v, max(1 + c_custkey % 3) AS w FROM customer GROUP BY ALL)"


def _spread(spark, sf_dir: str) -> DataFrame:
    """Each customer's eight points, mirrored in the three planes of the frame, around the nation's middle."""
    k, c = F.col("c_custkey"), F.col("c_nationkey")
    lengths = (40 + k % 9, 10 + k % 5, 1 + k % 3)
    signs = F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip(x, "uvw", strict=True)]) for x in product((-1, 1), repeat=3)])
    rows = table(spark, sf_dir, "customer").select(c.alias("group"), *[n.alias("l" + x) for n, x in zip(lengths, "uvw", strict=True)], F.explode(signs).alias("s"))
    at = [sum((F.col("l" + x) * F.col(f"s.{x}") * _FRAME[i][j] for i, x in enumerate("uvw")), F.lit(0.0)) for j in range(3)]
    return rows.select("group", *[(a + (j + 1) * F.col("group")).alias(n) for j, (a, n) in enumerate(zip(at, "xyz", strict=True))])


@query(f"WITH {_SPREAD} SELECT \"group\", round(w::DOUBLE, 6) AS short, round(v::DOUBLE, 6) AS middle, round(u::DOUBLE, 6) AS long, round(\"group\"::DOUBLE, 6) AS x, round(100.0 - u, 6) AS enter, round(100.0 + u, 6) AS leave, 5.0::DOUBLE AS gap, false AS holds, round(8.0 * u * v * w, 4) AS volume FROM t")
def oriented_boxes(spark, sf_dir) -> DataFrame:
    """The box of each nation's customers, a ray along its longest axis, and a point 3 and 4 outside of two of its faces."""
    boxes = obb.of_points(_spread(spark, sf_dir)).select("group", F.struct("center", "axes", "half").alias("b"))
    box, axis = F.col("b"), [Vec(*map(F.lit, row)) for row in _FRAME]
    middle = Vec(*[((j + 1) * F.col("group")).cast("double") for j in range(3)])
    hit = obb.ray(box, middle + axis[0].scale(100.0), axis[0].scale(-1.0))
    p = middle + axis[0].scale(F.get(box["half"], F.lit(2)) + 3) + axis[1].scale(F.get(box["half"], F.lit(1)) + 4)
    gap = (Vec.of(obb.closest(box, p)) - p).norm()
    half = [F.round(F.get(box["half"], F.lit(i)), 6).alias(n) for i, n in enumerate(("short", "middle", "long"))]
    return boxes.select("group", *half, F.round(box["center"]["x"], 6).alias("x"), F.round(hit["enter"], 6).alias("enter"), F.round(hit["leave"], 6).alias("leave"), F.round(gap, 6).alias("gap"), obb.holds(box, p).alias("holds"), F.round(obb.volume(box), 4).alias("volume"))


def _cubic(x, y):
    return 1 + x / 10 - y / 20 + x * x / 100 - x * y / 150 + x * x * x / 10000


@query(f"""WITH {_A}, n AS (SELECT count(*) AS n FROM a), c AS (SELECT x.i + n * y.i AS pid, (x.lo + x.hi) / 2 AS u, (y.lo + y.hi) / 2 AS v FROM a x, a y, n),
p AS (SELECT pid, u + {LEAN_X} * v AS x, v + {LEAN_Y} * u AS y FROM c)
SELECT pid, round(x, 5) AS x, round(y, 5) AS y, round(1 + x / 10 - y / 20 + x * x / 100 - x * y / 150 + x * x * x / 10000, 4) AS z FROM p""")
def reconstructed_surface(spark, sf_dir) -> DataFrame:
    """The middle of each face of a lattice that lies on a cubic surface, moved to the surface of degree 3 that its vertices alone give."""
    mesh = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    mesh = Mesh(written(mesh.vertex.withColumn("z", _cubic(F.col("x"), F.col("y"))), "surface"), mesh.elem)
    up = mesh.vertex.select("id", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    points = mesh.elem.select(F.col("id").alias("pid"), "etype", "id", F.array(*[F.lit(0.25)] * 4).alias("weight"))
    out = reconstruct.moved(mesh, reconstruct.fit(mesh, 3, n_rings=3, normal=up), 3, points)
    return out.select("pid", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("z", 4).alias("z"))


@query(f"""WITH {_A}, {_B}, e AS (SELECT (SELECT max(hi) FROM a) AS top), nb AS (SELECT count(*) AS n FROM b), t AS (SELECT i, lo, least(hi, top) AS hi FROM b, e WHERE lo < top),
m AS (SELECT x.i + n * y.i AS id, (x.lo + x.hi) / 2 AS u, (y.lo + y.hi) / 2 AS v, (x.lo * x.lo + x.lo * x.hi + x.hi * x.hi) / 3 AS uu, (y.lo * y.lo + y.lo * y.hi + y.hi * y.hi) / 3 AS vv FROM t x, t y, nb)
SELECT id, round(1 + (u + {LEAN_X} * v) / 10 + ({LEAN_Y} * uu + (1 + {LEAN_X} * {LEAN_Y}) * u * v + {LEAN_X} * vv) / 50, 5) AS value FROM m""")
def spectral_means(spark, sf_dir) -> DataFrame:
    """A quadratic field at the Gauss-Lobatto nodes of one lattice's elements, as exact means over what they cover of the other's faces."""
    source, target = lattice(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lattice(spark, sf_dir, "part", "p_partkey", "p_size")
    w = spectral.weights(source, target, 5.0, 3)
    values = spectral.nodal_places(source, 3).select("id", "k", (1 + F.col("x") / 10 + F.col("x") * F.col("y") / 50).alias("value"))
    return spectral.apply(w, values).select("id", F.round("value", 5).alias("value"))


@query("""WITH t AS (SELECT c_custkey AS id, 1.0 + c_custkey % 5 AS a, 1.0 + c_custkey % 3 AS b, 1.0 + c_custkey % 4 AS h, c_nationkey AS s FROM customer)
SELECT id, round(a * b * h / 2 * (s + a / 3 + b / 3 + h / 2), 6) AS prism, round(a * b * h / 3 * (s + 0.375 * a + 0.375 * b + h / 4), 6) AS pyramid, 0.25 AS u, round(h / 2, 6) AS height,
  round(a * b * h * (s + a * a / 3 + a * b / 4 + b * h / 4 + h * h / 3), 5) AS hexahedron, round(a * b / 2 * (s + a * a / 6 + a * b / 12), 6) AS triangle FROM t""")
def higher_elements(spark, sf_dir) -> DataFrame:
    """Integrals of linear fields over prisms and pyramids, of quadratic ones over hexahedra of 27 nodes and triangles of six, and a point found in a prism and a pyramid."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (1.0 + k % 5).alias("a"), (1.0 + k % 3).alias("b"), (1.0 + k % 4).alias("h"), F.col("c_nationkey").cast("double").alias("s"))
    a, b, h, s = (F.col(c) for c in "abhs")
    at = lambda x, y, z: F.struct((a * x).alias("x"), (b * y).alias("y"), (h * z).alias("z"))
    forms = {
        "prism": [(x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (0, 1))],
        "pyramid": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1)],
        "hexahedron": [tuple((c + 1) / 2 for c in node) for node in hexahedron_nodes()],
        "triangle": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.5, 0, 0), (0.5, 0.5, 0), (0, 0.5, 0)],
    }
    rows = rows.select("id", *"abhs", *[F.array(*[at(*map(float, p)) for p in points]).alias(n) for n, points in forms.items()])
    linear = lambda n: F.transform(n, lambda v: s + v["x"] + v["y"] + v["z"])
    square = lambda n: F.transform(n, lambda v: s + v["x"] * v["x"] + v["x"] * v["y"] + v["y"] * v["z"] + v["z"] * v["z"])
    target = at(0.25, 0.25, 0.5)
    local = rows.select("*", shape.inverse("PRISM", F.col("prism"), target).alias("in_prism"), shape.inverse("PYRAMID", F.col("pyramid"), target).alias("in_pyramid"))
    back = shape.place("PYRAMID", F.col("pyramid"), F.col("in_pyramid"))
    whole = [shape.integral("PRISM", F.col("prism"), linear("prism")).alias("prism"), shape.integral("PYRAMID", F.col("pyramid"), linear("pyramid")).alias("pyramid"), shape.integral("HEX", F.col("hexahedron"), square("hexahedron"), 27).alias("hexahedron"), shape.integral("TRI", F.col("triangle"), square("triangle"), 6).alias("triangle")]
    out = local.select("id", *whole, F.col("in_prism.u").alias("u"), back.z.alias("height"))
    return out.select("id", F.round("prism", 6).alias("prism"), F.round("pyramid", 6).alias("pyramid"), F.round("u", 9).alias("u"), F.round("height", 6).alias("height"), F.round("hexahedron", 5).alias("hexahedron"), F.round("triangle", 6).alias("triangle"))


def hexahedron_nodes() -> list[tuple[int, ...]]:
    """Local coordinates of the 27 nodes of a hexahedron, in canonical order."""
    corner = shape.CUBE["HEX"]
    middle = lambda places: tuple(sum(corner[i][d] for i in places) // len(places) for d in range(3))
    return [*corner, *[middle(e) for e in positions_of("HEX", 1)], *[middle(f) for f in positions_of("HEX", 2)], (0, 0, 0)]


# Some cells of the brick are left out, as the customers' nations tell.
_LEFT = """c AS (SELECT c_custkey % (n * n * n) AS i, sum(c_nationkey) % 4 > 0 AS here FROM customer, s GROUP BY ALL), h AS (SELECT b.* FROM b JOIN c ON c.i = b.id - 1 WHERE here)"""


def _holed_brick(spark, sf_dir: str) -> tuple[Mesh, int]:
    n = brick_size(spark, sf_dir)
    mesh = brick(spark, n)
    here = table(spark, sf_dir, "customer").groupBy((1 + F.col("c_custkey") % (n**3)).alias("id")).agg((F.sum("c_nationkey") % 4 > 0).alias("here")).filter("here")
    return Mesh(mesh.vertex, mesh.elem.join(here.select("id"), "id", "left_semi").select("etype", "id", "conn")), n


_AROUND = " UNION ALL ".join(
    f"SELECT h.id, {p} AS p, {q} AS q, {r} AS r, '{axis}' AS axis, (CASE WHEN du = 0 THEN (CASE WHEN dv = 0 THEN 0 ELSE 3 END) ELSE (CASE WHEN dv = 0 THEN 1 ELSE 2 END) END) AS turn, n FROM h, (SELECT unnest([0, 0, 1, 1]) AS du, unnest([0, 1, 0, 1]) AS dv)"
    for axis, p, q, r in (("z", "h.x + du", "h.y + dv", "h.z"), ("x", "h.x", "h.y + du", "h.z + dv"), ("y", "h.x + du", "h.y", "h.z + dv"))
)


@query(f"""{BRICK}, {_LEFT}, w AS ({_AROUND}), m AS (SELECT axis, p, q, r, n, count(*) AS k, sum(1 << turn) AS mask FROM w GROUP BY ALL)
SELECT 1 + p + (n + 1) * q + (n + 1) * (n + 1) * r AS a, 1 + p + (n + 1) * q + (n + 1) * (n + 1) * r + CASE axis WHEN 'x' THEN 1 WHEN 'y' THEN n + 1 ELSE (n + 1) * (n + 1) END AS b,
  CAST(k AS INT) AS n, k = 4 AS closed, CASE WHEN mask IN (5, 10) THEN 2 ELSE 1 END AS fans FROM m""")
def edge_rings(spark, sf_dir) -> DataFrame:
    """The cells around each edge of a brick with holes: how many, whether they close, and into how many fans they fall."""
    mesh, _ = _holed_brick(spark, sf_dir)
    return dual.edge_rings(mesh.elem).select("a", "b", F.size("ring").alias("n"), "closed", "fans")


@query(f"""{BRICK}, {_LEFT}, k AS (SELECT x + dx AS p, y + dy AS q, z + dz AS r, n, count(*) AS k FROM h, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz) GROUP BY ALL)
SELECT 1 + p + (n + 1) * q + (n + 1) * (n + 1) * r AS vid, 6 AS n FROM k WHERE k = 8""")
def dual_cells(spark, sf_dir) -> DataFrame:
    """Vertices of the brick with holes whose dual cell is a polyhedron, and its number of faces."""
    mesh, _ = _holed_brick(spark, sf_dir)
    return dual.cells(mesh.elem).filter("whole").select("vid", F.size("faces").alias("n"))


@query(f"{BRICK}, d AS (SELECT unnest([0, 1, 2]) AS axis) SELECT id, axis, count(*) OVER (PARTITION BY axis, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) AS size FROM b, d")
def hexahedron_sheets(spark, sf_dir) -> DataFrame:
    """For each cell and direction, how many cells its sheet has."""
    rows = dual.sheets(brick(spark, brick_size(spark, sf_dir)).elem)
    size = rows.groupBy("sheet").agg(F.count("*").alias("size"))
    return rows.join(size, "sheet").select("id", "axis", "size")


_BITS = 8


def _hilbert_sql(rows: str) -> str:
    """Hilbert keys (id, key) of rows (id, x0, x1, x2), a step for each bit and direction."""
    out = f"SELECT id, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, CAST(x2 AS BIGINT) AS x2 FROM {rows}"
    for b in range(_BITS - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(3):
            others = ", ".join(f"x{j}" for j in (1, 2) if j != i)
            own = f", CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}" if i else ""
            out = f"SELECT id, CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0{own}, {others} FROM ({out})"
    out = f"SELECT id, x0, xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2 FROM ({out})"
    flip = "0"
    for b in range(_BITS - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    out = f"SELECT id, xor(x0, f) AS x0, xor(x1, f) AS x1, xor(x2, f) AS x2 FROM (SELECT *, CAST({flip} AS BIGINT) AS f FROM ({out}))"
    key = " + ".join(f"(((x{i} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(_BITS) for i in range(3))
    return f"SELECT id, CAST({key} AS BIGINT) AS key FROM ({out})"


_PART_CELLS = "(SELECT p_partkey AS id, p_partkey % 200 AS x0, p_size AS x1, CAST(floor(p_retailprice) AS BIGINT) % 256 AS x2 FROM part)"


@query(f"WITH k AS ({_hilbert_sql(_PART_CELLS)}) SELECT id, key, CAST(ntile(8) OVER (ORDER BY key, id) - 1 AS BIGINT) AS part FROM k")
def curve_parts(spark, sf_dir) -> DataFrame:
    """Parts' places along Hilbert's curve by number, size and price, and eight runs of equal length."""
    cells = [F.col("p_partkey") % 200, F.col("p_size"), F.floor("p_retailprice") % 256]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), partition.hilbert(cells, _BITS).alias("key"))
    return refine.blocks(rows, ["key", "id"], 8)


_ALONG = """t AS (SELECT c_custkey AS id, c_custkey * 1.0 AS u FROM customer), l AS (SELECT id, u, row_number() OVER (ORDER BY u) <= ceil(count(*) OVER () / 2.0) AS low FROM t),
m AS (SELECT id, low, row_number() OVER (PARTITION BY low ORDER BY u) <= ceil(count(*) OVER (PARTITION BY low) / 2.0) AS less FROM l)"""


@query(f"WITH {_ALONG} SELECT id, dense_rank() OVER (ORDER BY low DESC, less DESC) - 1 AS part FROM m")
def inertia_parts(spark, sf_dir) -> DataFrame:
    """Customers strung along a slanted line, cut into four where they lie, from the end with the least number on."""
    k = F.col("c_custkey")
    lengths = (k, k % 7 / 100, k % 5 / 100)
    at = [sum((x * _FRAME[i][j] for i, x in enumerate(lengths)), F.lit(0.0)) for j in range(3)]
    rows = partition.by_inertia(table(spark, sf_dir, "customer").select(k.alias("id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)]), 2)
    first = rows.groupBy("part").agg(F.min("id").alias("least"))  # the axis may point either way
    order = first.select("part", (F.row_number().over(Window.orderBy("least")) - 1).cast("long").alias("place"))
    return rows.join(order, "part").select("id", F.col("place").alias("part"))


@query(f"{BRICK} SELECT CAST(p AS BIGINT) AS part, count(*) AS n, true AS fewer FROM (SELECT ntile(4) OVER (ORDER BY hash_order, id) - 1 AS p FROM (SELECT id, (id * 7919) % 1009 AS hash_order FROM b)) GROUP BY p")
def graph_parts(spark, sf_dir) -> DataFrame:
    """Cells dealt out at random, then swapped between parts: sizes stay, edges between parts become a fifth fewer at least."""
    n = brick_size(spark, sf_dir)
    mesh = brick(spark, n)
    start = refine.blocks(mesh.elem.select("id", ((F.col("id") * 7919) % 1009).alias("o")), ["o", "id"], 4).select(F.col("id").alias("node"), "part")
    start = written(start, "start-parts")
    edges = written(adjacency.siblings(mesh.elem, 2).select(F.col("id").alias("a"), F.col("other_id").alias("b")), "cell-graph")
    end = partition.swapped(edges, start)
    single = edges.filter("a < b").distinct()
    fewer = partition.cut_edges(single, end) <= 0.8 * partition.cut_edges(single, start)
    return end.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", F.lit(fewer).alias("fewer"))


@query(f"""{BRICK}, g AS (SELECT id, x, y, z, CAST(floor(x * 2 / n) AS BIGINT) AS i, n FROM b)
SELECT id, p AS part, w AS west, t AS top FROM (SELECT id, pi + 2 * (pj + 2 * pk) AS p, CASE WHEN pi > 0 THEN pi - 1 + 2 * (pj + 2 * pk) END AS w, CASE WHEN pk < 1 THEN pi + 2 * (pj + 2 * (pk + 1)) END AS t
FROM (SELECT id, CAST(x >= (n + 1) // 2 AS BIGINT) AS pi, CAST(y >= (n + 1) // 2 AS BIGINT) AS pj, CAST(z >= (n + 1) // 2 AS BIGINT) AS pk FROM g))""")
def structured_owners(spark, sf_dir) -> DataFrame:
    """The part of each cell of the brick, cut into eight pieces as alike as can be, and the parts to its west and above."""
    n = brick_size(spark, sf_dir)
    grid = partition.structured("ijk square", (0, 0, 0), (n, n, n), 8)
    i = F.col("id") - 1
    rows = brick(spark, n).elem.select("id", grid.owner([i % n, F.floor(i / n) % n, F.floor(i / (n * n))]).alias("part"))
    return rows.select("id", "part", grid.neighbour(F.col("part"), (-1, 0, 0)).alias("west"), grid.neighbour(F.col("part"), (0, 0, 1)).alias("top"))


@query("""SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS id, round(3.0 * (c_nationkey + c_custkey % 7) + 2, 6) AS x, round(3.0 * (c_custkey % 5) + 3, 6) AS y, round(3.0 + (c_custkey % 3), 6) AS z FROM customer""")
def scene_file(spark, sf_dir) -> DataFrame:
    """A triangle for each customer in a scope of its own inside its nation's, written and read back: the sums of the faces' corners."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("section"), F.col("c_custkey").alias("at"))
    k = F.col("at")
    text = F.array(F.lit("begin"), F.concat(F.lit("trans "), (k % 7).cast("string"), F.lit(" "), (k % 5).cast("string"), F.lit(" 0")), F.lit("scale 2 3 1"), F.lit("v 0 0 0"), F.lit("v 1 0 0"), F.concat(F.lit("v 0 1 "), (k % 3).cast("string")), F.lit("f 1 2 3"), F.lit("end"))
    inner = rows.select("section", "at", F.posexplode(text).alias("i", "text"))
    nation = rows.select("section").distinct()
    opened = F.array(F.lit("begin"), F.concat(F.lit("trans "), F.col("section").cast("string"), F.lit(" 0 1")))
    before = nation.select("section", F.lit(-1).cast("long").alias("at"), F.posexplode(opened).alias("i", "text"))
    after = nation.select("section", F.lit(1 << 40).alias("at"), F.lit(0).alias("i"), F.lit("end").alias("text"))
    mesh = smf.read(spark, _lines_of(before.unionByName(inner).unionByName(after), "scene"))
    met = elem_vertex(mesh.elem).join(mesh.vertex.withColumnRenamed("id", "vid"), "vid")
    return met.groupBy("id").agg(*[F.round(F.sum(c), 6).alias(c) for c in "xyz"])
