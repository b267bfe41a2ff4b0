"""Text files of cards and of plain tables: bulk data with fields of eight columns, keyword files, node and element lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import CORNERS, EDGES, FACES
from ..model import ETYPES, Mesh, MeshError, Tag
from ..storage import written
from . import lines as L

# Cards of elements with the entity type.
NASTRAN = {"CROD": "EDGE", "CBAR": "EDGE", "CBEAM": "EDGE", "CTRIA3": "TRI", "CTRIAR": "TRI", "CTRIA6": "TRI", "CQUAD4": "QUAD", "CQUADR": "QUAD", "CQUAD8": "QUAD", "CTETRA": "TET", "CPYRAM": "PYRAMID", "CPENTA": "PRISM", "CHEXA": "HEX"}
#: Bars have an orientation after their two nodes; other cards have nodes only.
BARS = ("CROD", "CBAR", "CBEAM")
# Element names of keyword files (without what follows the number of nodes), with the entity type.
ABAQUS = {
    **dict.fromkeys(("T2D2", "T3D2", "B21", "B31", "DC1D2"), "EDGE"),
    **dict.fromkeys(("T2D3", "T3D3", "B22", "B32", "DC1D3"), "EDGE"),
    **dict.fromkeys(("S3", "CPS3", "CPE3", "CAX3", "M3D3", "R3D3", "DC2D3", "CPS6", "CPE6", "CAX6", "M3D6", "DC2D6", "STRI3", "STRI65"), "TRI"),
    **dict.fromkeys(("S4", "DS4", "CPS4", "CPE4", "CAX4", "M3D4", "R3D4", "DC2D4", "S8", "DS8", "CPS8", "CPE8", "CAX8", "M3D8", "DC2D8", "M3D9", "S9"), "QUAD"),
    **dict.fromkeys(("C3D4", "DC3D4", "C3D10", "DC3D10"), "TET"),
    **dict.fromkeys(("C3D5", "DC3D5", "C3D13"), "PYRAMID"),
    **dict.fromkeys(("C3D6", "DC3D6", "C3D15", "DC3D15", "SC6"), "PRISM"),
    **dict.fromkeys(("C3D8", "DC3D8", "DCC3D8", "SC8", "C3D20", "DC3D20"), "HEX"),
}
# Node counts of elements; letters that may follow a name in keyword files.
NODES = {"EDGE": (2, 3), "TRI": (3, 6), "QUAD": (4, 8, 9), "TET": (4, 10), "PYRAMID": (5, 13), "PRISM": (6, 15), "HEX": (8, 20, 27)}
SUFFIX = r"(R|H|I|M|T|E|P|D|OS|S|5|HT|RH|RT|IH|RS|PR|HR)*$"
# Edges in the order in which keyword files have their middle nodes, where it isn't the canonical one.
ABAQUS_EDGES = {"HEX": "01 12 23 30 45 56 67 74 04 15 26 37", "PRISM": "01 12 20 34 45 53 03 14 25", "PYRAMID": "01 12 23 30 04 14 24 34"}


def canonical(name: str, n: int, edges: str, faces: str = "") -> list[int]:
    """For each place in the canonical order of an element of n nodes, the place in a file that has middle nodes in another order of edges and faces."""
    order = list(range(CORNERS[name]))
    for table, text in ((EDGES, edges), (FACES, faces)):
        if len(order) < n and text and name in table:
            mine = [frozenset(side) for side in text.split()]
            order += [len(order) + mine.index(frozenset(side)) for side in table[name].split()]
    return order + list(range(len(order), n))


def checked(elem: DataFrame, kind: str) -> DataFrame:
    """Elements (etype, id, conn, kind, ...) as they are; an error if a type is unknown or has another number of nodes than its kind says."""
    counts = F.lit(False)
    for name, sizes in NODES.items():
        counts = counts | ((F.col("etype") == ETYPES[name]) & F.size("conn").isin(*sizes))
    whole = F.coalesce(counts, F.lit(False)) & F.col("id").isNotNull() & F.forall("conn", lambda v: v.isNotNull())
    bad = elem.filter(~whole).select(kind, "id", F.size("conn").alias("n")).limit(1).collect()
    if bad:
        raise MeshError(f"element {bad[0][1]} of type {bad[0][0]!r} can't be read with {bad[0][2]} nodes")
    return elem


def real(text: Column) -> Column:
    """A number that may have an exponent without a letter, as in 1.5-3."""
    return F.regexp_replace(F.trim(text), r"(?<=[0-9.])([+-][0-9]+)$", "E$1").try_cast("double")


def placed(vertex: DataFrame) -> DataFrame:
    """Vertices (id, x, y, z), written; an error if a number or a coordinate couldn't be read."""
    vertex = written(vertex, "nodes")
    if not vertex.filter("id is null or x is null or y is null or z is null").isEmpty():
        raise MeshError("a vertex has no number or no coordinates")
    return vertex


def _card_fields(text: Column) -> Column:
    """The fields of one line after its name: four of 16 columns where the name has an asterisk, between commas, or eight of 8 columns."""
    large = F.contains(F.substring(text, 1, 8), F.lit("*"))
    fixed = lambda n, width: F.array(*[F.trim(F.substring(text, 9 + width * i, width)) for i in range(n)])
    free = F.transform(F.slice(F.split(text, ","), 2, 100), F.trim)
    count = F.when(large, 4).otherwise(8)
    filled = F.slice(F.concat(free, F.array_repeat(F.lit(""), 8)), F.lit(1), count)
    return F.when(F.contains(text, F.lit(",")), filled).when(large, fixed(4, 16)).otherwise(fixed(8, 8))


def nastran(spark: SparkSession, path: str) -> Mesh:
    """Grid points and elements of bulk data, with their numbers as ids; property numbers are the tag MATERIAL_SET.

    Fields are 8 columns wide, 16 where the card's name has an asterisk, or stand between commas, line by line. A card goes on in lines
    that begin with a plus sign, an asterisk, a comma or blanks, as many as there are. Elements of second order keep
    their middle nodes, all or none; any other number of nodes is an error. Cards other than GRID and NASTRAN are skipped.
    """
    rows = L.lines(spark, path).filter(~F.col("text").startswith("$") & (F.trim("text") != ""))
    cards = L.records(rows, ~F.col("text").rlike(r"^(\+|\*|,|        )"))
    name = F.upper(F.regexp_extract(F.get("texts", F.lit(0)), r"^([A-Za-z][A-Za-z0-9]*)", 1))
    cards = cards.select(name.alias("card"), F.flatten(F.transform("texts", _card_fields)).alias("f")).filter(F.col("card").isin("GRID", *NASTRAN))
    get = lambda i: F.get("f", F.lit(i))
    vertex = cards.filter("card = 'GRID'").select(get(0).try_cast("long").alias("id"), *[F.when(F.coalesce(get(i + 2), F.lit("")) == "", 0.0).otherwise(real(get(i + 2))).alias(c) for i, c in enumerate("xyz")])
    etype = None
    for card, kind in NASTRAN.items():
        etype = (F.when if etype is None else etype.when)(F.col("card") == card, ETYPES[kind])
    named = F.when(F.col("card").isin(*BARS), F.slice("f", 3, 2)).otherwise(F.slice("f", 3, 1000))
    conn = F.transform(F.filter(named, lambda v: v != ""), lambda v: v.try_cast("long"))
    elem = cards.filter("card <> 'GRID'").select("card", etype.alias("etype"), get(0).try_cast("long").alias("id"), conn.alias("conn"), get(1).try_cast("long").alias("value"))
    elem = checked(written(elem, "cards"), "card")
    return Mesh(placed(vertex), elem.select("etype", "id", "conn"), {"MATERIAL_SET": Tag(elem.select("etype", "id", "value").filter(F.col("value").isNotNull()))})


def abaqus(spark: SparkSession, path: str) -> Mesh:
    """Nodes and elements of a keyword file; element sets named in the element keyword are the string tag NAME.

    Lines that end in a comma go on in the next one, keywords and data alike. Elements of second order keep their
    middle nodes, in canonical order. An unknown element type, or a number of nodes that its type doesn't have, is an error.
    """
    rows = L.lines(spark, path).filter(~F.col("text").startswith("**") & (F.trim("text") != ""))
    whole = L.records(rows, ends=(~F.col("text").rlike(r",\s*$")).cast("long")).select("line", F.array_join("texts", " ").alias("text"))
    rows = L.sections(whole, r"^\*").withColumn("head", F.upper("head"))
    get = lambda i: F.get("w", F.lit(i))
    node = rows.filter(F.col("head").rlike(r"^\*NODE\s*(,|$)")).select(L.words(F.col("text")).alias("w")).filter(F.size("w") > 1)
    vertex = node.select(get(0).try_cast("long").alias("id"), *[F.when(F.size("w") > i + 1, get(i + 1).try_cast("double")).otherwise(0.0).alias(c) for i, c in enumerate("xyz")])
    every = rows.filter(F.col("head").rlike(r"^\*ELEMENT\s*,")).select("head", F.transform(L.words(F.col("text")), lambda w: w.try_cast("long")).alias("w")).filter(F.size("w") > 1)
    kind = F.regexp_extract("head", r"TYPE\s*=\s*([A-Z0-9]+)", 1)
    etype, nodes = None, F.slice("w", 2, 1000)
    for name, entity in sorted(ABAQUS.items(), key=lambda x: -len(x[0])):
        etype = (F.when if etype is None else etype.when)(F.col("kind").rlike(f"^{name}{SUFFIX}"), ETYPES[entity])
    elem = every.select(kind.alias("kind"), get(0).alias("id"), nodes.alias("conn"), F.regexp_extract("head", r"ELSET\s*=\s*([^,\s]+)", 1).alias("value")).withColumn("etype", etype)
    elem = checked(written(elem, "elements"), "kind")
    conn = F.col("conn")
    for name, edges in ABAQUS_EDGES.items():
        n = NODES[name][1]
        order = F.array(*[F.get("conn", F.lit(i)) for i in canonical(name, n, edges)])
        conn = F.when((F.col("etype") == ETYPES[name]) & (F.size("conn") == n), order).otherwise(conn)
    return Mesh(placed(vertex), elem.select("etype", "id", conn.alias("conn")), {"NAME": Tag(elem.filter("value <> ''").select("etype", "id", "value"))})


def _universal(rows: DataFrame, number: int) -> DataFrame:
    """Lines (line, text, at) of the datasets with a number; at counts them from 0."""
    return L.filled(rows.filter(F.col("number") == number).select(F.col("head_line"), "line", "text"))


def ideas(spark: SparkSession, path: str) -> Mesh:
    """Nodes (dataset 2411) and elements (2412) of a universal file, with their labels as ids.

    Datasets stand between lines of -1; the line after the first has the number. A node has two lines, an
    element two, three if it is a beam, and more where its nodes fill one. The tag MATERIAL_SET is the material number,
    PHYSICAL_SET the property number. An element of a kind other than those of first order in IDEAS
    is an error; other datasets are skipped.
    """
    rows = L.lines(spark, path)
    bound = L.counted(rows.select(F.lit(0).alias("head_line"), "line", "text"), F.col("text").rlike(r"^\s*-1\s*$").cast("long"))
    own = bound.filter(~F.col("text").rlike(r"^\s*-1\s*$") & (F.col("before") % 2 == 1)).select(F.col("before").alias("head_line"), "line", "text")
    first = own.groupBy("head_line").agg(F.min_by(F.trim("text"), "line").alias("number"), F.min("line").alias("first"))  # a row a dataset
    rows = own.join(first, "head_line").filter("line > first").select("head_line", "line", "text", F.col("number").try_cast("int").alias("number"))
    get = lambda i: F.get("w", F.lit(i))
    node = _universal(rows, 2411).withColumn("pair", F.floor(F.col("at") / 2)).groupBy("head_line", "pair").agg(F.min_by("text", "line").alias("a"), F.max_by("text", "line").alias("b"))
    place = F.transform(L.words(F.col("b")), lambda w: F.regexp_replace(w, "[Dd]", "E").try_cast("double"))
    vertex = node.select(F.get(L.words(F.col("a")), F.lit(0)).try_cast("long").alias("id"), place.alias("w")).select("id", *[get(i).alias(c) for i, c in enumerate("xyz")])
    # an element's first line has six numbers in fields of ten columns, of which the last counts its nodes; lines of nodes follow, eight in each
    every = _universal(rows, 2412).select("head_line", "line", F.transform(L.words(F.col("text")), lambda w: w.try_cast("long")).alias("w"))
    return Mesh(placed(vertex), *_ideas_elements(every))


# Element kinds of universal files with entity type; beams have a line of their own after the first.
IDEAS = {**dict.fromkeys((11, 21, 22, 23), "EDGE"), **dict.fromkeys((41, 51, 61, 74, 81, 91), "TRI"), **dict.fromkeys((44, 54, 64, 71, 84, 94), "QUAD"), 111: "TET", 112: "PRISM", 115: "HEX"}
IDEAS_BEAMS = (11, 21, 22, 23, 24)


def _ideas_elements(lines: DataFrame) -> tuple[DataFrame, dict[str, Tag]]:
    """Elements of lines (head_line, line, w): a first line is told from lines of nodes by where the record before it ends.

    That is a walk along the lines; it is taken chunk by chunk for each of the ways in which a chunk can begin (so
    many lines to skip), and the chunks' ways are then followed in order.
    """
    from pyspark.sql import Window

    chunk = F.floor(F.col("line") / L.CHUNK)
    rows = lines.select("head_line", "line", "w", chunk.alias("chunk"))
    packed = rows.groupBy("head_line", "chunk").agg(F.array_sort(F.collect_list(F.struct("line", "w"))).alias("rows"))
    get = lambda r, i: F.get(r["w"], F.lit(i))
    # lines that follow a first line: one for a beam, then as many as its nodes fill
    more = lambda r: F.ceil(get(r, 5) / 8).cast("int") + get(r, 1).isin(*IDEAS_BEAMS).cast("int")
    step = lambda skip, r: F.when(skip > 0, skip - 1).otherwise(F.coalesce(more(r), F.lit(0)))
    ways = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda s: F.aggregate("rows", s, step))
    chunks = written(packed.withColumn("ways", ways), "element-chunks")
    order = Window.partitionBy("head_line").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.aggregate(F.coalesce(F.collect_list("ways").over(order), F.array().cast("array<array<int>>")), F.lit(0), lambda skip, w: F.get(w, skip))
    starts = chunks.select("head_line", "chunk", ahead.alias("skip"))  # seven numbers a chunk
    walked = chunks.join(starts, ["head_line", "chunk"])
    empty = F.array().cast("array<struct<line:bigint,first:boolean>>")
    marks = F.aggregate("rows", F.struct(F.col("skip").alias("skip"), empty.alias("out")), lambda acc, r: F.struct(step(acc["skip"], r).alias("skip"), F.concat(acc["out"], F.array(F.struct(r["line"].alias("line"), (acc["skip"] == 0).alias("first")))).alias("out")), lambda acc: acc["out"])
    marked = walked.select("head_line", F.explode(F.arrays_zip("rows", marks.alias("marks"))).alias("z")).select("z.rows.line", "z.rows.w", F.col("z.marks.first").alias("first"))
    carried = L.carried(marked, F.when(F.col("first"), F.col("line")))
    whole = carried.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("line", "w"))).alias("all"))
    head = F.get("all", F.lit(0))["w"]
    beam = F.get(head, F.lit(1)).isin(*IDEAS_BEAMS)
    nodes = F.flatten(F.transform(F.slice("all", F.when(beam, 3).otherwise(2), F.lit(100)), lambda x: x["w"]))
    etype = None
    for number, name in IDEAS.items():
        etype = (F.when if etype is None else etype.when)(F.get(head, F.lit(1)) == number, ETYPES[name])
    elem = whole.select(etype.alias("etype"), F.get(head, F.lit(0)).alias("id"), nodes.alias("conn"), F.get(head, F.lit(1)).alias("kind"), F.get(head, F.lit(2)).alias("physical"), F.get(head, F.lit(3)).alias("material"))
    elem = checked(written(elem, "elements"), "kind")
    tag = lambda c: Tag(elem.select("etype", "id", F.col(c).alias("value")))
    return elem.select("etype", "id", "conn"), {"MATERIAL_SET": tag("material"), "PHYSICAL_SET": tag("physical")}


def _table(spark: SparkSession, path: str) -> DataFrame:
    """(w): the words of each line after the first that isn't a comment."""
    rows = L.lines(spark, path).select("line", L.words(F.regexp_replace("text", "#.*$", "")).alias("w")).filter(F.size("w") > 0)
    first = rows.agg(F.min("line").alias("first"))  # one row
    return rows.join(F.broadcast(first), F.col("line") > F.col("first")).select("w")


def node_list(spark: SparkSession, nodes: str, elements: str | None = None, faces: str | None = None) -> Mesh:
    """The mesh of a node file with a file of tetrahedra, of triangles, or of both; each has a first line of counts."""
    get = lambda i: F.get("w", F.lit(i))
    vertex = _table(spark, nodes).select(get(0).cast("long").alias("id"), *[get(i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])
    parts = []
    for path, kind, n in ((elements, "TET", 4), (faces, "TRI", 3)):
        if path:
            parts.append(_table(spark, path).select(F.lit(ETYPES[kind]).alias("etype"), get(0).cast("long").alias("id"), F.transform(F.slice("w", 2, n), lambda v: v.cast("long")).alias("conn")))
    elem = parts[0] if parts else spark.createDataFrame([], "etype int, id long, conn array<bigint>")
    for p in parts[1:]:
        elem = elem.unionByName(p)
    return Mesh(vertex, elem)
