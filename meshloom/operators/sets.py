"""Sets of entities: algebra, containment, parents and children, runs of ids, merging and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh, Tag, dimension, elem_vertex, etype_of
from ..storage import numbered, written

ID = ["etype", "id"]


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ID).unionByName(b.select(*ID)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ID).intersect(b.select(*ID))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*ID).subtract(b.select(*ID))


def contains(member: DataFrame, wanted: DataFrame, mode: str = "INTERSECT", sets: DataFrame | None = None) -> DataFrame:
    """(set_id): sets with all (INTERSECT) or any (UNION) of the wanted entities.

    Of no entities every set (set_id) has all, and none has any.
    """
    wanted = wanted.select(*ID).distinct()
    met = member.select("set_id", *ID).join(wanted, ID).groupBy("set_id").agg(F.count_distinct(*ID).alias("n"))
    if mode == "UNION":
        return met.select("set_id")
    need = wanted.agg(F.count("*").alias("need"))  # one row
    if sets is not None:
        met = sets.select("set_id").distinct().join(met, "set_id", "left").fillna(0, ["n"])
    return met.join(F.broadcast(need), F.col("n") == F.col("need")).select("set_id")


def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("etype").agg(F.count("*").alias("n"))


def subset(rows: DataFrame, etype: str | int | None = None, dim: int | None = None) -> DataFrame:
    """The entities of a type or of a dimension."""
    if etype is not None:
        rows = rows.filter(F.col("etype") == etype_of(etype))
    return rows if dim is None else rows.filter(dimension(F.col("etype")) == dim)


def indexed(rows: DataFrame) -> DataFrame:
    """(etype, id, pos): the place of each distinct entity in the order of the set, from 0."""
    return numbered(rows.select(*ID).distinct(), ID, "pos", 0)


def between(rows: DataFrame, etype: int, low: int, high: int) -> DataFrame:
    """The entities of a type from id low to id high, both included."""
    return rows.filter((F.col("etype") == etype) & F.col("id").between(low, high))


def add(member: DataFrame, new: DataFrame, ordered: bool = False) -> DataFrame:
    """Members after new rows (set_id, pos, etype, id) were added.

    An unordered set has each entity once. An ordered one keeps repeats; new rows follow the ones it has, in
    the order of their pos.
    """
    keys = ["set_id", *ID]
    if not ordered:
        both = member.select(*keys, "pos").unionByName(new.select(*keys, "pos"))
        return both.groupBy(*keys).agg(F.min("pos").alias("pos")).select("set_id", "pos", *ID)
    top = member.groupBy("set_id").agg((F.max("pos") + 1).alias("top"))
    moved = new.join(top, "set_id", "left").select("set_id", (F.col("pos") + F.coalesce("top", F.lit(0))).alias("pos"), *ID)
    return member.select("set_id", "pos", *ID).unionByName(moved.select("set_id", "pos", *ID))


def remove(member: DataFrame, gone: DataFrame, last_only: bool = False) -> DataFrame:
    """Members without the rows gone (set_id, etype, id): every occurrence, or only the last one of an ordered set."""
    keys = ["set_id", *ID]
    gone = gone.select(*keys).distinct()
    if not last_only:
        return member.join(gone, keys, "left_anti")
    last = member.join(gone, keys, "left_semi").groupBy(*keys).agg(F.max("pos").alias("pos"))
    return member.join(last, [*keys, "pos"], "left_anti").select(*member.columns)


def swap(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members with each old entity of pairs (etype, id, new_id) replaced by its new one of the same type, at its place."""
    met = member.join(pairs.select(*ID, "new_id"), ID, "left")
    return met.select("set_id", "pos", "etype", F.coalesce("new_id", "id").alias("id"))


def add_links(link: DataFrame, new: DataFrame) -> DataFrame:
    return link.select("parent_id", "child_id").unionByName(new.select("parent_id", "child_id")).distinct()


def remove_links(link: DataFrame, gone: DataFrame) -> DataFrame:
    return link.join(gone.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")


def contained(member: DataFrame, start: DataFrame, most: int = 0) -> DataFrame:
    """(set_id, hops): sets held by the start sets, directly or in at most `most` steps; 0: any number."""
    inner = member.filter(F.col("etype") == ETYPES["ENTITYSET"]).select(F.col("set_id").alias("parent_id"), F.col("id").alias("child_id"))
    return hops(inner, start, most)


def runs(ids: DataFrame, part: int = 1 << 20) -> DataFrame:
    """(etype, lo, hi, n): runs of consecutive ids, the compressed form of a set.

    Runs are found inside ranges of `part` ids first, so that no task has all ids of a type; then runs that
    meet at the edge of a range are joined. The second pass has a few rows a range at most for dense sets.
    """
    own = ids.select(*ID).distinct().withColumn("part", F.floor(F.col("id") / part))
    order = Window.partitionBy("etype", "part").orderBy("id")
    first = own.withColumn("g", F.col("id") - F.row_number().over(order)).groupBy("etype", "part", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    low, high = F.col("part") * part, F.col("part") * part + part - 1
    inner = first.filter((F.col("lo") != low) & (F.col("hi") != high)).select("etype", "lo", "hi")
    edge = first.filter((F.col("lo") == low) | (F.col("hi") == high))
    along = Window.partitionBy("etype").orderBy("lo")
    begins = F.coalesce((F.lag("hi").over(along) + 1 != F.col("lo")).cast("int"), F.lit(1))
    joined = edge.withColumn("b", begins).withColumn("g", F.sum("b").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("etype", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("etype", "lo", "hi")
    return inner.unionByName(joined).withColumn("n", F.col("hi") - F.col("lo") + 1)


def hops(link: DataFrame, start: DataFrame, most: int = 0, down: bool = True) -> DataFrame:
    """(set_id, hops): sets reached from start (set_id) over parent-child links in at most `most` steps; 0: any number.

    A set counts at its least number of steps; cycles end, as reached sets aren't visited again. Each round
    is one join on the last round's sets.
    """
    a, b = ("parent_id", "child_id") if down else ("child_id", "parent_id")
    edges = link.select(F.col(a).alias("set_id"), F.col(b).alias("next")).distinct()
    reached = start.select("set_id").distinct().withColumn("hops", F.lit(0))
    last, step = reached, 0
    while not most or step < most:
        step += 1
        last = edges.join(last.select("set_id"), "set_id", "left_semi").select(F.col("next").alias("set_id")).distinct().join(reached, "set_id", "left_anti").withColumn("hops", F.lit(step))
        last = written(last, "hops")
        if not most and last.isEmpty():
            break
        reached = reached.unionByName(last)
    return reached.filter("hops > 0")


def contents(member: DataFrame, start: DataFrame, most: int = 0) -> DataFrame:
    """(etype, id): entities in the start sets and in the sets that they hold, at any depth; the sets themselves don't count."""
    inner = member.filter(F.col("etype") == ETYPES["ENTITYSET"]).select(F.col("set_id").alias("parent_id"), F.col("id").alias("child_id"))
    sets = start.select("set_id").unionByName(hops(inner, start, most).select("set_id")).distinct()
    return member.filter(F.col("etype") != ETYPES["ENTITYSET"]).join(sets, "set_id", "left_semi").select(*ID).distinct()


def reorder(values: DataFrame) -> DataFrame:
    """(etype, id, new_id): ids of each type dealt anew in the order of (value, id), without a sort of a type in one task."""
    return numbered(values.select(*ID, "value"), ["value", "id"], "new_id", 1, ["etype"]).select(*ID, "new_id")


def apply_order(mesh: Mesh, order: DataFrame) -> Mesh:
    """The mesh with ids by order (etype, id, new_id): vertices, elements with their connectivity, tags and members. Others keep theirs."""
    order = order.select(*ID, "new_id")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.join(order, ID, "left").withColumn("id", F.coalesce("new_id", "id")).select(*rows.columns)

    vertex_order = order.filter("etype = 0").select(F.col("id").alias("vid"), "new_id")
    vertex = mesh.vertex.join(vertex_order.withColumnRenamed("vid", "id"), "id", "left").select(F.coalesce("new_id", "id").alias("id"), *"xyz")
    met = elem_vertex(mesh.elem).join(vertex_order, "vid", "left").select(*ID, "pos", F.coalesce("new_id", "vid").alias("vid"))
    conn = met.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("conn"))
    tags = {n: Tag(renamed(t.values), t.default) for n, t in mesh.tags.items()}
    return Mesh(vertex, renamed(conn), tags, mesh.member and renamed(mesh.member), mesh.link)


def order_from_sets(entities: DataFrame, member: DataFrame) -> DataFrame:
    """(etype, id, value): a value to reorder() by, such that entities of the same set stand together: their least set; those in none come last."""
    own = member.groupBy(*ID).agg(F.min("set_id").alias("value"))
    return entities.select(*ID).join(own, ID, "left").select(*ID, F.coalesce("value", F.lit((1 << 63) - 1)).alias("value"))


def merge_sides(elem: DataFrame) -> DataFrame:
    """(etype, id, keep): elements of dimension 1 and 2 with the same vertices are one; keep is the least id. Solids stay apart."""
    rows = elem.filter(dimension(F.col("etype")).isin(1, 2)).select(*ID, F.array_sort("conn").alias("key"))
    low = rows.groupBy("etype", "key").agg(F.min("id").alias("keep"))
    return rows.join(low, ["etype", "key"]).select(*ID, "keep")


def merge_by_value(values: DataFrame) -> DataFrame:
    """(etype, id, keep): the least id of the entities with the same value."""
    low = values.groupBy("etype", "value").agg(F.min("id").alias("keep"))
    return values.select(*ID, "value").join(low, ["etype", "value"]).select(*ID, "keep")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected group, of nodes (n) and pairs (a, b) either way round.

    Labels sink along the pairs, and each takes its label's label, so their reach doubles each round. Minima
    are aggregates; each round is written.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "pairs")
    label = nodes.select(F.col("n").alias("a"), F.col("n").alias("label"))
    while True:
        least = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(least, "a", "left").select("a", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("a").alias("label"), F.col("label").alias("m"))
        new = written(new.join(jump, "label").select("a", F.least("label", "m").alias("label"), "old"), "labels")
        label = new.select("a", "label")
        if new.filter("label <> old").isEmpty():
            return label.select(F.col("a").alias("node"), "label")


def merge_coincident(vertex: DataFrame, tolerance: float) -> DataFrame:
    """(id, keep): vertices nearer than the tolerance are one, chains included; keep is the least id of each chain.

    Pairs meet in grid cells as wide as the tolerance; exact copies are one point before that, so that a large
    heap of copies gives no pairs.
    """
    points = vertex.groupBy(*[(F.col(c) + 0.0).alias(c) for c in "xyz"]).agg(F.min("id").alias("low"))
    cell = points.select("low", *"xyz", *[F.floor(F.col(c) / tolerance).alias("c" + c) for c in "xyz"])
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = cell
    for c in "xyz":
        spread = spread.withColumn("d", F.explode(near)).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d")
    other = spread.select(F.col("low").alias("b"), *[F.col(c).alias("o" + c) for c in "xyz"], "cx", "cy", "cz")
    gap = sum(((F.col(c) - F.col("o" + c)) * (F.col(c) - F.col("o" + c)) for c in "xyz"), F.lit(0.0))
    pairs = cell.join(other, ["cx", "cy", "cz"]).filter((F.col("low") != F.col("b")) & (gap < tolerance * tolerance)).select(F.col("low").alias("a"), "b").distinct()
    label = components(points.select(F.col("low").alias("n")), pairs).select(F.col("node").alias("a"), "label")
    named = vertex.select("id", *[(F.col(c) + 0.0).alias(c) for c in "xyz"]).join(points, list("xyz")).select("id", F.col("low").alias("a"))
    return named.join(label, "a").select("id", F.col("label").alias("keep"))


def create_sets(options: DataFrame, n: int, *, ordered: bool = False, tracking: bool = False) -> DataFrame:
    """Set options (set_id, ordered, tracking) with n more sets, numbered after the greatest id, 1 if there is none."""
    spark = options.sparkSession
    top = options.agg(F.coalesce(F.max("set_id"), F.lit(0)).alias("top"))  # one row
    new = spark.range(1, n + 1).join(F.broadcast(top)).select((F.col("id") + F.col("top")).alias("set_id"), F.lit(ordered).alias("ordered"), F.lit(tracking).alias("tracking"))
    return options.select("set_id", "ordered", "tracking").unionByName(new)


def set_options(member: DataFrame, options: DataFrame) -> DataFrame:
    """Members as their sets' options (set_id, ordered, tracking) want them: each entity once, in the order of types and ids, unless the set is ordered."""
    met = member.join(options.select("set_id", "ordered"), "set_id")
    keep = met.filter("ordered").select(*member.columns)
    once = met.filter(~F.col("ordered")).groupBy("set_id", "etype", "id").agg(F.lit(0).cast("long").alias("pos"))
    placed = numbered(once.drop("pos"), ["etype", "id"], "pos", 0, ["set_id"])
    return keep.unionByName(placed.select(*member.columns))


def clear(member: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without those of the sets gone (set_id); the sets themselves stay."""
    return member.join(gone.select("set_id").distinct(), "set_id", "left_anti")
