"""Meshes to query: generated bricks and grids, and mesh views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh, Tag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """Orders with lines as polygons over parts: an order's parts in line order are its connectivity."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    elem = lines.select(F.lit(ETYPES["POLYGON"]).alias("etype"), F.col("l_orderkey").alias("id"), F.transform("lines", lambda s: s["l_partkey"]).alias("conn"))
    key = F.col("p_partkey")
    vertex = table(spark, sf_dir, "part").select(key.alias("id"), (key % 20).cast("double").alias("x"), (F.floor(key / 20) % 20).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    orders = table(spark, sf_dir, "orders")

    def tag(column: str, default: object = None) -> Tag:
        return Tag(orders.select(F.lit(ETYPES["POLYGON"]).alias("etype"), F.col("o_orderkey").alias("id"), F.col(column).alias("value")), default)

    return Mesh(vertex, elem, {"STATUS": tag("o_orderstatus"), "PRIORITY": tag("o_orderpriority")})


def brick(spark: SparkSession, n: int) -> Mesh:
    """n * n * n unit hexes; ids begin at 1 and run along x, then y, then z."""
    m = n + 1
    i = F.col("i")
    vertex = spark.range(m**3).select((F.col("id") + 1).alias("id"), (F.col("id") % m).cast("double").alias("x"), (F.floor(F.col("id") / m) % m).cast("double").alias("y"), F.floor(F.col("id") / (m * m)).cast("double").alias("z"))
    rows = spark.range(n**3).select(F.col("id").alias("i")).withColumn("v", 1 + i % n + m * (F.floor(i / n) % n) + m * m * F.floor(i / (n * n)))
    steps = (0, 1, m + 1, m)
    conn = F.array(*[F.col("v") + s for s in (*steps, *[s + m * m for s in steps])])
    return Mesh(vertex, rows.select(F.lit(ETYPES["HEX"]).alias("etype"), (i + 1).alias("id"), conn.alias("conn")))


def squares(spark: SparkSession, n: int) -> DataFrame:
    """(id, poly): n * n equal squares of the unit square, counterclockwise."""
    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    corner = lambda a, b: F.struct(((i + a) / n).alias("x"), ((j + b) / n).alias("y"))
    return spark.range(n * n).select("id", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("poly"))


def brick_size(spark: SparkSession, sf_dir: str) -> int:
    """How many cells a side a brick has that is about as large as the customer table."""
    count = table(spark, sf_dir, "customer").count()
    n = 1
    while (n + 1) ** 3 <= count:
        n += 1
    return max(2, n)
