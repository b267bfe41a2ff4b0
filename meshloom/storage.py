"""Tables that several plans use: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mesh-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/mesh-tables/{label}-{uuid.uuid4().hex}"


#: Tables that this session wrote and nothing deleted.
_written: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read back: its lineage is cut, and every later plan sees the same rows.

    The files stay until delete_written(), as what was made of them reads them.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> int:
    """Delete all tables that written() made, once no DataFrame that came of them is needed any more; how many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1, within: list[str] | None = None) -> DataFrame:
    """rows with consecutive numbers (long) in the given order, each group of `within` on its own, without a sort in one task.

    Rows are dealt by ranges of the order and written with their range; numbers inside a range start after
    the ranges before it. What passes through one task is one row a range and group.
    """
    within = within or []
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *within, *order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    own = F.row_number().over(Window.partitionBy("__part", *within).orderBy(*order))
    ahead = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__part", *within).agg(F.count("*").alias("__n")).select("__part", *within, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__part", *within)]
    met = dealt.withColumn("__own", own).alias("r").join(F.broadcast(before.alias("b")) if not within else before.alias("b"), keys)
    return met.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("__before") + F.col("__own") + (start - 1)).cast("long").alias(name))
