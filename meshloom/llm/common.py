"""Shared helpers of the training-data operators: reading tables, shared storage, text batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the text contracts: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python task turns into arrays at once; one longer text is a batch of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that materialize() wrote and nothing deleted, in order.
_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until the surrounding scratch() ends, as later plans may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, *, keep: int = 0) -> Iterator[None]:
    """At its end, delete the tables written inside it but the last `keep`: no plan may read the others any more."""
    begin = len(_written)
    yield
    gone = _written[begin : len(_written) - keep]
    del _written[begin : len(_written) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k)), F.lit(0)).cast("int")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (names compare as Spark compares them)."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def added(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def text_chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of runs of rows with at most `budget` bytes together, or of one row; null is empty."""
    binary = column.cast(pa.large_binary())
    size = [n or 0 for n in pa.compute.binary_length(binary).to_pylist()]
    lo = total = 0
    for i, n in enumerate([*size, budget + 1]):
        if i > lo and total + n > budget:
            yield lo, [b or b"" for b in binary.slice(lo, i - lo).to_pylist()]
            lo, total = i, 0
        total += n
