"""Text files as numbered lines, sections and tokens, and text files from numbered lines, without a whole file in one task.

A path is one file, or a folder whose part files are one after another by name. A line's number comes from
its place in the block that a task read and the lines of the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines in a chunk, inside which counts are summed one by one.
CHUNK = 4096


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): the lines of a file, numbered from 1, empty ones too."""
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    size = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = size.select("file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return raw.join(before, ["file", "block"]).select((F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), F.regexp_replace("text", "\\r$", "").alias("text"))


def carried(rows: DataFrame, mark: Column) -> DataFrame:
    """rows (line, ...) with mark: that of the last line up to each whose mark isn't null. Marks grow with the lines.

    Each line's chunk is summed up in one row; chunks are scanned in order, lines only inside their chunk.
    """
    rows = rows.withColumn("__mark", mark).withColumn("__chunk", F.floor(F.col("line") / CHUNK))
    ahead = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = rows.groupBy("__chunk").agg(F.max("__mark").alias("__m")).select("__chunk", F.max("__m").over(ahead).alias("__before"))
    own = F.max("__mark").over(Window.partitionBy("__chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("__own", own).join(before, "__chunk")
    return met.withColumn("mark", F.coalesce("__own", "__before")).drop("__mark", "__chunk", "__own", "__before")


def sections(rows: DataFrame, head: str) -> DataFrame:
    """(head_line, head, line, text): lines after each line that matches head, up to the next one that does."""
    met = carried(rows.select("line", "text"), F.when(F.col("text").rlike(head), F.struct("line", "text")))
    return met.filter("mark is not null and line > mark.line").select(F.col("mark.line").alias("head_line"), F.trim("mark.text").alias("head"), "line", "text")


def records(rows: DataFrame, begins: Column | None = None, *, ends: Column | None = None) -> DataFrame:
    """(line, texts): lines put together to records, in order; line is the first one's.

    A record begins with each line for which `begins` holds (lines before the first of them are left out), or
    after each line for which `ends` holds. A record's lines are one row, as its fields are one element.
    """
    if begins is not None:
        rows = carried(rows.select("line", "text"), F.when(begins, F.col("line"))).filter("mark is not null")
    else:
        rows = counted(rows.select(F.lit(0).alias("head_line"), "line", "text"), ends).withColumnRenamed("before", "mark")
    grouped = rows.groupBy("mark").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    return grouped.select("line", F.transform("all", lambda x: x["text"]).alias("texts"))


def counted(rows: DataFrame, size: Column) -> DataFrame:
    """rows (head_line, line, ..) with before: the sizes of the earlier rows of the section, added up."""
    rows = rows.withColumn("__size", size.cast("long")).withColumn("__chunk", F.floor(F.col("line") / CHUNK))
    chunks = rows.groupBy("head_line", "__chunk").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy("head_line").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    chunks = chunks.select("head_line", "__chunk", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum("__size").over(Window.partitionBy("head_line", "__chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = rows.withColumn("__own", own).join(chunks, ["head_line", "__chunk"])
    return met.withColumn("before", F.col("__base") + F.col("__own")).drop("__own", "__base", "__size", "__chunk")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,]+"), lambda w: w != "")


def tokens(rows: DataFrame) -> DataFrame:
    """(head_line, head, at, token): the words of each section, numbered from 0."""
    own = words(F.col("text"))
    placed = counted(rows, F.size(own)).select("head_line", "head", "before", F.posexplode(own).alias("i", "token"))
    return placed.select("head_line", "head", (F.col("before") + F.col("i")).alias("at"), "token")


def filled(rows: DataFrame) -> DataFrame:
    """Rows of sections whose lines aren't blank, with at: their number in the section, from 0."""
    some = rows.filter(F.trim("text") != "")
    return counted(some, F.lit(1)).withColumnRenamed("before", "at")


def points(coordinates: DataFrame) -> DataFrame:
    """(id, x, y, z) of tokens (at, token) that name three coordinates a point; ids begin at 1."""
    axis = F.col("at") % 3
    value = F.col("token").try_cast("double")
    named = [F.max(F.when(axis == i, value)).alias(c) for i, c in enumerate("xyz")]
    return coordinates.groupBy((F.floor(F.col("at") / 3) + 1).alias("id")).agg(*named)


def write(rows: DataFrame, path: str) -> None:
    """Write rows (section, at, text) as a folder of part files that, one after another by name, are the lines in order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "section", "at").sortWithinPartitions("section", "at").select("text").write.text(path)


def heading(spark: SparkSession, section: int, *text: str) -> DataFrame:
    return spark.createDataFrame([(section, i - len(text), t) for i, t in enumerate(text)], "section int, at long, text string")


def number(value: Column) -> Column:
    """A double as text that reads back as the same value."""
    return value.cast("double").cast("string")
