"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of the source. Documents
stand in the order of their sizes, expected copies are summed up along it, one offset is added, and a
document is emitted once for each whole number that its stretch of the sum passes. As sizes rise slowly
along the order, the words taken come near the target.

The place of a document in its source needs no global sort: places are counts of the smaller sizes (one
aggregated row a size), of the smaller slots in the same size, and of the documents before it in the same
slot. Slots are `SLOTS` remainders of the id, so that very many documents of one source and size are dealt
over as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

WEIGHTS = (5, 2, 1)
#: The most copies expected of a document.
MOST = 3
#: Expected copies are whole multiples of 1 / UNIT, so that sums are exact.
UNIT = 1 << 20
SLOTS = 1024
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ["size", "source_size", "target", "copies", "taken"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column, seed: int) -> Column:
    """The offset of a source in 0 .. UNIT - 1: digits of a digest, the same on each run."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(UNIT))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) of rows (source, source_size), one a source.

    All sizes are shared by weight; a target stops at `most` times its source's size and the excess is shared
    again. That has a closed form: in the order of size / weight, the first sources stop and the others get
    the same level times their weight. The windows run over one aggregated row a source.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", kind.cast("long")).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum("source_size").over(every).alias("all"), F.sum("w").over(every).alias("w_all"), F.sum("cap").over(upto).alias("cap_to"), F.sum("w").over(upto).alias("w_to"))
    # a source stops if the level that is left for it and all after it would lift it above its cap
    before = (F.col("all") - (F.col("cap_to") - F.col("cap"))) / (F.col("w_all") - (F.col("w_to") - F.col("w")))
    rows = rows.withColumn("stops", before * F.col("w") > F.col("cap"))
    left = F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(every)
    rest = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).over(every)
    rows = rows.withColumn("level", (F.col("all") - left) / F.nullif(rest, F.lit(0)))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    rows = rows.withColumn("target", F.coalesce(target, F.lit(0.0)))
    rate = F.least(F.lit(most * UNIT).cast("long"), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * UNIT + 0.5))
    return rows.select("source", "source_size", "target", F.coalesce(rate, F.lit(0)).cast("long").alias("rate"))


def mix(docs: DataFrame, *, text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """docs (or only the columns in `carry`) with size, source_size, target, copies and taken.

    Null texts have size 0; a source whose sizes are all 0 has target 0. A null source is a source of its own,
    after all others. Among equal sizes the order is by doc_id, nulls first; repeated rows take places one
    after the other and may differ in copies. Columns of docs with the added names are replaced.
    """
    named = without(docs, ADDED)
    keep = [c for c in named.columns if carry is None or c in carry]
    slot = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(SLOTS))
    rows = named.select(*[F.col(f"`{c}`") for c in keep], size_of(F.col(text)).alias("size"), F.struct(F.col("source").alias("source"), slot.alias("slot")).alias("__at"))
    counts = rows.groupBy(F.col("__at.source").alias("source"), "size", F.col("__at.slot").alias("slot")).agg(F.count("*").alias("n"))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    smaller = by_size.withColumn("smaller", F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.withColumn("before", before).alias("c").join(smaller.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.size") == F.col("s.size")))
    places = places.join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    places = places.select(F.struct(F.col("c.source").alias("source"), F.col("c.slot").alias("slot")).alias("__place"), F.col("c.size").alias("__size"), (F.coalesce("before", F.lit(0)) + F.coalesce("smaller", F.lit(0))).alias("__before"), "source_size", "target", "rate", offset_of(F.col("c.source"), seed).alias("__offset"))
    own = F.row_number().over(Window.partitionBy("__at", "size").orderBy(F.col("doc_id").asc_nulls_first()))
    met = rows.withColumn("__own", own).join(places, (F.col("__at") == F.col("__place")) & (F.col("size") == F.col("__size")))
    place = F.col("__before") + F.col("__own")
    shift = UNIT.bit_length() - 1
    copies = F.shiftright(place * F.col("rate") + F.col("__offset"), shift) - F.shiftright((place - 1) * F.col("rate") + F.col("__offset"), shift)
    return met.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy that mix() gives, numbered from 1 in the column copy."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
