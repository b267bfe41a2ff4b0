"""Tag updates as a stream: the last value of each entity, kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(updates: DataFrame) -> DataFrame:
    """(etype, id, value): of rows (etype, id, at, value) the value with the greatest time, the greater value on ties.

    Works on a table and on a stream (output mode update or complete).
    """
    return updates.groupBy("etype", "id").agg(F.max(F.struct("at", "value")).alias("m")).select("etype", "id", F.col("m.value").alias("value"))
