"""Consecutive numbers within keys, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.session import cut


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based place ``name`` of each row by ``order`` within ``keys``; (keys, order) must be unique.

    Rows are dealt by range and counted by range, so a key may span many tasks; what a window sees is one range, or one
    count per range.
    """
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("part__", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "part__").agg(F.count("*").alias("rows__"))
    before = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "part__", F.coalesce(F.sum("rows__").over(before), F.lit(0)).alias("offset__"))
    place = F.row_number().over(Window.partitionBy(*keys, "part__").orderBy(*order)) - 1 + F.col("offset__")
    return parts.join(offsets, [*keys, "part__"]).withColumn(name, place.cast("bigint")).drop("part__", "offset__")
