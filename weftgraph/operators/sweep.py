"""Running maxima over a global sort, and the interval look-up that they make: no row is copied, no group is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.session import cut


def running_max(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of the rows before, by ``order`` within ``group``; null where there is none.

    Rows are dealt by range, so a group may span many tasks. A window sees one range of a group; what a range hands on to
    the next is one row, the maximum of its last group, and these rows are few: one a range.
    """
    spread = cut(rows.withColumn("value__", value).repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at__", F.monotonically_increasing_id()))
    part = F.shiftright("at__", 33)
    ends = spread.groupBy(part.alias("part__"), group).agg(F.max("value__").alias("most__"), F.max("at__").alias("end__"))
    last = ends.groupBy("part__").agg(F.max_by(F.struct(F.col(group).alias("g"), "most__"), "end__").alias("last"), F.count("*").alias("groups__"))
    upto = F.max("last.most__").over(Window.partitionBy("last.g").orderBy("part__"))  # a row a range
    carried = last.select("part__", "last.g", upto.alias("upto__")).withColumns({"heir__": F.lead("part__").over(Window.orderBy("part__"))})
    carried = carried.where("heir__ is not null").select(F.col("heir__").alias("part__"), F.col("g").alias(group), F.col("upto__").alias("carried__"))
    before = Window.partitionBy("part__", group).orderBy("at__").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("part__", part).withColumn("here__", F.max("value__").over(before))
    out = spread.join(F.broadcast(carried), ["part__", group], "left").withColumn(name, F.greatest("here__", "carried__"))
    return out.select(*rows.columns, name)


def first_holding(points: DataFrame, extents: DataFrame, group: str, point: str) -> DataFrame:
    """(group, point, around): the smallest ``start`` of the ``extents`` (group, start, stop) that hold the point.

    In the order of their starts, only an extent that ends after all before it can be the first to hold a point, and it is
    that from where the earlier ones end: those stretches don't overlap. So each point belongs to the last stretch that
    begins at or before it, or to none. Points come distinct.
    """
    lasting = running_max(extents.select(group, "start", "stop").where("start is not null and stop > start"), group, ["start", "stop"], F.col("stop"), "ended")
    stretches = lasting.where("ended is null or stop > ended").select(group, F.greatest("start", "ended").alias("at"), F.lit(0).alias("is_point"), "start", "stop")
    none = F.lit(None).cast("bigint")
    events = stretches.unionByName(points.where(F.col(point).isNotNull()).select(group, F.col(point).alias("at"), F.lit(1).alias("is_point"), none.alias("start"), none.alias("stop")))
    placed = running_max(events, group, ["at", "is_point"], F.when(F.col("is_point") == 0, F.struct("at", "start", "stop")), "own")
    inside = (F.col("own.start") <= F.col("at")) & (F.col("at") < F.col("own.stop"))
    return placed.where((F.col("is_point") == 1) & inside).select(group, F.col("at").alias(point), F.col("own.start").alias("around"))
