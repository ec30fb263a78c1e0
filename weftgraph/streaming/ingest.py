"""Streaming ingestion of edges.

Refinement isn't monotone under inserts, so there is no incremental state to keep: each micro-batch is appended to the
edge table, and the graphs that it touches are refined anew, all in one loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.refine import refine, with_class


def refine_stream(edges: DataFrame, nodes: Callable[[], DataFrame], table: str, results: str, checkpoint: str, modes: tuple[str, ...] = ("full",), once: bool = False) -> StreamingQuery:
    """Append streamed edges (graph_id, src, dst, count) to ``table``; write classes of touched graphs to ``results``."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.withColumn("batch", _lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        touched = df.select("graph_id").distinct()
        whole = spark.read.parquet(table).groupBy("graph_id", "src", "dst").sum("count").withColumnRenamed("sum(count)", "count").join(touched, "graph_id", "left_semi")
        colors = refine(nodes().join(touched, "graph_id", "left_semi"), whole, modes)[0]
        with_class(colors).select("graph_id", "mode", "id", "class_id").withColumn("batch", _lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(results)

    writer = edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _lit(number: int):
    from pyspark.sql import functions as F

    return F.lit(number)
