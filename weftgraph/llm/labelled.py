"""Labelled rows: the held-out fold, bounded training samples, and the shape of a scoring query."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

#: Rows whose crc32(doc_id as text) leaves HELD_OUT modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 4, 2
#: UTF-8 bytes that a training sample brings to the driver at most: whole texts in the sample's order while they fit.
SAMPLE_BYTES = 96 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) without nulls in the text, whatever other columns there are."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _picked(ids: DataFrame, most: int, rows: int) -> list[int]:
    """At most ``most`` of about ``rows`` ids, chosen by hash. A share is filtered first, so little reaches the driver."""
    if not rows:
        return []
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    share = min(1.0, (1.2 * most + 100) / rows)
    near = ids.select("doc_id", order.alias("h")).where(F.col("h") < F.lit(int(share * (1 << 30))))
    return [r[0] for r in near.orderBy("h", "doc_id").limit(most).collect()]


def _local(spark: SparkSession, **columns: tuple[list, DataType]) -> DataFrame:
    """Bounded lists as a table that the driver holds; from rows Spark would make one in Python workers of their own."""
    return spark.createDataFrame(pa.table({name: pa.array(values, to_arrow_type(kind)) for name, (values, kind) in columns.items()}))


def _texts(docs: DataFrame, ids: list[int]) -> list[str]:
    """Distinct texts of these ids (a bounded list, so it is broadcast), in the order of the ids."""
    if not ids:
        return []
    wanted = _local(docs.sparkSession, doc_id=(ids, docs.schema["doc_id"].dataType), place__=(list(range(len(ids))), LongType()))
    near = docs.join(F.broadcast(wanted), "doc_id").select("place__", "doc_id", "text")
    left, fits = SAMPLE_BYTES, []
    for place, size in sorted((r[0], r[1]) for r in near.groupBy("place__").agg(F.sum(F.octet_length("text"))).collect()):
        if size <= left:
            left -= size
            fits.append(place)
    fitting = _local(docs.sparkSession, place__=(fits, LongType()))
    found = near.join(F.broadcast(fitting), "place__").select("place__", "text").collect()
    return list(dict.fromkeys(t for _, t in sorted((r[0], r[1]) for r in found)))


def _labelled(labels: DataFrame, column: str, doc_id: str) -> DataFrame:
    """(doc_id, y). A doc_id with two labels counts as the larger one."""
    return labels.select(F.col(doc_id).alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))


def samples(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], doc_id: str = "doc_id", text: str = "text") -> dict[int, list[str]]:
    """Texts of each label value outside the held-out fold, at most ``most[value]``; only ids are shuffled."""
    ys = _labelled(labels, column, doc_id).where(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["count"] for r in ys.where(F.col("y").isin(list(most))).groupBy("y").count().collect()}
    rows = documents(docs, doc_id, text)
    return {y: _texts(rows, _picked(ys.where(F.col("y") == y), n, counts.get(y, 0))) for y, n in most.items()}


def unlabelled(docs: DataFrame, labels: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """At most ``most`` texts of rows outside the held-out fold that have no label."""
    rows = documents(docs, doc_id, text)
    ids = rows.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    tried = _picked(ids, 4 * most, rows.count())
    if not tried:
        return []
    near = _local(docs.sparkSession, doc_id=(tried, rows.schema["doc_id"].dataType))
    known = {r[0] for r in labels.select(F.col(doc_id).alias("doc_id")).join(F.broadcast(near), "doc_id", "left_semi").distinct().collect()}
    return _texts(rows, [i for i in dict.fromkeys(tried) if i not in known][:most])


def hidden(docs: DataFrame, labels: DataFrame, column: str, most: int, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """At most ``most`` texts of labelled rows outside the held-out fold, whatever their label: a mixture as unlabelled rows are."""
    ids = _labelled(labels, column, doc_id).where(~held_out(F.col("doc_id"))).select("doc_id")
    return _texts(documents(docs, doc_id, text), _picked(ids, most, ids.count()))
