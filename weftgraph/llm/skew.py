"""Joins to an index whose hot keys may hold a large share of all rows, and dropping rows that an operator decided on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys with over 1/HEAVY of all rows are joined by broadcast. Counting bounds them: there are under HEAVY.
HEAVY = 1000


def look_up(rows: DataFrame, index: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``index`` (one row for each ``key``, ``size`` rows of ``rows`` each) without skew.

    Rows of hot keys meet a broadcast where they are, rows without a key meet nothing, and only the others are
    shuffled. ``rows`` is read once for each of the three, so it should be a table or a checkpoint.
    """
    values = [c for c in index.columns if c not in (key, size)]
    bound = max(2, total // HEAVY)
    heavy, light = (index.where(F.col(size) > bound), index.where(F.col(size) <= bound))
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    bare = rows.where(F.col(key).isNull())
    kinds = dict(index.dtypes)
    out = hot.select(*rows.columns, *values).unionByName(rest.select(*rows.columns, *values))
    return out.unionByName(bare.select(*rows.columns, *[F.lit(None).cast(kinds[v]).alias(v) for v in values]))


def text_tag(text: Column) -> Column:
    """Digest of a raw text; with the doc_id it names a row up to exact repeats. Null counts as empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has none of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(docs: DataFrame, decided: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``decided`` (doc_id, tag, stays) drops, by doc_id and ``text_tag``.

    So a row that stays isn't lost with another one of its doc_id, and null ids drop like others. Of rows that repeat
    the doc_id and text of a row in a group of copies (``copied``), one stays. Only the dropped keys are joined: the
    text moves at most once, and not at all where they are few. No column name of ``docs`` is reserved.
    """
    row_tag, its_id, its_tag, found = unused(docs, "row_tag", "its_id", "its_tag", "found")
    same = lambda keys: keys.select(F.col("doc_id").alias(its_id), F.col("tag").alias(its_tag), F.lit(True).alias(found))
    key = F.col(doc_id).cast("long").eqNullSafe(F.col(its_id)) & (F.col(row_tag) == F.col(its_tag))
    tagged = docs.withColumn(row_tag, text_tag(F.col(text)))
    rest = tagged.join(same(decided.where("not stays").distinct()), key, "left_anti")
    repeated = decided.where("stays and copied").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        repeats = same(repeated)
        single = rest.join(repeats, key, "left_semi").dropDuplicates([doc_id, row_tag])
        rest = rest.join(repeats, key, "left_anti").unionByName(single)
    return rest.select(*docs.columns)
