"""Minimax contiguous partition of atomic groups over a fixed number of shards. DataFrame functions only.

Groups (rows of equal key) are ordered by the 64-bit hash of the key. The smallest capacity that lets a greedy
sweep place every group in at most ``shards`` contiguous runs is found by binary search, and the cuts go where the
greedy sweep of that capacity puts them.

The sweep never needs all groups at once. Groups are first summed into 4096 hash ranges. Seen as divisible, the
ranges bound the capacity from below; seen as atoms, from above. Between the bounds each cut can move only within a
short window, so just the ranges under a window are split again, until each of them is one group. The driver sees
a few thousand sums at each level, whatever the input.

Because a cut is a hash value, a row finds its shard by comparing its own hash with ``shards - 1`` literals: no join.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.session import cut

#: Leading hash bits of the first histogram, and bits added to a range that a cut may fall into.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows that one numbering window holds on average, and the most numbering windows of a shard.
SLOT_ROWS, SLOT_PARTS = 50_000, 4096


def _greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (as indexes of ``prefix``) of greedy runs that hold at most ``capacity``; None where ``shards`` runs don't do."""
    ends, at, last = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        ends.append(at)
        if at == last:
            return ends
    return None


def smallest_capacity(sizes: list[int], shards: int, low: int = 0) -> int:
    """Binary search for the smallest capacity, at least ``low``, whose greedy sweep fits ``shards`` runs."""
    prefix = [0, *accumulate(sizes)]
    low = max(low, max(sizes, default=0), -(-prefix[-1] // shards))
    high = max(low, prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _ranges(groups: DataFrame, atoms: list[tuple] | None) -> list[tuple]:
    """(first hash, bits, size, groups, largest) of each hash range; ``atoms``: the ranges to split again."""
    if atoms is None:
        bits = F.lit(FIRST_BITS)
        inside = groups
    else:
        spark = groups.sparkSession
        listed = json.dumps([{"top": a[0] >> (64 - a[1]), "bits": a[1]} for a in atoms])
        split = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<top:bigint,bits:int>>")))  # no Python rows
        widths = sorted({a[1] for a in atoms})
        inside = groups.select("h", "size", F.explode(F.array(*[F.struct(F.shiftright("h", 64 - w).alias("top"), F.lit(w).alias("bits")) for w in widths])).alias("r"))
        inside = inside.select("h", "size", "r.top", "r.bits").join(F.broadcast(split), ["top", "bits"], "left_semi")  # a few thousand ranges at most
        bits = F.least(F.col("bits") + MORE_BITS, F.lit(64))
    first = F.expr("shiftleft(shiftright(h, 64 - b), 64 - b)")
    rows = inside.withColumn("b", bits.cast("int")).select(first.alias("first"), "b", "size").groupBy("first", "b").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
    return [(r["first"], r["b"], r["size"], r["n"], r["most"]) for r in rows]


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """Hash values at which shards 1, 2, ... begin. groups: (h long, size long), one row per group."""
    atoms = sorted(_ranges(groups, None))
    low = max((a[4] for a in atoms), default=0)
    while True:
        sizes = [a[2] for a in atoms]
        prefix = [0, *accumulate(sizes)]
        total = prefix[-1]
        low = max(low, -(-total // shards))
        high = smallest_capacity(sizes, shards, low)
        if high == low and all(a[3] == 1 for a in atoms):
            break
        below = above = 0
        open_ranges: set[int] = set()
        for _ in range(shards):
            below = prefix[bisect_right(prefix, below + low) - 1]
            above = min(above + high, total)
            open_ranges.update(range(bisect_right(prefix, below) - 1, min(bisect_right(prefix, above), len(atoms))))
        splits = [i for i in open_ranges if atoms[i][3] > 1]
        if not splits:
            break
        finer = _ranges(groups, [atoms[i] for i in splits])
        atoms = sorted([a for i, a in enumerate(atoms) if i not in set(splits)] + finer)
    prefix = [0, *accumulate(a[2] for a in atoms)]
    ends = _greedy(prefix, smallest_capacity([a[2] for a in atoms], shards, low), shards) or []
    return [atoms[e][0] for e in ends if e < len(atoms)]


def assign(rows: DataFrame, h: str, size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` (int): rows of equal hash ``h`` stay together, the largest shard is as small as can be."""
    groups = cut(rows.groupBy(F.col(h).alias("h")).agg(F.sum(size).alias("size")))
    cuts = cut_points(groups, shards)
    return rows.withColumn("shard", sum((F.when(F.col(h) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"))


def with_slots(rows: DataFrame, order: str, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot`` (long): 0, 1, ... within each shard, by hash of ``order`` and then ``order``.

    A shard is numbered in parts of about SLOT_ROWS rows; the parts' counts (shards x SLOT_PARTS rows at most) give
    each part its first number, so no task sees a whole shard.
    """
    n = rows.count()
    shards = max(1, rows.agg(F.max(shard)).first()[0] or 0) + 1
    parts = max(16, min(SLOT_PARTS, -(-n // (SLOT_ROWS * shards))))
    rows = rows.withColumn("part__", F.pmod(F.xxhash64(F.lit("slot"), F.col(order)), F.lit(parts)).cast("int"))
    starts = rows.groupBy(shard, "part__").agg(F.count("*").alias("n__"))
    starts = starts.select(shard, "part__", (F.sum("n__").over(Window.partitionBy(shard).orderBy("part__")) - F.col("n__")).alias("start__"))
    rank = F.row_number().over(Window.partitionBy(shard, "part__").orderBy(order))
    return rows.withColumn("rank__", rank).join(F.broadcast(starts), [shard, "part__"]).withColumn("slot", (F.col("start__") + F.col("rank__") - 1).cast("long")).drop("part__", "rank__", "start__")


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard documents by the law ``bytes``: equal texts stay together, the largest shard is as small as can be.

    Size of a row: the UTF-8 bytes of its text plus 1. Null texts are one group of size-1 rows with crc32 0; empty
    texts are another. An empty table gives no rows. Repeated rows each get a slot of their own. Extra columns are
    not read.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    narrow = cut(narrow)
    placed = with_slots(assign(narrow, "h", "size", shards), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents into one folder per shard, in slot order within each file."""
    joined = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def hashed(column: str) -> Column:
    """The group hash that ``assign`` expects."""
    return F.xxhash64(F.col(column))
