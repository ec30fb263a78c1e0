"""Vector code compression: product codes of 4 parts with 256 entries each, by delta-maintained Lloyd.

Vectors are cut once into blocks of BLOCK, as integers, in a table dealt out by block. The assignments of each round are
a table beside it, dealt out alike, so that a round joins both where they lie: nothing of a vector's size is shuffled
after that. A round compares new assignments with those persisted before. Only a part whose assignment changed
contributes: plus to its new entry, minus to its old one; a task adds up what it contributes, and at most 4 x 256 sums
of each task are shuffled. The driver adds them to the running integer sums and counts and divides: 256 vectors' worth
of numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.skew import look_up
from weftgraph.llm.workers import task
from weftgraph.session import Beside, Scratch, cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block.
BLOCK = 1024
ROUND = pa.schema([("block", pa.string()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])
ROUND_DDL = "block string, codes binary, part int, entry int, count long, sums array<long>"


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Components of whole vectors as floor(SCALE * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() ** 2 * 4 * width >= 2**62:
        raise ValueError("components are too large for distances in 64 bits")
    return scaled.astype(np.int32)


def _blocks(width: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                ids, labels, vectors = (batch.column(c).slice(i, BLOCK) for c in range(3))
                offsets = pa.array([0, len(ids)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, labels)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{n}"]), *lists, pa.array([_integers(vectors, width).tobytes()])], names=["block", "ids", "labels", "vectors"])
                n += 1

    return task(blocks)


def nearest(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance summed over parts) of integer vectors; ties go to the lower entry."""
    n, width = vectors.shape
    size = width // PARTS
    codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
    largest = max(int(np.abs(x).max(initial=0)) for x in (vectors, codebooks))
    kind = np.float64 if 4 * largest**2 * size < 2**52 else np.int64  # both exact
    for p in range(PARTS):
        x, c = vectors[:, p * size : (p + 1) * size].astype(kind), codebooks[p].astype(kind)
        distance = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        codes[:, p] = distance.argmin(1)
        error += distance[np.arange(n), codes[:, p]].astype(np.int64)
    return codes, error


def _assigned(codebooks: np.ndarray):
    """New assignments of each block, and at the end what the task's changed parts contribute."""
    parts, entries, size = codebooks.shape

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(-1, parts * size)
                codes = nearest(vectors, codebooks)[0]
                before = None if row["codes"] is None else np.frombuffer(row["codes"], np.uint8).reshape(-1, parts)
                for p in range(parts):
                    changed = np.arange(len(codes)) if before is None else np.flatnonzero(codes[:, p] != before[:, p])
                    moved = vectors[changed, p * size : (p + 1) * size].astype(np.int64)
                    for sign, entry in [(1, codes[changed, p])] + ([] if before is None else [(-1, before[changed, p])]):
                        np.add.at(sums[p], entry, sign * moved)
                        np.add.at(counts[p], entry, sign)
                yield _rows([(row["block"], codes.tobytes(), None, None, None, None)])
        touched = np.argwhere((counts != 0) | (sums != 0).any(2))
        yield _rows([(None, None, int(p), int(e), int(counts[p, e]), sums[p, e]) for p, e in touched])

    return task(assigned)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(ROUND)
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, ROUND, strict=True)], schema=ROUND)


def _coded(codebooks: np.ndarray):
    """(vec_id, label, code, error) of each vector."""
    parts, _, size = codebooks.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, vectors = (batch.column(batch.schema.get_field_index(c))[i] for c in ("ids", "labels", "vectors"))
                codes, error = nearest(np.frombuffer(vectors.as_py(), np.int32).reshape(-1, parts * size), codebooks)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return task(coded)


def lloyd(blocks: DataFrame, first: np.ndarray, beside: Beside, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """Codebooks (part, entry, position) after ``rounds`` rounds, and the changed parts of each round."""
    codebooks = first.copy()
    sums, counts = np.zeros(first.shape, np.int64), np.zeros(first.shape[:2], np.int64)
    before, changed = None, []
    for _ in range(rounds):
        rows = blocks.select("block", "vectors")
        rows = rows.withColumn("codes", F.lit(None).cast("binary")) if before is None else rows.join(before, "block")
        now = beside.table(rows.mapInArrow(_assigned(codebooks), ROUND_DDL), "block", dealt=True)
        deltas = now.where("block is null").select("part", "entry", "count", F.posexplode("sums").alias("position", "value"))
        plus = 0
        for r in deltas.groupBy("part", "entry", "position").agg(F.sum("count").alias("count"), F.sum("value").alias("value")).collect():
            sums[r["part"], r["entry"], r["position"]] += r["value"]
            if r["position"] == 0:
                counts[r["part"], r["entry"]] += r["count"]
                plus += max(0, r["count"])
        changed.append(plus)
        used = counts > 0
        codebooks[used] = sums[used] // counts[used][:, None]
        before = now.where("block is not null").select("block", "codes")
    return codebooks, changed


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go, and so do those of another length than the
    longest vector (empty ones among them); that length must be a multiple of PARTS. Fewer than ENTRIES vectors make as
    many entries. A null vec_id comes after all others; rows of one vec_id are told apart by their vector, and repeated
    rows are coded alike. Null labels are one label. No kept rows give no rows. Other columns are not read. Components
    whose distances leave 64 bits are an error.
    """
    good = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(vec_id).cast("long").alias("i"), F.col(label).alias("l"), F.col(vector).alias("v")).where(good)
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    kept = kept.where(F.size("v") == width) if width else kept.where("false")
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    first = [r["v"] for r in kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    kind = rows.schema[label].dataType.simpleString()
    with Scratch(rows.sparkSession) as scratch, Beside(scratch) as beside:
        if not first:
            empty = F.lit(None)
            return kept.where("false").select(F.col("i").alias("vec_id"), empty.cast("string").alias("code"), empty.cast("long").alias("error"), empty.cast("long").alias("label_error"), empty.cast("string").alias("codebooks_sha256"))
        start = np.floor(np.array(first, np.float64) * SCALE).astype(np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
        blocks = kept.mapInArrow(_blocks(width), f"block string, ids array<long>, labels array<{kind}>, vectors binary")
        blocks = beside.table(blocks, "block")
        codebooks, _ = lloyd(blocks, start, beside, rounds)
        coded = scratch.table(blocks.select("ids", "labels", "vectors").mapInArrow(_coded(codebooks), f"vec_id long, label {kind}, code string, error long").withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))))
        index = scratch.table(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")))
        total = index.agg(F.sum("size")).first()[0]
        digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
        out = look_up(coded, index, "key", "size", total)
        return cut(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _oracle() -> str:
    """The rounds unrolled, all distances recomputed in each."""
    steps = [
        """kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)
), c0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
    FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, p, any_value(x) AS x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS k
    FROM parts JOIN c{r} USING (p) GROUP BY vec_id, p
)""")
        if r < ROUNDS:
            steps.append(f"""u{r} AS MATERIALIZED (
    SELECT p, k % 256 AS e, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
    FROM a{r}, (SELECT unnest(range(1, (SELECT any_value(len(v)) // 4 + 1 FROM kept))) AS i) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS m FROM u{r} GROUP BY p, e
    ) USING (p, e)
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS d FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE_SQL = _oracle()
