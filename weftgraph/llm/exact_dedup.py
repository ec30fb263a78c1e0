"""Exact dedup by a log-structured merge index over content digests.

Write path: the digests of every row, computed natively, enter a memtable per task, keyed by the SHA-256 of the
normalised text. A full memtable is flushed as a run: entries sorted by digest, the smallest row of each and their
number. Compaction brings the runs' entries of a digest together in digest order and keeps the smallest identifier. So
a hot digest costs a compaction one entry for each run, never one for each row. No text is moved for this.

Hits are digests with more than one row. They receive byte verification: the compacted index's hits get a filter (a
blocked Bloom filter of bounded size), the texts are scanned again, and only rows that pass the filter give their
bodies, one for each text and task, after comparing it with the task's other copies. Bodies of a digest then meet and
are compared byte for byte; one that differs stops the run. A filter that is too small for its hits lets more bodies
through, and changes nothing else.

"Smallest" is the order of ``rank``: most code points in the original text first, then the smallest doc_id, then the
smallest digest of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.skew import look_up, text_tag, without
from weftgraph.llm.workers import task
from weftgraph.session import Scratch, cut

#: The characters that normalisation deletes: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes that a memtable holds before it is flushed, and what an entry takes without its body.
MEMTABLE_BYTES, ENTRY_BYTES = 32 << 20, 400
#: Hits for each 64-bit word of a filter, bits that a hit sets in its word, and the most words (the filter is broadcast).
WORD_HITS, WORD_BITS, FILTER_WORDS = 4, 4, 1 << 20

ENTRY = pa.schema([("key", pa.binary()), ("code_points", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.binary()), ("rows", pa.int64())])
ENTRY_DDL = "key binary, code_points long, doc_id long, raw binary, rows long"
INDEX = pa.schema([("key", pa.binary()), ("keep_id", pa.int64()), ("keep_raw", pa.binary()), ("group_size", pa.int64()), ("runs", pa.int64())])
INDEX_DDL = "key binary, keep_id long, keep_raw binary, group_size long, runs long"
BODY = pa.schema([("key", pa.binary()), ("body", pa.binary())])


def normalised(text: Column) -> Column:
    """The text without BLANKS; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def rank(code_points: int, doc_id: int | None, raw: bytes) -> tuple:
    """Order of a group's rows; a null doc_id is the last of its length."""
    return -code_points, doc_id is None, doc_id or 0, raw


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Memtable:
    """The smallest row of each key, and how many there were."""

    def __init__(self) -> None:
        self.entries: dict[bytes, list] = {}
        self.bytes = 0

    def put(self, key: bytes, code_points: int, doc_id: int | None, raw: bytes, rows: int) -> None:
        entry = self.entries.get(key)
        if entry is None:
            self.entries[key] = [code_points, doc_id, raw, rows]
            self.bytes += ENTRY_BYTES
            return
        entry[3] += rows
        if rank(code_points, doc_id, raw) < rank(*entry[:3]):
            entry[:3] = code_points, doc_id, raw

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The run, in the order of its keys."""
        keys = sorted(self.entries)
        for i in range(0, len(keys), 8192):
            yield _batch([(k, *self.entries.pop(k)) for k in keys[i : i + 8192]], ENTRY)
        self.bytes = 0


def flush_runs(memtable_bytes: int):
    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable()
        for key, code_points, doc_id, raw in _rows(batches):
            table.put(key, code_points, doc_id, raw, 1)
            if table.bytes > memtable_bytes:
                yield from table.flush()
        yield from table.flush()

    return task(flush)


@task
def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge entries that arrive in the order of their keys; one entry is held at a time."""
    out: list[tuple] = []
    held: list | None = None
    for key, code_points, doc_id, raw, rows in _rows(batches):
        if held is None or held[0] != key:
            if held is not None:
                out.append((held[0], held[1][1], held[1][2], held[2], held[3]))
                if len(out) >= 8192:
                    yield _batch(out, INDEX)
                    out = []
            held = [key, (code_points, doc_id, raw), 0, 0]
        held[1] = min(held[1], (code_points, doc_id, raw), key=lambda r: rank(*r))
        held[2], held[3] = held[2] + rows, held[3] + 1
    if held is not None:
        out.append((held[0], held[1][1], held[1][2], held[2], held[3]))
    yield _batch(out, INDEX)


def _body(text: str) -> Column:
    return F.encode(normalised(F.col(text)), "UTF-8")


def _key(sha: Column, body: Column, digest_bytes: int) -> Column:
    """The digest, then a second one that keeps texts apart where ``digest_bytes`` is cut short."""
    return F.concat(F.substring(sha, 1, digest_bytes), F.unhex(F.md5(body)))


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """(doc_id, code_points, raw, sha, key) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("code_points"), text_tag(F.col(text)).alias("raw"), _body(text).alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("body", 256)))
    return rows.select("doc_id", "code_points", "raw", "sha", _key(F.col("sha"), F.col("body"), digest_bytes).alias("key"))


def build_runs(rows: DataFrame, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """Level 0: the runs that the memtables of ``digested`` rows flush, as rows of ENTRY_DDL."""
    return rows.select("key", "code_points", "doc_id", "raw").mapInArrow(flush_runs(memtable_bytes), ENTRY_DDL)


def compact_runs(runs: DataFrame) -> DataFrame:
    """The index: one row for each text, with the row it keeps, its rows and the runs it came from."""
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(compact, INDEX_DDL)


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """WORD_BITS bits of a 64-bit word, from a second hash."""
    other, mask = F.xxhash64(F.lit(1), key), F.lit(0).cast("long")
    for i in range(WORD_BITS):
        place = F.shiftrightunsigned(other, 6 * i).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def key_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``n`` keys as (word, bits) rows, FILTER_WORDS at most; and its number of words."""
    words = max(1, min(FILTER_WORDS, -(-n // WORD_HITS)))
    return keys.select(_word(F.col("key"), words).alias("word"), _mask(F.col("key")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits")), words


def passing(rows: DataFrame, held: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` whose key the filter may hold; all whose key it holds, and few others."""
    bits, words = held
    probed = rows.withColumn("word", _word(F.col("key"), words)).join(F.broadcast(bits), "word")
    return probed.where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select(*rows.columns)


def parted(rows: DataFrame, held: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key the filter may hold, and those whose key it surely does not."""
    bits, words = held
    probed = rows.withColumn("word", _word(F.col("key"), words)).join(F.broadcast(bits), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), F.lit(False))
    return probed.where(may).select(*rows.columns), probed.where(~may).select(*rows.columns)


def _same(key: bytes, one: bytes, other: bytes) -> None:
    if one != other:
        raise ValueError(f"different texts under one digest: {key.hex()}")


def _gathered(memtable_bytes: int):
    """One body of each key, again and again where they don't fit; copies in the task are compared and go."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0
        for key, body in _rows(batches):
            known = held.get(key)
            if known is not None:
                _same(key, known, body)
                continue
            held[key] = body
            size += len(body) + ENTRY_BYTES
            if size > memtable_bytes:
                for pair in held.items():
                    yield _batch([pair], BODY)
                held, size = {}, 0
        rows = list(held.items())
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], BODY)

    return task(gathered)


@task
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of bodies that were held against another one; they arrive in the order of their keys."""
    last = known = None
    n = 0
    for key, body in _rows(batches):
        if key == last:
            _same(key, known, body)
            n += 1
        last, known = key, body
    yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def verify(docs: DataFrame, hits: DataFrame, n: int, text: str = "text", memtable_bytes: int = MEMTABLE_BYTES, digest_bytes: int = 32) -> int:
    """Compare the bodies of all rows of the ``n`` hits (key); raise where two of a key differ. Returns the comparisons between tasks."""
    if not n:
        return 0
    body = docs.select(_body(text).alias("body"))
    rows = body.select(_key(F.unhex(F.sha2("body", 256)), F.col("body"), digest_bytes).alias("key"), "body")
    bodies = passing(rows, key_filter(hits, n)).mapInArrow(_gathered(memtable_bytes), "key binary, body binary")
    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "n long").agg(F.sum("n")).first()[0] or 0


def ingest(index: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """New documents whose text the index holds: (doc_id, keep_id). Only rows that pass the index's filter are looked up."""
    held = key_filter(index.select("key"), index.count())
    return passing(digested(docs, doc_id, text), held).join(index.select("key", "keep_id"), "key").select("doc_id", "keep_id")


def _decided(docs: DataFrame, doc_id: str, text: str, memtable_bytes: int, digest_bytes: int) -> DataFrame:
    """One row per document: doc_id, tag, sha, keep_id, group_size, copied, stays (see ``without``)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(digested(docs, doc_id, text, digest_bytes))
        index = scratch.table(compact_runs(build_runs(rows, memtable_bytes)))
        total, copies = index.agg(F.sum("group_size"), F.count_if(F.col("group_size") > 1)).first()
        copied = index.where("group_size > 1").select("key", "keep_id", "keep_raw", F.col("group_size").alias("size"), "group_size")
        verify(docs, copied.select("key"), copies, text, memtable_bytes, digest_bytes)
        out = look_up(rows, copied, "key", "size", total or 0)
        keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        stays = F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")))
        return cut(out.select("doc_id", F.col("raw").alias("tag"), "sha", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("group_size").isNotNull().alias("copied"), stays.alias("stays")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memtable_bytes: int = MEMTABLE_BYTES, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all texts without other characters than BLANKS are one group. Ties go to the smallest
    doc_id, a null doc_id last. Repeated rows (same doc_id and text) are rows of their group: each counts in
    group_size, and all carry the same ``kept``. An empty table gives no rows. Other columns are not read.
    ``digest_bytes`` under 32 is for tests of colliding digests: a second digest then keeps the texts apart.
    """
    rows = _decided(docs, doc_id, text, memtable_bytes, digest_bytes)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts, whatever their ids."""
    return without(docs, _decided(docs, doc_id, text, MEMTABLE_BYTES, 32), doc_id, text)


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
    SELECT doc_id, sha256(n) AS text_sha256,
        first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY n) AS group_size
    FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
