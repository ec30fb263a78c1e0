"""Executable files: sizes of their code sections, and the targets of their relocation slots."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the file format: magic, header and section header by word size, and the places of the fields in them.
MAGIC = b"\x7fELF"
HEADERS = {1: "16sHHIIIIIHHHHHH", 2: "16sHHIQQQIHHHHHH"}
SECTIONS = {1: "IIIIIIIIII", 2: "IIQQQQIIQQ"}
ORDERS = {1: "<", 2: ">"}
TABLE, STEP, COUNT, NAMES = 6, 11, 12, 13
NAME, OFFSET, SIZE = 0, 4, 5
# Fixed values of relocation: the machine, section types (symbols, dynamic symbols, with and without addends), kinds, the undefined section.
X86_64, MACHINE = 62, 2
SYMBOLS, RELOCATIONS = (2, 11), {4: np.dtype([("slot", "<u8"), ("info", "<u8"), ("addend", "<i8")]), 9: np.dtype([("slot", "<u8"), ("info", "<u8")])}
SYMBOL = np.dtype([("name", "<u4"), ("info", "u1"), ("other", "u1"), ("section", "<u2"), ("value", "<u8"), ("size", "<u8")])
TYPE, LINK = 1, 6
BY_SYMBOL, RELATIVE, UNDEFINED = (1, 6, 7), 8, 0
#: Rows that a task hands on at a time.
ROWS = 65_536
_LINKS = pa.schema([("path", pa.string()), ("is_symbol", pa.bool_()), ("section", pa.int32()), ("symbol", pa.int64()), ("kind", pa.int64()), ("slot", pa.int64()), ("value", pa.int64())])
_LINKS_DDL = "path string, is_symbol boolean, section int, symbol bigint, kind bigint, slot bigint, value bigint"


def section_size(content: bytes, section: bytes = b".text") -> int | None:
    """Size of the first section of that name; null for other files, and for files that end too early."""
    if len(content) < 64 or not content.startswith(MAGIC) or content[4] not in HEADERS or content[5] not in ORDERS:
        return None
    order = ORDERS[content[5]]
    header = struct.unpack_from(order + HEADERS[content[4]], content)
    if not header[TABLE] or header[NAMES] >= header[COUNT]:
        return None
    try:
        rows = [struct.unpack_from(order + SECTIONS[content[4]], content, header[TABLE] + i * header[STEP]) for i in range(header[COUNT])]
    except struct.error:
        return None
    start, size = rows[header[NAMES]][OFFSET], rows[header[NAMES]][SIZE]
    named = content[start : start + size]
    return next((r[SIZE] for r in rows if named.startswith(section + b"\0", r[NAME])), None)


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [section_size(bytes(c)) for c in batch["content"]]
        yield batch[["path", "length"]].assign(text_size=pd.array(found, dtype="Int64"))


def binary_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, text_size) of files, each parsed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content").mapInPandas(_sizes, "path string, length bigint, text_size bigint")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relocation entries (section: their symbol table) and defined symbols (section: their own) of each file, as _LINKS."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py()
            if len(data) < 64 or not data.startswith(MAGIC) or data[4] != 2 or data[5] != 1 or (header := struct.unpack_from("<" + HEADERS[2], data))[MACHINE] != X86_64:
                raise ValueError(f"relocations are read from 64-bit x86-64 files only: {path}")
            rows = [struct.unpack_from("<" + SECTIONS[2], data, header[TABLE] + i * header[STEP]) for i in range(header[COUNT])] if header[TABLE] else []
            for i, row in enumerate(rows):
                if row[TYPE] in RELOCATIONS:
                    kind = RELOCATIONS[row[TYPE]]
                    at = np.frombuffer(data, kind, row[SIZE] // kind.itemsize, row[OFFSET])
                    value = at["addend"] if "addend" in kind.names else np.zeros(len(at), np.int64)
                    yield from _sliced(path, False, row[LINK], at["info"] >> np.uint64(32), at["info"] & np.uint64(0xFFFFFFFF), at["slot"], value)
                elif row[TYPE] in SYMBOLS:
                    at = np.frombuffer(data, SYMBOL, row[SIZE] // SYMBOL.itemsize, row[OFFSET])
                    known = np.flatnonzero(at["section"] != UNDEFINED)
                    yield from _sliced(path, True, i, known, np.zeros(len(known)), np.zeros(len(known)), at["value"][known])


def _sliced(path: str, is_symbol: bool, section: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), ROWS):
        part = [c[a : a + ROWS].astype(np.int64) for c in columns]  # addresses wrap as 64-bit numbers
        n = len(part[0])
        yield pa.record_batch([pa.array([path] * n), pa.array([is_symbol] * n), pa.array([section] * n, pa.int32()), *map(pa.array, part)], schema=_LINKS)


def linked_targets(links: DataFrame) -> DataFrame:
    """(path, slot, target) of relocation entries that have one, from ``links`` (_LINKS_DDL).

    A relative entry points to its addend; one by symbol to the symbol's value plus the addend, if its table defines the
    symbol; other kinds point nowhere known. Symbols are joined, not looked up in a file's memory, and both sides are
    dealt out: a file's size says little about how many symbols it makes, so they aren't for the driver to broadcast.
    """
    entries = links.where("not is_symbol")
    symbols = links.where("is_symbol").select("path", "section", "symbol", F.col("value").alias("base"))
    relative = entries.where(F.col("kind") == RELATIVE).select("path", "slot", F.col("value").alias("target"))
    named = entries.where(F.col("kind").isin(*BY_SYMBOL)).join(symbols.hint("merge"), ["path", "section", "symbol"])
    return relative.unionByName(named.select("path", "slot", F.expr("cast(cast(base as decimal(20)) + value as decimal(20))").alias("sum")).select("path", "slot", _wrapped(F.col("sum")).alias("target")))


def _wrapped(number):
    """A sum of addresses as a 64-bit number, as addition without overflow has it."""
    whole = F.lit(str(2**64)).cast("decimal(20,0)")
    return F.when(number >= F.lit(str(2**63)).cast("decimal(20,0)"), number - whole).when(number < F.lit(str(-(2**63))).cast("decimal(20,0)"), number + whole).otherwise(number).cast("bigint")


def relocations(spark: SparkSession, path: str) -> DataFrame:
    """(path, slot, target) of the files under ``path``, for ``evidence.relocation_targets``. Files of other machines are refused; empty ones have no rows.

    Files come through Spark's own reader, whatever store they lie in; a task turns the sections of one into rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return linked_targets(files.select("path", "content").mapInArrow(_links, _LINKS_DDL))


def artifact_summary(functions: DataFrame, mismatches: DataFrame, candidates: DataFrame, nodes: DataFrame, abstentions: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per graph: sizes of the binary and its code, functions, candidates, nodes, abstentions, extents by discovery.

    sizes: (graph_id, length, text_size); mismatches: (graph_id, address, symbol_size, found_size).
    """
    given = F.col("boundary_source") == "symbol-oracle"
    rows = functions.groupBy("graph_id").agg(F.count("*").alias("known_functions"), F.count_if(given).alias("supplied"), F.count_if(given & F.col("discovered")).alias("supplied_found"), F.count_if(given & ~F.col("discovered")).alias("supplied_missing"))
    counted = {"candidates": candidates, "nodes": nodes, "abstentions": abstentions, "size_mismatches": mismatches.where("found_size > 0 and found_size <> symbol_size")}
    for name, df in counted.items():
        rows = rows.join(df.groupBy("graph_id").agg(F.count("*").alias(name)), "graph_id", "left").fillna(0, [name])
    return rows.join(sizes.select("graph_id", F.col("length").alias("binary_size"), "text_size"), "graph_id", "left")
