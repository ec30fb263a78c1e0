"""Outputs: partitioned tables, JSON documents, byte-stable documents and digests, publishing of several outputs as one."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_rows(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, partitioned by axes; Spark's commit protocol makes it visible as a whole."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def as_documents(df: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, json): one JSON object per row, nulls kept."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("json"))


def document_digests(df: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, digest): SHA-256 of each row as canonical JSON (texts, whole numbers, booleans), as ``canonical_digest`` has it."""
    json = F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(json, 256).alias("digest"))


def selection_document(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row per graph: sorted hex addresses and extents, as selection documents hold them."""
    from weftgraph.functions.scalars import to_hex

    addresses = candidates.groupBy("graph_id").agg(F.array_sort(F.collect_set("address")).alias("a"))
    extents = bounds.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.struct("address", "size"))).alias("b"))
    rows = addresses.join(extents, "graph_id")
    return rows.select("graph_id", F.transform("a", to_hex).alias("addresses"), F.transform("b", lambda x: F.struct(to_hex(x["address"]).alias("address"), x["size"].alias("size"))).alias("function_bounds"))


def canonical(document: dict, escape: bool = False) -> str:
    """Sorted keys, no blanks."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=escape)


def canonical_digest(document: dict, escape: bool = False) -> str:
    return hashlib.sha256(canonical(document, escape).encode()).hexdigest()


def ordered_digest(rows: list[tuple[str, bytes]]) -> str:
    """One digest over named contents, each length-prefixed, in name order."""
    out = hashlib.sha256()
    for name, content in sorted(rows):
        for part in (name.encode(), content):
            out.update(len(part).to_bytes(8, "big") + part)
    return out.hexdigest()


def inputs_digest(rows: list[tuple[str, bytes]]) -> str:
    """Digest of build inputs (relative path, content), in path order: each path with its length, then its content."""
    out = hashlib.sha256()
    for name, content in sorted(dict(rows).items()):
        out.update(len(name.encode()).to_bytes(8, "big") + name.encode() + content)
    return out.hexdigest()


def stable_text(document: dict) -> str:
    """Raw graph documents as text: keys as given, indented by two, a final line break."""
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def stable_digest(document: dict) -> str:
    return hashlib.sha256(stable_text(document).encode()).hexdigest()


def _indented(text: str, depth: int) -> str:
    """A JSON value as ``stable_text`` writes it ``depth`` levels down."""
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph_id, digest, bytes) of documents whose pieces arrive in order; one hash state and one batch are held."""
    graph = state = member = None
    size = items = 0

    def put(text: str) -> None:
        nonlocal size
        state.update(data := text.encode())
        size += len(data)

    def close_list() -> None:
        if member is not None and items >= 0:
            put("\n  ]" if items else "]")

    for batch in batches:
        done = []
        for g, name, place, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or g != graph:
                if state is not None:
                    close_list()
                    put("\n}\n")
                    done.append((graph, state.hexdigest(), size))
                graph, state, member, size = g, hashlib.sha256(), None, 0
                put("{")
            if name != member:
                if member is not None:
                    close_list()
                    put(",")
                put(f"\n  {json.dumps(name, ensure_ascii=False)}: ")
                member, items = name, -1
                if place is not None:
                    put("[")
                    items = 0
            if place is None:
                put(_indented(piece, 1))
            elif piece is not None:
                put(("," if items else "") + "\n    " + _indented(piece, 2))
                items += 1
        yield _digests(done)
    if state is not None:
        close_list()
        put("\n}\n")
        yield _digests([(graph, state.hexdigest(), size)])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"graph_id": pa.string(), "digest": pa.string(), "bytes": pa.int64()}
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def stable_digests(members: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, digest, bytes) of one document per graph, of any size: what ``stable_digest`` gives for it whole.

    members: the document's members in its order, each a table with graph_id and ``json``, the value's text: one row a
    graph for a value; for a list also ``place``, the order of its items, unique in a graph, with a row a graph of null
    place and json where a list may be empty. Pieces are sorted in Spark and streamed through one hash state, so that no
    document is ever a row, an array or a dict.
    """
    pieces = []
    for i, (name, df) in enumerate(members.items()):
        listed = "place" in df.columns
        place = F.coalesce(F.col("place").cast("bigint"), F.lit(-(2**63))) if listed else F.lit(None).cast("bigint")
        pieces.append(df.select("graph_id", F.lit(name).alias("member"), place.alias("place"), "json", F.lit(i).alias("nth")))
    rows = pieces[0]
    for more in pieces[1:]:
        rows = rows.unionByName(more)
    sorted_rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", "nth", "place")
    return sorted_rows.select("graph_id", "member", "place", "json").mapInArrow(_streamed, "graph_id string, digest string, bytes bigint")


# Publishing


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    at, fs = _path(spark, f"{folder}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def publish(outputs: dict[str, DataFrame], folder: str) -> int:
    """Write several tables so that readers see all of them or none; returns the version.

    Each table goes to a folder of this attempt's own, and its files are digested where they lie. A manifest that lists them
    is written under another name and renamed last; that rename is what publishes. An attempt that ends before leaves the
    version before it as it was, and another writer's version of the same number makes this one fail, not mix.
    """
    spark = next(iter(outputs.values())).sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    attempt = f"data/{version:06d}-{uuid.uuid4().hex}"
    listed = {}
    for name, df in outputs.items():
        df.write.parquet(f"{folder}/{attempt}/{name}")
        files = spark.read.format("binaryFile").load(f"{folder}/{attempt}/{name}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))
        totals = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n"), 256).alias("sha256")).first()
        listed[name] = {"path": f"{attempt}/{name}", "schema": json.loads(df.schema.json()), **totals.asDict()}
    text = canonical({"version": version, "tables": listed})
    staged, fs = _path(spark, f"{folder}/{attempt}/manifest")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _path(spark, f"{folder}/manifests/{version:06d}.json")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(staged, final):
        raise RuntimeError(f"version {version} was published by another writer")
    return version


def published(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a published version, the newest by default. Only what its manifest lists is read."""
    known = _versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise ValueError(f"nothing is published in {folder}" if not known else f"no version {version} in {folder}")
    text = "".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version or known[-1]:06d}.json", wholetext=True).collect())
    return {name: spark.read.schema(StructType.fromJson(at["schema"])).parquet(f"{folder}/{at['path']}") for name, at in json.loads(text)["tables"].items()}


def violations_published(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(graph_id, rule, key) of tables whose files aren't those that the manifest digested; graph_id is the folder."""
    known = _versions(spark, folder)
    text = "".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version or known[-1]:06d}.json", wholetext=True).collect())
    parts = []
    for name, at in json.loads(text)["tables"].items():
        files = spark.read.format("binaryFile").load(f"{folder}/{at['path']}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
        now = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256"))), "\n"), 256).alias("now"))
        parts.append(now.where(F.col("now") != at["sha256"]).select(F.lit(folder).alias("graph_id"), F.lit("files changed").alias("rule"), F.lit(name).alias("key")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
