"""JSON documents as normalised tables. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions.scalars import address, parse_hex

PROVENANCE = "provenance struct<build_id:string,source_sha256:string,non_stripped_sha256:string,stripped_sha256:string>"
FIXTURE = f"""case string, build string, profile string, schema_version int, {PROVENANCE},
 analysis struct<track:string,candidate_scope:string,backend:string,extractor_version:string,raw_graph_sha256:string,candidate_selection_sha256:string,
  projection_config_sha256:string,anchor_policy:string,edge_policy:array<string>,oracle_level:string>,
 nodes array<struct<id:string,type:string,scored:boolean,anchor_kind:string,color_class:string,
  observability:struct<resolved_out_calls:bigint,unresolved_indirect_out_callsites:bigint,address_taken_references:bigint,resolved_in_callers:bigint>,
  calls:array<struct<target:string,count:bigint>>>>,
 abstentions array<struct<id:string,status:string,reason:string>>"""
TRUTH = f"""case string, build string, profile string, schema_version int, {PROVENANCE}, origins array<struct<origin:string,members:array<string>>>,
 symbols map<string,array<string>>, cross_origin_aliases array<struct<member:string,origins:array<string>>>, owners map<string,string>"""
SELECTION = f"""case string, build string, profile string, schema_version int, {PROVENANCE}, candidate_scope string, root_namespace string, namespaces array<string>,
 excluded_namespaces array<string>, addresses array<string>, function_bounds array<struct<address:string,size:bigint>>, functions array<struct<address:string,size:bigint>>"""
RAW = f"""case string, build string, profile string, schema_version int, root string, {PROVENANCE},
 analysis struct<backend:string,extractor_version:string,oracle_level:string,boundary_input_sha256:string>, binary struct<path:string,stripped_sha256:string>,
 extraction struct<boundary_mode:string,boundary_mismatches:array<struct<id:string,address:string,symbol_size:bigint,radare2_size:bigint>>>, indirect_call_summary struct<analysis_status:string>,
 functions array<struct<address:string,name:string,size:bigint,boundary_source:string,discovered_by_radare2:boolean>>,
 transfers array<struct<source:string,callsite:string,instruction:string,kind:string,operand_kind:string,status:string,target:string,resolver:string,
  confidence:string,filter_reason:string,angr_status:string,angr_targets:array<string>,angr_target_names:map<string,string>>>"""
_LABEL = "array<struct<address:string,mapped_address:string,name:string,canonical_origin:string,owner:string,evidence:string>>"
LABELS = f"""case string, build string, profile string, schema_version int, stripped_sha256 string, {PROVENANCE}, analysis struct<input:string>,
 matches {_LABEL}, propagated_wrappers {_LABEL}, cleanup_heuristics {_LABEL}, unmatched_addresses {_LABEL}"""
BOUNDARIES = f"case string, build string, profile string, schema_version int, {PROVENANCE}, source string, function_bounds array<struct<address:string,size:bigint>>"

#: Versions that a reader accepts.
VERSIONS = {"fixture": (4, 5, 6), "raw": (3, 5), "truth": (5, 6), "selection": (4, 5, 6)}


def read(spark: SparkSession, paths: str | list[str], schema: str, kind: str | None = None) -> DataFrame:
    """One row per document, with ``graph_id`` case.build.profile. Unsupported versions are refused."""
    docs = spark.read.schema(schema).option("multiLine", True).json(paths)
    docs = docs.withColumn("graph_id", F.concat_ws(".", "case", "build", "profile"))
    if kind:
        bad = docs.where(F.col("schema_version").isNull() | ~F.col("schema_version").isin(*VERSIONS[kind])).select("graph_id", "schema_version").take(3)
        if bad:
            raise ValueError(f"unsupported {kind} version: {[tuple(r) for r in bad]}")
    return docs


def graphs(docs: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and abstentions of fixture documents."""
    node = docs.select("graph_id", F.explode("nodes").alias("n"))
    seen = F.col("n.observability")
    nodes = node.select("graph_id", "n.id", "n.type", "n.scored", "n.anchor_kind", "n.color_class", *[seen[c].alias(c) for c in ("resolved_out_calls", "unresolved_indirect_out_callsites", "address_taken_references", "resolved_in_callers")])
    edges = node.select("graph_id", F.col("n.id").alias("src"), F.explode("n.calls").alias("c")).select("graph_id", "src", F.col("c.target").alias("dst"), F.col("c.count").alias("count"))
    gone = docs.select("graph_id", F.explode("abstentions").alias("a")).select("graph_id", "a.id", "a.status", "a.reason")
    return {"nodes": nodes, "edges": edges, "abstentions": gone}


def truths(docs: DataFrame) -> dict[str, DataFrame]:
    """truth, symbols, aliases and, for catalogs, owners."""
    truth = docs.select("graph_id", F.explode("origins").alias("o")).select("graph_id", "o.origin", F.explode("o.members").alias("member"))
    symbols = docs.select("graph_id", F.explode("symbols").alias("member", "names"))
    aliases = docs.select("graph_id", F.explode("cross_origin_aliases").alias("a")).select("graph_id", "a.member", "a.origins")
    return {"truth": truth, "symbols": symbols, "aliases": aliases, "owners": docs.select("graph_id", F.explode("owners").alias("member", "owner"))}


def selections(docs: DataFrame) -> dict[str, DataFrame]:
    """candidates, bounds and scope; version 4 and 5 mean scope ``subject``."""
    candidates = docs.select("graph_id", F.explode("addresses").alias("a")).select("graph_id", address(F.col("a")).alias("address"))
    bounds = docs.select("graph_id", F.explode(F.coalesce("function_bounds", "functions")).alias("b")).select("graph_id", address(F.col("b.address")).alias("address"), F.col("b.size").alias("size"))
    scope = docs.select("graph_id", F.when(F.col("schema_version") < 6, "subject").otherwise(F.col("candidate_scope")).alias("scope"), "root_namespace", "namespaces", "excluded_namespaces")
    return {"candidates": candidates, "bounds": bounds, "scope": scope}


def evidence(docs: DataFrame) -> dict[str, DataFrame]:
    """functions, transfers and roots of raw graphs, addresses as numbers."""
    functions = docs.select("graph_id", F.explode("functions").alias("f")).select("graph_id", parse_hex(F.col("f.address")).alias("address"), "f.name", "f.size", "f.boundary_source", F.col("f.discovered_by_radare2").alias("discovered"))
    t = docs.select("graph_id", F.explode("transfers").alias("t"))
    names = F.transform_keys("t.angr_target_names", lambda k, _: parse_hex(k))
    transfers = t.select(
        "graph_id", *[parse_hex(F.col(f"t.{c}")).alias(c) for c in ("source", "callsite")], "t.instruction", "t.kind", "t.operand_kind", "t.status", parse_hex(F.col("t.target")).alias("target"), "t.resolver", "t.confidence", "t.filter_reason",
        F.col("t.angr_status").alias("indirect_status"), F.transform("t.angr_targets", parse_hex).alias("indirect_targets"), names.alias("indirect_names"),
    )
    return {"functions": functions, "transfers": transfers, "roots": docs.select("graph_id", parse_hex(F.col("root")).alias("address"))}


def labels(docs: DataFrame) -> DataFrame:
    """Labels of documents, of every stage, matched or not."""
    lists = {"matches": True, "propagated_wrappers": True, "cleanup_heuristics": True, "unmatched_addresses": False}
    rows = reduce(DataFrame.unionByName, [docs.select("graph_id", F.explode(c).alias("l"), F.lit(m).alias("matched")) for c, m in lists.items()])
    return rows.select("graph_id", address(F.col("l.address")).alias("address"), address(F.col("l.mapped_address")).alias("mapped_address"), "l.name", "l.canonical_origin", "l.owner", "l.evidence", "matched")


def boundaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Extents (graph_id, address, size) of boundary documents, checked."""
    from weftgraph.operators.checks import assert_valid, violations_boundaries, violations_build

    docs = read(spark, paths, BOUNDARIES)
    rows = docs.select("graph_id", F.explode("function_bounds").alias("b")).select("graph_id", address(F.col("b.address")).alias("address"), F.col("b.size").alias("size"))
    assert_valid(violations_boundaries(rows).unionByName(violations_build(docs)))
    return rows


def catalog(docs: DataFrame) -> DataFrame:
    """(graph_id, member, origin, owner) of catalog documents, checked."""
    from weftgraph.operators.checks import assert_valid, violations_catalog

    found = truths(docs)
    rows = found["truth"].join(found["owners"], ["graph_id", "member"], "left")
    assert_valid(violations_catalog(rows))
    return rows


def label_rows(docs: DataFrame) -> DataFrame:
    """``labels``, checked: stages are closed and hold an address once."""
    from weftgraph.operators.checks import assert_valid, violations_labels

    rows = labels(docs)
    assert_valid(violations_labels(rows))
    return rows


def renormalised(rows: DataFrame) -> DataFrame:
    """Labels with origin and owner derived again from the name; an unknown owner is ``unknown``."""
    from weftgraph.functions.symbols import normalise_catalog_origin, symbol_owner

    return rows.withColumn("canonical_origin", normalise_catalog_origin(F.col("name"))).withColumn("owner", F.coalesce(symbol_owner(F.col("name")), F.lit("unknown")))


def parse_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """Symbols of a captured listing: address, size, kind, name; or without a size. Text symbols only; bad hex is skipped."""
    parts = F.split(F.trim(F.col(column)), r"\s+", 4)
    short = F.split(F.trim(F.col(column)), r"\s+", 3)
    full = (F.size(parts) == 4) & parts[2].rlike("^[A-Za-z]$")
    number = lambda c: F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(c, 16, 10).try_cast("bigint"))
    rows = lines.select(
        number(parts[0]).alias("address"), F.when(full, number(F.try_element_at(parts, F.lit(2)))).otherwise(F.lit(0)).cast("bigint").alias("size"),
        F.when(full, F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(short, F.lit(2))).alias("kind"), F.when(full, F.try_element_at(parts, F.lit(4))).otherwise(F.try_element_at(short, F.lit(3))).alias("name"),
    )
    return rows.where("address is not null and size is not null and name is not null and lower(kind) = 't'")


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Result documents under a folder: whole text, for those with ``results`` and ``run_summary``; others are skipped."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    keys = F.json_object_keys("value")
    return texts.where(F.array_contains(keys, "results") & F.array_contains(keys, "run_summary")).select("path", F.col("value").alias("json"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, for holding a manifest against them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


