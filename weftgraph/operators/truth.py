"""Ground truth from symbols: address-level dedup, shared addresses, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.scalars import node_id
from weftgraph.functions.symbols import belongs_to_subject, catalog_origin, is_nonstd_candidate, symbol_origin, symbol_owner
from weftgraph.schemas import ID_BIAS


def partition(symbols: DataFrame, bias: int = ID_BIAS) -> DataFrame:
    """(member, address, origin, names, origins) of symbols that have an ``origin``; a row per address.

    Several names of one origin at an address are one member. Several origins at an address make the origin
    ``shared-address@<member>``, and ``origins`` lists them.
    """
    rows = symbols.where("origin is not null").groupBy("address").agg(F.array_sort(F.collect_set("origin")).alias("origins"), F.array_sort(F.collect_set("name")).alias("names"))
    member = node_id(F.col("address"), bias)
    return rows.select(member.alias("member"), "address", F.when(F.size("origins") > 1, F.concat(F.lit("shared-address@"), member)).otherwise(F.element_at("origins", 1)).alias("origin"), "names", "origins")


def ground_truth(symbols: DataFrame, namespaces: list[str], scope: str = "rust-nonstd", root_namespace: str | None = None, bias: int = ID_BIAS) -> DataFrame:
    """Partition of candidates. In scope ``subject`` two origins at an address are an error; see ``alias_conflicts``."""
    return partition(symbols.withColumn("origin", symbol_origin(F.col("name"), namespaces, scope, root_namespace)), bias)


def alias_conflicts(truth: DataFrame) -> DataFrame:
    """Members with more than one origin."""
    return truth.where(F.size("origins") > 1).select("member", "origins")


def catalog(symbols: DataFrame, root_namespace: str, bias: int = ID_BIAS) -> DataFrame:
    """Partition of every observable symbol, with its owner; shared addresses are owned by ``shared-address``."""
    rows = partition(symbols.withColumn("origin", catalog_origin(F.col("name"), root_namespace)), bias)
    return rows.withColumn("owner", F.when(F.size("origins") > 1, "shared-address").otherwise(symbol_owner(F.element_at("names", 1))))


def candidate_addresses(symbols: DataFrame, namespaces: list[str], scope: str = "rust-nonstd", root_namespace: str | None = None) -> DataFrame:
    return symbols.where(symbol_origin(F.col("name"), namespaces, scope, root_namespace).isNotNull()).select("address").distinct()


def bounds(symbols: DataFrame, namespaces: list[str] | None = None, scope: str = "rust-nonstd", root_namespace: str = "", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(address, size) extents and their violations: sizes of 0 or less, and addresses with two sizes.

    ``every``: all owned symbols and the startup ``main``; else the candidates of the scope and the root's main.
    """
    name = F.col("name")
    if every:
        belongs = symbol_owner(name).isNotNull() | (name == "main")
    elif scope == "subject":
        belongs = belongs_to_subject(name, namespaces or [])
    else:
        belongs = is_nonstd_candidate(name, root_namespace) | (name == f"{root_namespace}::main")
    sizes = symbols.where(belongs).groupBy("address").agg(F.min("size").alias("size"), F.max("size").alias("largest"))
    bad = sizes.where("size <= 0 or size <> largest").select("address", F.when(F.col("size") <= 0, "missing size").otherwise("conflicting sizes").alias("rule"))
    return sizes.where("size > 0 and size = largest").select("address", "size"), bad


def origins(truth: DataFrame) -> DataFrame:
    """(origin, members by address, first address), the document order of a truth."""
    rows = truth.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("address", "member"))).alias("m"))
    return rows.select("origin", F.col("m.member").alias("members"), F.element_at("m", 1)["address"].alias("first"))


def origin_by_member(origin_rows: DataFrame) -> DataFrame:
    """Inversion of (origin, members)."""
    return origin_rows.select(F.explode("members").alias("member"), "origin")
