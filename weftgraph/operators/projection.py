"""Projection of call evidence to the graph that a track and an anchor policy show. Many graphs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.scalars import anchor_color_class, node_id
from weftgraph.operators.closure import reachable
from weftgraph.schemas import EXACT_RESOLVERS, ID_BIAS, INFERRED, RELOCATION
from weftgraph.session import cut

KEY = ["graph_id", "address"]


@dataclass(frozen=True)
class Policy:
    """What a track lets through."""

    track: str
    callers: bool  # whether outside callers of candidates seed the closure and are anchors
    resolvers: tuple[str, ...]
    anchors: str = "address"
    opaque: bool = True  # whether exact relocation targets without a function are nodes


def policy(track: str, anchors: str = "address") -> Policy:
    if anchors not in ("address", "role"):
        raise ValueError(f"unsupported anchor policy: {anchors}")
    if track == "direct":
        return Policy(track, False, EXACT_RESOLVERS, anchors)
    if track == "direct-in":
        return Policy(track, True, EXACT_RESOLVERS, anchors)
    if track == "angr":
        return Policy(track, True, (*EXACT_RESOLVERS, INFERRED), anchors)
    raise ValueError(f"unsupported track: {track}")


FROZEN = Policy("direct", False, ("direct-immediate", "direct-tail"), "address", False)


def resolved_edges(transfers: DataFrame, rules: Policy) -> DataFrame:
    """(graph_id, source, target, count, opaque) of the callsites that the policy accepts."""
    known = (F.col("status") == "resolved") & F.col("resolver").isin(*rules.resolvers)
    opaque = (F.col("status") == "unmapped") & (F.col("resolver") == RELOCATION) & (F.col("confidence") == "exact") & F.lit(rules.opaque and RELOCATION in rules.resolvers)
    taken = transfers.where(known | opaque)
    return taken.groupBy("graph_id", "source", "target").agg(F.count("*").alias("count"))


def _named(df: DataFrame, column: str, name: str = "address") -> DataFrame:
    return df.select("graph_id", F.col(column).alias(name)).distinct()


def _closure(edges: DataFrame, seeds: DataFrame, universe: DataFrame, ready: bool = False) -> DataFrame:
    return reachable(edges, seeds.withColumnRenamed("address", "node"), universe.withColumnRenamed("address", "node"), ready).withColumnRenamed("node", "address")


def unknown_candidates(functions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are no known function: a projection must have none."""
    return candidates.join(functions, KEY, "left_anti")


def project(functions: DataFrame, transfers: DataFrame, candidates: DataFrame, roots: DataFrame, rules: Policy, score_root: bool = False, bias: int = ID_BIAS) -> dict[str, DataFrame]:
    """nodes, edges and abstentions of the projected graphs.

    functions: (graph_id, address, ...); transfers: schemas.TRANSFERS; candidates and roots: (graph_id, address).
    Order matters: which candidates are active is decided on the closure that the track can show, before abstaining
    ones are taken out and anchors are named.
    """
    graph = cut(resolved_edges(transfers, rules))
    known = functions.select(*KEY).distinct()
    universe = cut(known.union(_named(graph, "target")).distinct())
    others = graph.where("source <> target")
    to_candidate = graph.join(candidates.withColumnRenamed("address", "target"), ["graph_id", "target"], "left_semi")
    callers = _named(to_candidate, "source").join(roots, KEY, "left_anti")
    seeds = roots.union(candidates).union(callers) if rules.callers else roots.union(candidates)
    provisional = _closure(graph, seeds, universe, ready=True)  # all targets are in the universe
    shown = lambda side: provisional.withColumnRenamed("address", side)
    calls_shown = _named(others.join(shown("target"), ["graph_id", "target"], "left_semi"), "source")
    called_by_shown = _named(others.join(shown("source"), ["graph_id", "source"], "left_semi"), "target")
    active = cut(candidates.join(calls_shown.union(called_by_shown).distinct(), KEY, "left_semi").distinct())
    abstained = cut(candidates.join(active, KEY, "left_anti").distinct())
    scored = active.union(roots).distinct() if score_root else active
    from_scored = graph.join(scored.withColumnRenamed("address", "source"), ["graph_id", "source"], "left_semi")
    outgoing = _named(from_scored, "target").join(scored, KEY, "left_anti")
    to_scored = graph.join(scored.withColumnRenamed("address", "target"), ["graph_id", "target"], "left_semi")
    incoming = _named(to_scored, "source").join(scored, KEY, "left_anti").join(roots, KEY, "left_anti")
    if not rules.callers:
        incoming = incoming.limit(0)
    selected = cut(_closure(graph, scored.union(roots).union(incoming), universe, ready=True).join(abstained, KEY, "left_anti"))

    flag = lambda df, name: df.select(*KEY, F.lit(True).alias(name)).distinct()
    nodes = selected
    for df, name in ((scored, "scored"), (roots, "is_root"), (incoming, "is_in"), (outgoing, "is_out")):
        nodes = nodes.join(flag(df, name), KEY, "left")
    nodes = nodes.fillna(False, ["scored", "is_root", "is_in", "is_out"])
    kind = F.when(F.col("is_root"), "root").when(F.col("is_in") & F.col("is_out"), "both").when(F.col("is_in"), "incoming").when(F.col("is_out"), "outgoing").otherwise("context")
    out_calls = graph.groupBy("graph_id", F.col("source").alias("address")).agg(F.sum("count").alias("resolved_out_calls"))
    in_callers = others.groupBy("graph_id", F.col("target").alias("address")).agg(F.count_distinct("source").alias("resolved_in_callers"))
    open_sites = transfers.where("status = 'unresolved' and operand_kind in ('memory', 'register')").groupBy("graph_id", F.col("source").alias("address")).agg(F.count("*").alias("unresolved_indirect_out_callsites"))
    for counts in (out_calls, in_callers, open_sites):
        nodes = nodes.join(counts, KEY, "left")
    nodes = nodes.fillna(0, ["resolved_out_calls", "resolved_in_callers", "unresolved_indirect_out_callsites"])
    nodes = nodes.withColumn("id", node_id(F.col("address"), bias)).withColumn("anchor_kind", F.when(~F.col("scored"), kind))
    nodes = nodes.select(
        "graph_id", "id", F.when(F.col("scored"), "user").otherwise("anchor").alias("type"), "scored", "anchor_kind",
        F.when(~F.col("scored"), anchor_color_class(F.col("id"), F.col("anchor_kind"), rules.anchors)).alias("color_class"),
        "resolved_out_calls", "unresolved_indirect_out_callsites", F.lit(None).cast("bigint").alias("address_taken_references"), "resolved_in_callers",
    )
    return {"nodes": nodes, "edges": _inside(graph, selected, bias), "abstentions": abstained.select("graph_id", node_id(F.col("address"), bias).alias("id"))}


def project_frozen(functions: DataFrame, transfers: DataFrame, candidates: DataFrame, roots: DataFrame, score_root: bool = False, bias: int = ID_BIAS) -> dict[str, DataFrame]:
    """The older form: immediate and tail edges only, context limited to independently discovered functions, no abstentions."""
    known = functions.select(*KEY).distinct()
    allowed = candidates.union(functions.where("discovered").select(*KEY)).distinct().withColumnRenamed("address", "target")
    graph = cut(resolved_edges(transfers, FROZEN).join(allowed, ["graph_id", "target"], "left_semi").select("graph_id", "source", "target", "count"))
    selected = cut(_closure(graph, roots.union(candidates), known))
    scored = candidates.union(roots) if score_root else candidates
    nodes = selected.join(scored.distinct().withColumn("scored", F.lit(True)), KEY, "left").fillna(False, ["scored"])
    nodes = nodes.select("graph_id", node_id(F.col("address"), bias).alias("id"), F.when(F.col("scored"), "user").otherwise("anchor").alias("type"), "scored", F.lit(None).cast("string").alias("color_class"))
    return {"nodes": nodes, "edges": _inside(graph, selected, bias)}


def boundary_record(extraction: DataFrame, bounds: DataFrame) -> DataFrame:
    """What a projected graph records of its boundaries: mode and mismatches (graph_id, boundary_mode, address, ...), of selected extents only."""
    return extraction.join(bounds.select(*KEY).distinct(), KEY, "left_semi")


def _inside(graph: DataFrame, selected: DataFrame, bias: int) -> DataFrame:
    ends = lambda side: selected.withColumnRenamed("address", side)
    inner = graph.join(ends("source"), ["graph_id", "source"], "left_semi").join(ends("target"), ["graph_id", "target"], "left_semi")
    return inner.select("graph_id", node_id(F.col("source"), bias).alias("src"), node_id(F.col("target"), bias).alias("dst"), "count")
