"""From decoded instructions to raw graphs and projections, in the order of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.operators import checks, evidence, projection, roots
from weftgraph.operators.projection import KEY
from weftgraph.session import StepLog

# Names that stand for open targets, and names that say nothing.
OPEN_TARGETS = ("UnresolvableCallTarget", "UnresolvableJumpTarget")
NO_NAMES = ("SimProcedure", "None")


def raw_functions(discovered: DataFrame, bounds: DataFrame) -> DataFrame:
    """Functions of a raw graph: a given extent's size wins; extents that discovery missed are added.

    discovered: (graph_id, address, name, size); bounds: (graph_id, address, size).
    """
    given = bounds.select(*KEY, F.col("size").alias("extent"))
    rows = discovered.withColumn("found", F.lit(True)).join(given, KEY, "full_outer").withColumn("discovered", F.coalesce("found", F.lit(False)))
    made = F.concat(F.lit("symbol.bound.0x"), F.lower(F.hex("address")))
    source = F.when(F.col("extent").isNotNull(), "symbol-oracle").otherwise("radare2")
    return rows.select(*KEY, F.coalesce("name", made).alias("name"), F.coalesce("extent", "size").cast("bigint").alias("size"), source.alias("boundary_source"), "discovered")


def is_call(kind: Column, text: Column) -> Column:
    """Instructions that call: by their type, or by their text."""
    return F.coalesce(kind.contains("call"), F.lit(False)) | F.coalesce(text.startswith("call "), F.lit(False))


def is_jump(kind: Column, text: Column) -> Column:
    """Jumps that may be tail calls: unconditional ones."""
    return F.coalesce(kind.isin("jmp", "ujmp"), F.lit(False)) | F.coalesce(text.startswith("jmp "), F.lit(False))


def code_target(jump: Column) -> Column:
    """A jump's target as an unsigned 64-bit address; signed numbers wrap around."""
    return F.pmod(jump.cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)"))


def extract(
    ops: DataFrame, discovered: DataFrame, bounds: DataFrame, candidates: DataFrame, relocations: DataFrame, rules: projection.Policy,
    imports: DataFrame | None = None, explicit_root: DataFrame | None = None, flow: DataFrame | None = None, about: DataFrame | None = None, score_root: bool = False, jumps: DataFrame | None = None, log: StepLog | None = None,
) -> dict[str, DataFrame]:
    """The raw graph (functions, mismatches, roots, transfers) and its projection (nodes, edges, abstentions).

    ops: ``evidence.classify`` and ``roots.resolve_roots``; imports: (graph_id, address) of imported functions. With
    ``flow`` (control-flow edges), and ``jumps`` (indirect-jump tables), open sites get inferred targets; about:
    ``target_metadata``.
    ``log`` gets the rows and seconds of each step. Candidates without a function, repeated extents and graphs without a root are refused.
    """
    log = log or StepLog()
    checks.assert_valid(checks.violations_boundaries(bounds))
    functions = log.cut("functions", raw_functions(discovered, bounds))
    missing = projection.unknown_candidates(functions, candidates)
    checks.assert_valid(missing.select("graph_id", F.lit("candidate is no function").alias("rule"), F.col("address").cast("string").alias("key")))
    root = log.cut("roots", roots.resolve_roots(functions, ops, explicit_root))
    rootless = functions.select("graph_id").distinct().join(root, "graph_id", "left_anti")
    checks.assert_valid(rootless.select("graph_id", F.lit("no root").alias("rule"), F.lit(None).cast("string").alias("key")))
    imported = functions.withColumn("is_import", F.lit(False)) if imports is None else functions.join(imports.select(*KEY).distinct().withColumn("is_import", F.lit(True)), KEY, "left").fillna(False, ["is_import"])
    slots, conflicts = evidence.relocation_targets(relocations)
    checks.assert_valid(conflicts.select("graph_id", F.lit("slot has several targets").alias("rule"), F.col("slot").cast("string").alias("key")))
    transfers = log.cut("transfers", evidence.default_indirect(evidence.dedup_callsites(evidence.classify(ops, imported, slots))))
    if flow is not None:
        waiting = transfers.where("indirect_status = 'not_run'")
        found = evidence.cfg_resolutions(waiting, flow, jumps)
        found = with_metadata(found, about) if about is not None else found.withColumn("target_metadata", F.array().cast("array<struct<address:bigint,category:string,name:string>>"))
        transfers = log.cut("inference", evidence.merge_resolutions(transfers, found, functions))
    place = root.select("graph_id", "address")
    raw = {"functions": functions, "mismatches": evidence.boundary_mismatches(bounds, discovered.withColumn("discovered", F.lit(True))), "roots": root, "transfers": transfers}
    return raw | projection.project(functions, transfers, candidates, place, rules, score_root)


def target_metadata(targets: DataFrame, functions: DataFrame) -> DataFrame:
    """(graph_id, address, category, name) of inferred targets (graph_id, address, hooked, outside, names).

    Known functions are internal. Otherwise the first usable name decides: placeholders of open targets are
    unresolvable, a hooked target or one outside the program is an import, anything else unknown.
    """
    known = functions.select(*KEY).distinct().withColumn("known", F.lit(True))
    usable = F.filter("names", lambda n: n.isNotNull() & (n != "") & ~n.isin(*NO_NAMES))
    name = F.try_element_at(usable, F.lit(1))
    open_target = name.contains(OPEN_TARGETS[0]) | name.contains(OPEN_TARGETS[1])
    rows = targets.join(known, KEY, "left").fillna(False, ["known"])
    category = F.when(F.col("known"), "internal").when(open_target, "unresolvable").when(name.isNotNull() & (F.col("hooked") | F.col("outside")), "import").otherwise("unknown")
    return rows.select(*KEY, category.alias("category"), F.when(~F.col("known"), name).alias("name"))


def with_metadata(resolutions: DataFrame, about: DataFrame) -> DataFrame:
    """Resolutions with ``target_metadata`` of their targets; about: ``target_metadata``."""
    flat = resolutions.select(*evidence.SITE, F.explode("targets").alias("address")).join(about, KEY)
    packed = flat.groupBy(*evidence.SITE).agg(F.collect_list(F.struct("address", "category", "name")).alias("target_metadata"))
    empty = F.array().cast("array<struct<address:bigint,category:string,name:string>>")
    return resolutions.join(packed, evidence.SITE, "left").withColumn("target_metadata", F.coalesce("target_metadata", empty))


def evidence_summary(transfers: DataFrame, candidates: DataFrame, status: str = "not_run") -> DataFrame:
    """Summaries that a raw graph carries, over all sources and over candidates: (graph_id, sources, analysis_status, ...)."""
    both = [evidence.indirect_summary(transfers, only).withColumn("sources", F.lit(name)) for name, only in (("all", None), ("candidate", candidates))]
    return both[0].unionByName(both[1]).withColumn("analysis_status", F.lit(status))
