"""Call evidence: classification of decoded instructions, dedup, merging of inferred targets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.operators.sweep import first_holding
from weftgraph.schemas import INFERRED, REJECTIONS, RELOCATION
from weftgraph.session import cut, partitions

SITE = ["graph_id", "source", "callsite"]
#: Jump kinds of control flow, by kind of transfer. Fixed values.
JUMP_KINDS = {"call": "Ijk_Call", "tail-call": "Ijk_Boring"}
#: Rows of a shuffle partition, about, where instructions are classified.
TASK = 1 << 20
#: Instructions that may follow a terminal jump.
PADDING = ("nop", "int3", "trap")


def containing_function(points: DataFrame, functions: DataFrame, point: str = "target") -> DataFrame:
    """``points`` with ``function``: the function that starts at the point, else the first, by address, whose extent holds it.

    Extents are swept in the order of their addresses, see ``sweep.first_holding``: each costs one row, however long it is.
    """
    starts = functions.select("graph_id", F.col("address").alias(point), F.col("address").alias("exact"))
    joined = points.join(starts, ["graph_id", point], "left")
    extents = functions.where("size > 0").select("graph_id", F.col("address").alias("start"), (F.col("address") + F.col("size")).alias("stop"))
    inside = first_holding(joined.where("exact is null").select("graph_id", point).distinct(), extents, "graph_id", point)
    return joined.join(inside, ["graph_id", point], "left").withColumn("function", F.coalesce("exact", "around")).drop("exact", "around")


def direct_target(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls resolve to the function that contains the target; tail jumps only to another function's exact start."""
    placed = containing_function(sites, functions)
    tail = (F.col("kind") == "tail-call") & ((F.col("function") != F.col("target")) | (F.col("function") == F.col("source")))
    return placed.withColumn("function", F.when(~F.coalesce(tail, F.lit(False)), F.col("function")))


def operand_kind(text: Column, has_target: Column) -> Column:
    """memory for a bracketed operand, register for any other that isn't hex; immediate where the jump has a target."""
    operand = F.regexp_extract(text, r"^\s*\S+ \s*(.*)$", 1)
    other = (operand != "") & ~operand.startswith("0x")
    return F.when(operand.contains("["), "memory").when(other, "register").when(F.coalesce(has_target, F.lit(False)), "immediate").otherwise("unknown")


def with_terminal(ops: DataFrame) -> DataFrame:
    """``terminal``: only padding follows the instruction in its function, at later addresses; repeated rows don't follow each other."""
    after = Window.partitionBy("graph_id", "source").orderBy("callsite").rangeBetween(1, Window.unboundedFollowing)
    more = F.max(F.when(F.lower("mnemonic").isin(*PADDING), 0).otherwise(1)).over(after)
    return ops.withColumn("terminal", F.coalesce(more, F.lit(0)) == 0)


def decoding_gaps(ops: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions whose extent isn't decoded without a gap: (graph_id, source, at).

    Instructions are sorted once, before they meet the extents: the join takes them in that order.
    """
    within = Window.partitionBy("graph_id", "source").orderBy("callsite")
    ends = F.col("callsite") + F.col("length")
    extents = functions.where("boundary_source = 'symbol-oracle' and size > 0").select("graph_id", F.col("address").alias("source"), (F.col("address") + F.col("size")).alias("stop"))
    stepped = ops.select("graph_id", "source", ends.alias("at"), F.lead("callsite").over(within).alias("next")).where("next is null or at <> next")
    return stepped.join(extents.hint("merge"), ["graph_id", "source"]).where(F.col("at") != F.coalesce("next", "stop")).select("graph_id", "source", "at")


def classify(ops: DataFrame, functions: DataFrame, relocations: DataFrame) -> DataFrame:
    """Transfers from decoded instructions.

    ops: (graph_id, source, callsite, length, mnemonic, text, operand, is_call, is_jump, imm_target, slot);
    functions: schemas.FUNCTIONS and ``is_import``; relocations: (graph_id, slot, slot_target).
    A known import is filtered, a known function resolved; an exact target without a function stays unmapped for calls
    and relocations; an indirect call, and an indirect jump that ends its function, are unresolved; the rest isn't
    evidence. Shuffle partitions follow the number of instructions.
    """
    with partitions(ops.sparkSession, -(-ops.count() // TASK)):
        return cut(_classified(ops, functions, relocations))


def _classified(ops: DataFrame, functions: DataFrame, relocations: DataFrame) -> DataFrame:
    """``classify``, step by step. Rows without a slot or a target stay out of the joins on these, where they would be one key."""
    moves = F.col("is_call") | F.col("is_jump")
    by_slot = F.coalesce(moves & F.col("imm_target").isNull() & F.col("slot").isNotNull(), F.lit(False))
    slots = ops.where(by_slot).join(relocations, ["graph_id", "slot"], "left")
    rows = slots.unionByName(ops.where(~by_slot), allowMissingColumns=True).select(
        *SITE, "mnemonic", "is_call", "is_jump", *[F.when(moves, F.col(c)).alias(c) for c in ("text", "operand", "imm_target", "slot_target")],
    )
    rows = with_terminal(rows).where(moves).withColumn("target", F.coalesce("imm_target", "slot_target")).withColumn("kind", F.when(F.col("is_call"), "call").otherwise("tail-call"))
    rows = cut(rows.withColumn("by_slot", F.col("imm_target").isNull() & F.col("slot_target").isNotNull()).drop("mnemonic", "imm_target", "slot_target"))
    rows = direct_target(rows.where("target is not null"), functions).unionByName(rows.where("target is null"), allowMissingColumns=True)
    start = F.when(F.col("by_slot"), F.when(F.col("function") == F.col("target"), F.col("function"))).otherwise(F.col("function"))
    known = functions.select("graph_id", F.col("address").alias("function__"), "is_import")
    rows = rows.withColumn("function__", start).join(known, ["graph_id", "function__"], "left")
    resolver = F.when(F.col("by_slot"), RELOCATION).when(F.col("is_call"), "direct-immediate").otherwise("direct-tail")
    leaves = F.col("is_call") | F.col("by_slot")
    status = (
        F.when(F.col("is_import"), "filtered").when(F.col("function__").isNotNull(), "resolved").when(F.col("target").isNotNull() & leaves, "unmapped")
        .when(F.col("target").isNull() & (F.col("is_call") | (F.col("operand").isin("memory", "register") & F.col("terminal"))), "unresolved")
    )
    rows = rows.withColumn("status", status).where("status is not null")
    known_target = F.col("status") != "unresolved"
    return rows.select(
        *SITE, F.col("text").alias("instruction"), "kind", F.col("operand").alias("operand_kind"), "status",
        F.when(F.col("status").isin("resolved", "filtered"), F.col("function__")).when(known_target, F.col("target")).alias("target"), F.when(known_target, resolver).alias("resolver"),
        F.when(known_target, "exact").otherwise("unknown").alias("confidence"), F.when(F.col("status") == "filtered", "import").alias("filter_reason"),
    )


def default_indirect(transfers: DataFrame) -> DataFrame:
    """``indirect_status`` before any inference."""
    waits = (F.col("status") == "unresolved") & F.col("operand_kind").isin("memory", "register")
    return transfers.withColumn("indirect_status", F.when(waits, "not_run").otherwise("not_applicable"))


def callsite_conflicts(transfers: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Sites whose repeated rows differ: (key, variants). Rows are compared by hash, so a hot site combines early."""
    return transfers.groupBy(*key).agg(F.count_distinct(F.struct(*columns)).alias("variants")).where("variants > 1")


def dedup_callsites(transfers: DataFrame) -> DataFrame:
    """Identical repeats of a site collapse."""
    return transfers.dropDuplicates()


def missing_functions(bounds: DataFrame, functions: DataFrame) -> DataFrame:
    """Extents that discovery missed, as functions of the symbol oracle."""
    return bounds.join(functions, ["graph_id", "address"], "left_anti").withColumn("boundary_source", F.lit("symbol-oracle"))


def boundary_mismatches(bounds: DataFrame, functions: DataFrame) -> DataFrame:
    """Extents whose discovered size differs; 0 where nothing was discovered."""
    found = functions.where("discovered").select("graph_id", "address", F.col("size").alias("found_size"))
    return bounds.join(found, ["graph_id", "address"], "left").select("graph_id", "address", F.col("size").alias("symbol_size"), F.coalesce("found_size", F.lit(0)).cast("bigint").alias("found_size")).where("symbol_size <> found_size")


def relocation_targets(relocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slot, target) and the slots with conflicting targets."""
    rows = relocations.groupBy("graph_id", "slot").agg(F.min("target").alias("slot_target"), F.count_distinct("target").alias("n"))
    return rows.where("n = 1").drop("n"), rows.where("n > 1").select("graph_id", "slot")


def cfg_resolutions(sites: DataFrame, flow: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    """Resolutions of all open sites: (graph_id, source, callsite, targets, ambiguous_source).

    sites: open transfers; flow: control-flow edges (graph_id, callsite, jump_kind, target); jumps: indirect-jump tables
    (graph_id, callsite, jump_kind, targets), an array that may be null or empty. A callsite belongs to the raw sources
    that have an open transfer there. Where there are several, any edge or table at the callsite, of whatever kind, makes
    their sites ambiguous, and they get no target. A sole owner gets the targets of edges and tables of its own kind
    together. Sites without any stay, with no targets.
    """
    sites = sites.select(*SITE, "kind").distinct()
    owned = sites.groupBy("graph_id", "callsite").agg(F.count_distinct("source").alias("owners"))
    seen = flow.where("callsite is not null and target is not null").select("graph_id", "callsite", "jump_kind", "target")
    if jumps is not None:
        seen = seen.unionByName(jumps.where("callsite is not null").select("graph_id", "callsite", "jump_kind", F.explode_outer("targets").alias("target")))
    seen = seen.distinct().withColumn("seen", F.lit(True))
    found = sites.join(owned, ["graph_id", "callsite"]).join(seen, ["graph_id", "callsite"], "left")
    mine = (F.col("owners") == 1) & (F.col("jump_kind") == F.when(F.col("kind") == "call", JUMP_KINDS["call"]).otherwise(JUMP_KINDS["tail-call"]))
    return found.groupBy(*SITE).agg(F.array_sort(F.collect_set(F.when(mine, F.col("target")))).alias("targets"), F.coalesce(F.bool_or((F.col("owners") > 1) & F.col("seen")), F.lit(False)).alias("ambiguous_source"))


def merge_resolutions(transfers: DataFrame, resolutions: DataFrame, functions: DataFrame) -> DataFrame:
    """Give sites that wait (``not_run``) their inferred targets.

    How many targets there are is tested before what they are: one known and one unknown target are ``multiple_targets``.
    Of repeated metadata of a target the last counts.
    """
    flat = resolutions.select(*SITE, "ambiguous_source", F.explode_outer("targets").alias("t"))
    about = resolutions.select(*SITE, F.posexplode("target_metadata").alias("nth", "m")).groupBy(*SITE, F.col("m.address").alias("t")).agg(F.max_by("m", "nth").alias("m"))
    flat = flat.join(about, [*SITE, "t"], "left").select(*SITE, "ambiguous_source", "t", "m.category", "m.name")
    merged = flat.groupBy(*SITE).agg(
        F.array_sort(F.collect_set("t")).alias("found"), F.max("ambiguous_source").alias("ambiguous"), F.max("category").alias("category"), F.max("name").alias("name"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.struct(F.col("t"), F.col("name")))))).alias("names"),
    )
    rows = transfers.join(merged, SITE, "left").withColumn("only", F.when(F.size("found") == 1, F.try_element_at("found", F.lit(1))))
    known = functions.select("graph_id", F.col("address").alias("only"), F.lit(True).alias("is_known")).distinct()
    rows = rows.join(known, ["graph_id", "only"], "left")
    waits, count = F.col("indirect_status") == "not_run", F.coalesce(F.size("found"), F.lit(0))
    decided = (
        F.when(~waits, F.col("indirect_status")).when(F.col("ambiguous"), "ambiguous_source").when(count <= 0, "no_angr_result").when(count > 1, "multiple_targets").when(F.col("is_known"), "resolved_internal")
        .when((F.col("category") == "import") & (F.col("name") != ""), "resolved_import").when(F.col("category") == "unresolvable", "unresolvable_target").otherwise("unknown_target")
    )
    rows = rows.withColumn("decided", decided)
    hit = waits & F.col("decided").isin("resolved_internal", "resolved_import")
    shown = waits & (F.col("decided") != "ambiguous_source")
    return rows.select(
        *SITE, "kind", "operand_kind",
        F.when(hit & (F.col("decided") == "resolved_internal"), "resolved").when(hit, "filtered").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("only")).otherwise(F.col("target")).alias("target"),
        F.when(hit, INFERRED).otherwise(F.col("resolver")).alias("resolver"), F.when(hit, "inferred").otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit & (F.col("decided") == "resolved_import"), "import").otherwise(F.col("filter_reason")).alias("filter_reason"), F.col("decided").alias("indirect_status"),
        F.when(shown, F.coalesce("found", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")).alias("indirect_targets"), F.when(shown, F.col("names")).alias("indirect_names"),
    )


def _indirect_counts() -> list[Column]:
    internal, imported = F.count_if(F.col("indirect_status").isin("accepted", "resolved_internal")), F.count_if(F.col("indirect_status") == "resolved_import")
    return [F.count("*").alias("total"), internal.alias("resolved_internal"), imported.alias("resolved_import"), (F.count("*") - internal - imported).alias("unresolved")]


def indirect(transfers: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Indirect sites that inference applies to, optionally of some sources (graph_id, address)."""
    rows = transfers.where("kind in ('call', 'tail-call') and operand_kind in ('memory', 'register') and coalesce(indirect_status, '') <> 'not_applicable'")
    return rows if sources is None else rows.join(sources.select("graph_id", F.col("address").alias("source")), ["graph_id", "source"], "left_semi")


def indirect_summary(transfers: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Totals, rejections and the two rates, by graph. Imports don't count in the internal rate's denominator."""
    reasons = [F.count_if(F.col("indirect_status") == r).alias(r) for r in REJECTIONS]
    rows = indirect(transfers, sources).groupBy("graph_id").agg(*_indirect_counts(), *reasons)
    internal, imported, total = F.col("resolved_internal").cast("double"), F.col("resolved_import").cast("double"), F.col("total").cast("double")
    return rows.withColumn("target_rate", F.coalesce(F.try_divide(internal + imported, total), F.lit(0.0))).withColumn("internal_rate", F.coalesce(F.try_divide(internal, total - imported), F.lit(0.0)))


def indirect_by_operand(transfers: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    return indirect(transfers, sources).groupBy("graph_id", "operand_kind").agg(*_indirect_counts())


def exact_static_summary(transfers: DataFrame) -> DataFrame:
    """Indirect transfers that relocations prove, by status."""
    rows = transfers.where(F.col("operand_kind").isin("memory", "register") & (F.col("resolver") == RELOCATION))
    return rows.groupBy("graph_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("resolved", "resolved_internal"), ("filtered", "filtered_import"), ("unmapped", "unmapped"))])


def in_order(transfers: DataFrame) -> DataFrame:
    """Document order of evidence."""
    return transfers.orderBy("graph_id", "source", "callsite", F.coalesce("target", F.lit(-1)))


def edge_impact(transfers: DataFrame, candidates: DataFrame) -> DataFrame:
    """What accepted inferred edges add for candidates: callsites, distinct edges, touched and untouched candidates."""
    taken = transfers.where(F.col("indirect_status").isin("accepted", "resolved_internal") & (F.col("resolver") == INFERRED)).select("graph_id", "source", "target")
    mark = candidates.select("graph_id", "address").distinct().withColumn("is_candidate", F.lit(True))
    rows = taken.join(mark.select("graph_id", F.col("address").alias("source"), F.col("is_candidate").alias("out")), ["graph_id", "source"], "left")
    rows = rows.join(mark.select("graph_id", F.col("address").alias("target"), F.col("is_candidate").alias("into")), ["graph_id", "target"], "left").fillna(False, ["out", "into"])
    edge = F.struct("source", "target")
    sums = rows.groupBy("graph_id").agg(
        F.count("*").alias("callsites"), F.count_distinct(edge).alias("edges"), F.count_if("out").alias("outgoing_callsites"), F.count_if("into").alias("incoming_callsites"),
        F.count_distinct(F.when(F.col("out"), edge)).alias("outgoing_edges"), F.count_distinct(F.when(F.col("into"), edge)).alias("incoming_edges"),
        F.count_distinct(F.when(F.col("out"), F.col("source"))).alias("with_outgoing"), F.count_distinct(F.when(F.col("into"), F.col("target"))).alias("with_incoming"),
    )
    touched = rows.where("out").select("graph_id", F.col("source").alias("address")).union(rows.where("into").select("graph_id", F.col("target").alias("address"))).distinct()
    rest = candidates.join(touched, ["graph_id", "address"], "left_anti").groupBy("graph_id").agg(F.count_distinct("address").alias("unchanged"))
    out = rest.join(sums, "graph_id", "full_outer")
    return out.fillna(0, [c for c in out.columns if c != "graph_id"])
