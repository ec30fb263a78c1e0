"""Queries over decoded instructions, symbols and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars, symbols
from weftgraph.operators import assembly, audit, diagnostics, evidence, projection, roots, truth
from weftgraph.plans.queries import _STD, _SYM, _OWNER, _ORIGIN, query
from weftgraph.session import table
from weftgraph.sources import documents
from weftgraph.sources.bridges import view, with_views

_CODE = with_views("code_functions", "code_ops", "code_slots")


@query(_CODE + """, w AS (SELECT o.*, coalesce(max(CASE WHEN mnemonic = 'nop' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY callsite RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 0 AS terminal, s.slot_target,
        coalesce(imm_target, s.slot_target) AS t FROM code_ops o LEFT JOIN code_slots s ON s.slot = o.slot),
    x AS (SELECT w.*, imm_target IS NULL AND slot_target IS NOT NULL AS by_slot, CASE WHEN e.address IS NOT NULL THEN e.address END AS around FROM w LEFT JOIN code_functions e ON e.address = (w.t // 64) * 64 WHERE is_call OR is_jump),
    y AS (SELECT *, CASE WHEN by_slot THEN CASE WHEN around = t AND (is_call OR around <> source) THEN around END WHEN is_call THEN around WHEN around = t AND around <> source THEN around END AS fn FROM x),
    z AS (SELECT y.*, f.is_import, CASE WHEN f.is_import THEN 'filtered' WHEN fn IS NOT NULL THEN 'resolved' WHEN t IS NOT NULL AND (is_call OR by_slot) THEN 'unmapped' WHEN t IS NULL AND (is_call OR (operand IN ('memory', 'register') AND terminal)) THEN 'unresolved' END AS status FROM y LEFT JOIN code_functions f ON f.address = fn)
    SELECT source, callsite, CASE WHEN is_call THEN 'call' ELSE 'tail-call' END AS kind, operand AS operand_kind, status, CASE WHEN status IN ('resolved', 'filtered') THEN fn WHEN status = 'unmapped' THEN t END AS target,
        CASE WHEN status = 'unresolved' THEN NULL WHEN by_slot THEN 'elf-relocation' WHEN is_call THEN 'direct-immediate' ELSE 'direct-tail' END AS resolver, CASE WHEN status = 'unresolved' THEN 'unknown' ELSE 'exact' END AS confidence,
        CASE WHEN status = 'filtered' THEN 'import' END AS filter_reason, CASE WHEN status = 'unresolved' AND operand IN ('memory', 'register') THEN 'not_run' ELSE 'not_applicable' END AS indirect_status FROM z WHERE status IS NOT NULL""")
def classify(spark, sf_dir):
    functions, ops, slots = (view(spark, sf_dir, n) for n in ("code_functions", "code_ops", "code_slots"))
    return evidence.default_indirect(evidence.classify(ops, functions, slots)).drop("graph_id", "instruction")


@query(_CODE + """, s AS (SELECT source, callsite + length AS stop, coalesce(lead(callsite) OVER (PARTITION BY source ORDER BY callsite), source + 64) AS next FROM code_ops WHERE source IN (SELECT address FROM code_functions)) SELECT source, stop AS "at" FROM s WHERE stop <> next""")
def decoding_gaps(spark, sf_dir):
    functions, ops = (view(spark, sf_dir, n) for n in ("code_functions", "code_ops"))
    return evidence.decoding_gaps(ops, functions).select("source", "at")


@query("SELECT l_partkey AS slot, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS target, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def relocation_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("graph_id"), F.col("l_partkey").alias("slot"), F.col("l_suppkey").alias("target"))
    good, bad = evidence.relocation_targets(rows)
    return good.select("slot", F.col("slot_target").alias("target"), F.lit(False).alias("conflict")).unionByName(bad.select("slot", F.lit(None).cast("bigint").alias("target"), F.lit(True).alias("conflict")))


@query("""SELECT CASE WHEN l_tax < 0.04 THEN 'call' ELSE 'mov' END AS kind, CASE WHEN l_discount < 0.05 THEN 'jmp rax' ELSE 'call rax' END AS text, l_tax < 0.04 OR l_discount >= 0.05 AS calls, l_discount < 0.05 AS jumps, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def call_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_tax") < 0.04, "call").otherwise("mov").alias("kind"), F.when(F.col("l_discount") < 0.05, "jmp rax").otherwise("call rax").alias("text"))
    calls, jumps = assembly.is_call(F.col("kind"), F.col("text")), assembly.is_jump(F.col("kind"), F.col("text"))
    return rows.groupBy("kind", "text", calls.alias("calls"), jumps.alias("jumps")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS HUGEINT) ELSE CAST('18446744073709551616' AS HUGEINT) - p_partkey END AS STRING) AS target FROM part")
def code_targets(spark, sf_dir):
    jump = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(-F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", assembly.code_target(jump).cast("string").alias("target"))


@query(with_views("flow_functions", "flow_candidates") + """, b AS (SELECT address, address % 3 + 1 AS size FROM flow_candidates UNION ALL SELECT 7000000 + c_custkey, c_custkey FROM customer), d AS (SELECT * FROM flow_functions WHERE discovered)
    SELECT coalesce(d.address, b.address) AS address, coalesce(d.name, concat('symbol.bound.0x', printf('%x', b.address))) AS name, coalesce(b.size, d.size) AS size, CASE WHEN b.size IS NULL THEN 'radare2' ELSE 'symbol-oracle' END AS boundary_source, d.address IS NOT NULL AS discovered FROM d FULL JOIN b ON b.address = d.address""")
def raw_functions(spark, sf_dir):
    found, bounds = _extents(spark, sf_dir)
    return assembly.raw_functions(found.select("graph_id", "address", "name", "size"), bounds).drop("graph_id")


def _extents(spark, sf_dir):
    functions, candidates = (view(spark, sf_dir, n) for n in ("flow_functions", "flow_candidates"))
    far = table(spark, sf_dir, "customer").select(F.lit("flow").alias("graph_id"), (F.col("c_custkey") + 7000000).alias("address"), F.col("c_custkey").alias("size"))
    return functions.where("discovered"), candidates.withColumn("size", F.col("address") % 3 + 1).unionByName(far)


_EXTENTS = with_views("flow_functions", "flow_candidates") + """, b AS (SELECT address, address % 3 + 1 AS size FROM flow_candidates UNION ALL SELECT 7000000 + c_custkey, c_custkey FROM customer), d AS (SELECT * FROM flow_functions WHERE discovered),
    m AS (SELECT b.address, b.size AS symbol_size, coalesce(d.size, 0) AS found_size FROM b LEFT JOIN d USING (address) WHERE b.size <> coalesce(d.size, 0))"""


@query(_EXTENTS + " SELECT address, symbol_size, found_size FROM m")
def boundary_mismatches(spark, sf_dir):
    found, bounds = _extents(spark, sf_dir)
    return evidence.boundary_mismatches(bounds, found).drop("graph_id")


@query(_EXTENTS + " SELECT address, symbol_size, found_size FROM m WHERE address IN (SELECT address FROM flow_candidates)")
def boundary_record(spark, sf_dir):
    found, bounds = _extents(spark, sf_dir)
    return projection.boundary_record(evidence.boundary_mismatches(bounds, found), view(spark, sf_dir, "flow_candidates")).drop("graph_id")


@query(_EXTENTS + " SELECT address, size FROM b WHERE address NOT IN (SELECT address FROM d)")
def missing_functions(spark, sf_dir):
    found, bounds = _extents(spark, sf_dir)
    return evidence.missing_functions(bounds, found).select("address", "size")


@query(_EXTENTS + " SELECT count(*) AS extents, count(d.address) AS found, count(*) - count(d.address) AS missing, count(*) FILTER (coalesce(d.size, 0) <> b.size) AS mismatched FROM b LEFT JOIN d USING (address)")
def boundary_summary(spark, sf_dir):
    found, bounds = _extents(spark, sf_dir)
    return diagnostics.boundary_summary(bounds, found).drop("graph_id")


#: Each site by itself: who else is open at its callsite, what is seen there, and what of that is its own.
_CFG = with_views("cfg_sites", "cfg_edges", "cfg_jumps") + """, seen AS MATERIALIZED (SELECT callsite, jump_kind, target FROM cfg_edges WHERE target IS NOT NULL
        UNION ALL SELECT callsite, jump_kind, one FROM cfg_jumps WHERE NOT bare UNION ALL SELECT callsite, jump_kind, two FROM cfg_jumps WHERE NOT bare UNION ALL SELECT callsite, jump_kind, NULL FROM cfg_jumps WHERE bare),
    found AS MATERIALIZED (SELECT s.source, s.callsite, s.kind,
        EXISTS (SELECT 1 FROM cfg_sites o WHERE o.callsite = s.callsite AND o.source <> s.source) AS shared, EXISTS (SELECT 1 FROM seen WHERE seen.callsite = s.callsite) AS met FROM cfg_sites s),
    got AS MATERIALIZED (SELECT source, callsite, shared AND met AS ambiguous, coalesce(t, []) AS targets FROM found LEFT JOIN (SELECT f.source, f.callsite, list_sort(list(DISTINCT seen.target)) AS t FROM found f JOIN seen USING (callsite)
        WHERE NOT f.shared AND seen.target IS NOT NULL AND seen.jump_kind = CASE f.kind WHEN 'call' THEN 'Ijk_Call' ELSE 'Ijk_Boring' END GROUP BY ALL) USING (source, callsite))"""


def _cfg(spark, sf_dir):
    sites, flow, jumps = (view(spark, sf_dir, n) for n in ("cfg_sites", "cfg_edges", "cfg_jumps"))
    jumps = jumps.withColumn("targets", F.when(~F.col("bare"), F.array("one", "two")))
    return sites, evidence.cfg_resolutions(sites, flow, jumps)


@query(_CFG + " SELECT source, callsite, ambiguous, array_to_string(targets, ',') AS targets FROM got")
def cfg_resolutions(spark, sf_dir):
    found = _cfg(spark, sf_dir)[1]
    return found.select("source", "callsite", F.col("ambiguous_source").alias("ambiguous"), F.array_join("targets", ",").alias("targets"))


@query(_CFG + """ SELECT source, callsite, kind, CASE WHEN ambiguous THEN 'ambiguous_source' WHEN len(targets) = 0 THEN 'no_angr_result' WHEN len(targets) > 1 THEN 'multiple_targets' WHEN targets[1] % 2 = 0 AND targets[1] IN (SELECT s_suppkey FROM supplier) THEN 'resolved_internal'
    WHEN targets[1] % 3 = 0 THEN 'resolved_import' WHEN targets[1] % 5 = 0 THEN 'unresolvable_target' ELSE 'unknown_target' END AS fate, CASE WHEN len(targets) = 1 AND ((targets[1] % 2 = 0 AND targets[1] IN (SELECT s_suppkey FROM supplier)) OR targets[1] % 3 = 0) THEN targets[1] END AS target,
    CASE WHEN ambiguous THEN 0 ELSE len(targets) END AS n FROM got JOIN (SELECT source, callsite, kind FROM found) USING (source, callsite)""")
def merge_cfg_resolutions(spark, sf_dir):
    sites, found = _cfg(spark, sf_dir)
    about = lambda t: F.struct(t.alias("address"), F.when(t % 3 == 0, "import").when(t % 5 == 0, "unresolvable").otherwise("unknown").alias("category"), F.concat(F.lit("n"), t.cast("string")).alias("name"))
    # metadata that a later entry replaces
    found = found.withColumn("target_metadata", F.concat(F.transform("targets", lambda t: about(t + F.lit(1)).withField("address", t)), F.transform("targets", about)))
    nothing = F.lit(None).cast("string")
    waiting = sites.select("graph_id", "source", "callsite", "kind", F.lit("register").alias("operand_kind"), F.lit("unresolved").alias("status"), F.lit(None).cast("bigint").alias("target"), nothing.alias("resolver"), F.lit("unknown").alias("confidence"), nothing.alias("filter_reason"), F.lit("not_run").alias("indirect_status"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.lit("cfg").alias("graph_id"), F.col("s_suppkey").alias("address"))
    merged = evidence.merge_resolutions(waiting, found, known)
    return merged.select("source", "callsite", "kind", F.col("indirect_status").alias("fate"), "target", F.size("indirect_targets").cast("bigint").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'internal' WHEN p_size < 10 THEN 'unresolvable' WHEN p_size < 40 AND p_partkey % 2 = 0 THEN 'import' ELSE 'unknown' END AS category,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size < 10 THEN 'UnresolvableJumpTarget' WHEN p_size < 40 THEN p_name END AS name FROM part""")
def target_metadata(spark, sf_dir):
    part, x = table(spark, sf_dir, "part"), F.lit("x").alias("graph_id")
    names = F.when(F.col("p_size") < 10, F.array(F.lit(None), F.lit("UnresolvableJumpTarget"))).when(F.col("p_size") < 40, F.array(F.lit("SimProcedure"), F.lit(""), "p_name", F.lit("later"))).otherwise(F.array(F.lit("None")))
    even = F.col("p_partkey") % 2 == 0
    targets = part.select(x, F.col("p_partkey").alias("address"), (even & (F.col("p_size") < 20)).alias("hooked"), (even & (F.col("p_size") >= 20)).alias("outside"), names.alias("names"))
    known = part.where("p_partkey % 7 = 0").select(x, F.col("p_partkey").alias("address"))
    return assembly.target_metadata(targets, known).select(F.col("address").alias("p_partkey"), "category", "name")


@query("""WITH f AS (SELECT CAST(c_nationkey AS STRING) AS graph_id, c_custkey AS address, CASE WHEN c_custkey % 50 = 1 THEN 'main' WHEN c_custkey % 50 = 2 THEN 'x::main' WHEN c_custkey % 3 = 0 THEN 'entry0' ELSE c_name END AS name FROM customer),
    r AS (SELECT graph_id, coalesce(min(address) FILTER (name = 'main'), min(address) FILTER (name LIKE '%main')) AS m, min(address) FILTER (name = 'entry0') AS e FROM f GROUP BY graph_id)
    SELECT graph_id, coalesce(m, e) AS address, CASE WHEN m IS NOT NULL THEN 'main' ELSE 'entry0' END AS how FROM r WHERE coalesce(m, e) IS NOT NULL""")
def named_roots(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 50 == 1, "main").when(key % 50 == 2, "x::main").when(key % 3 == 0, "entry0").otherwise(F.col("c_name"))
    functions = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("graph_id"), key.alias("address"), name.alias("name"))
    ops = spark.createDataFrame([], "graph_id string, source bigint, callsite bigint, text string, pointer bigint, is_call boolean, is_jump boolean, imm_target bigint, is_end boolean, whole boolean")
    return roots.resolve_roots(functions, ops)


# Symbols


@query(with_views("bracket_names") + """ SELECT p_partkey, brand AS owner, CASE p_partkey % 4 WHEN 0 THEN name WHEN 1 THEN concat(brand, '::f::g') WHEN 2 THEN concat(brand, '::_::impl_for=', brand, '::X::de') ELSE concat(brand, '::impl=Foo::g') END AS origin,
    CASE p_partkey % 4 WHEN 0 THEN 'fmt' WHEN 1 THEN concat(brand, '::f::g') WHEN 2 THEN concat(brand, '::_::de') ELSE concat(brand, '::g') END AS probe, brand AS probe_owner FROM bracket_names""")
def bracket_names(spark, sf_dir):
    name = F.col("name")
    return view(spark, sf_dir, "bracket_names").select("p_partkey", symbols.symbol_owner(name).alias("owner"), symbols.symbol_origin(name, [], root_namespace="app").alias("origin"), symbols.probe_origin(name).alias("probe"), symbols.probe_owner(name).alias("probe_owner"))


_LINES = """SELECT CASE p_partkey % 5 WHEN 0 THEN concat('  ', printf('%016x', p_partkey * 16), ' T ', p_name) WHEN 1 THEN concat(printf('%016x', p_partkey * 16), ' d ', p_name) WHEN 2 THEN 'zz 00 t broken'
    ELSE concat(printf('%016x', p_partkey * 16), ' ', printf('%016x', CAST(p_size AS BIGINT)), ' t ', p_name) END AS value FROM {0}"""


@query("SELECT p_partkey * 16 AS address, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS size, CASE WHEN p_partkey % 5 = 0 THEN 'T' ELSE 't' END AS kind, p_name AS name FROM part WHERE p_partkey % 5 IN (0, 3, 4)")
def parse_listing(spark, sf_dir):
    lines = spark.sql(_LINES.replace("{0}", "{part}"), part=table(spark, sf_dir, "part"))
    return documents.parse_listing(lines)


@query(_SYM + f", s AS (SELECT address, name, {_ORIGIN} AS origin, {_OWNER} AS owner FROM symbols) SELECT printf('FUN_%08x', address + 1048576) AS member, CASE WHEN count(DISTINCT origin) > 1 THEN concat('shared-address@', printf('FUN_%08x', address + 1048576)) ELSE min(origin) END AS origin, CASE WHEN count(DISTINCT origin) > 1 THEN 'shared-address' ELSE min(owner) END AS owner FROM s GROUP BY address")
def symbol_catalog(spark, sf_dir):
    return truth.catalog(view(spark, sf_dir, "symbols"), "app").select("member", "origin", "owner")


@query(_SYM + f" SELECT DISTINCT address FROM symbols WHERE {_OWNER} NOT IN {_STD}")
def candidate_addresses(spark, sf_dir):
    return truth.candidate_addresses(view(spark, sf_dir, "symbols"), [], root_namespace="app")


@query(_SYM + f""", t AS (SELECT address, CASE WHEN count(DISTINCT {_ORIGIN}) > 1 THEN concat('shared-address@', printf('FUN_%08x', address + 1048576)) ELSE min({_ORIGIN}) END AS origin FROM symbols WHERE {_OWNER} NOT IN {_STD} GROUP BY address)
    SELECT origin, count(*) AS members, min(address) AS first FROM t GROUP BY origin""")
def truth_origins(spark, sf_dir):
    rows = truth.origins(truth.ground_truth(view(spark, sf_dir, "symbols"), [], root_namespace="app"))
    return rows.select("origin", F.size("members").cast("bigint").alias("members"), "first")


@query("""WITH r AS (SELECT l_partkey AS address, CASE WHEN l_tax < 0.02 THEN 0 WHEN l_tax < 0.05 THEN 1 ELSE 2 END AS s FROM lineitem) SELECT address, ['direct-flirt', 'propagated-wrapper', 'cleanup-heuristic'][min(s) + 1] AS evidence, count(*) FILTER (s = f) AS n FROM (SELECT address, s, min(s) OVER (PARTITION BY address) AS f FROM r) GROUP BY address""")
def stage_labels(spark, sf_dir):
    stage = F.when(F.col("l_tax") < 0.02, audit.STAGES[0]).when(F.col("l_tax") < 0.05, audit.STAGES[1]).otherwise(audit.STAGES[2])
    rows = audit.stage_labels(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("address"), stage.alias("evidence")), audit.STAGES)
    return rows.groupBy("address", "evidence").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name AS display, p_partkey % 3 = 0 OR p_size < 10 AS imported, p_partkey * 4 - 100 + 4096 AS linked, CASE WHEN p_size > 40 THEN '-' ELSE format('{:,}', p_partkey * 1000) END AS cell, CASE WHEN p_size > 40 THEN 'N/A' ELSE printf('%.2f', p_size / 64) END AS metric,
    CASE WHEN p_size < 10 THEN 'none' ELSE CAST(p_size AS STRING) END AS inner_size FROM part""")
def scalar_texts(spark, sf_dir):
    part, some = table(spark, sf_dir, "part"), F.col("p_size") <= 40
    name = F.when(F.col("p_partkey") % 3 == 0, "sym.imp.x").otherwise("x")
    json = F.when(F.col("p_size") < 10, '{"a":{}}').otherwise(F.concat(F.lit('{"a":{"b":'), F.col("p_size").cast("string"), F.lit("}}")))
    return part.select(
        "p_partkey", scalars.display_symbol(F.concat(F.lit("app::"), "p_name", F.lit("::h0123456789abcdef")), F.lit("app")).alias("display"), scalars.is_import(name, F.when(F.col("p_size") < 10, "sym")).alias("imported"),
        scalars.linked_address(F.col("p_partkey") * 4, F.lit(100), F.lit(4096)).alias("linked"), scalars.value_text(F.when(some, F.col("p_partkey") * 1000), "bigint").alias("cell"), scalars.metric_text(F.when(some, F.col("p_size") / 64)).alias("metric"),
        scalars.nested(json, "a", "b", default="none").alias("inner_size"),
    )
