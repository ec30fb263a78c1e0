"""Projection, closure, merging and evidence scenarios."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import checks, closure, diagnostics, evidence, projection

T = "source bigint, callsite bigint, kind string, operand_kind string, status string, target bigint, resolver string, confidence string, filter_reason string, indirect_status string"
FN = "address bigint, name string, size bigint, boundary_source string, discovered boolean"


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).withColumn("graph_id", F.lit("g"))


def calls(spark, rows):
    """(source, target[, changes]) rows as transfers with callsites of their own."""
    out = []
    for n, (source, target, *more) in enumerate(rows):
        row = {"kind": "call", "operand_kind": "immediate", "status": "resolved", "target": target, "resolver": "direct-immediate", "confidence": "exact", "filter_reason": None, "indirect_status": "not_applicable"} | (more[0] if more else {})
        out.append((source, source + n + 1, *row.values()))
    return table(spark, out, T)


def functions(spark, addresses, hidden=()):
    return table(spark, [(a, f"f{a}", 16, "radare2", a not in hidden) for a in addresses], FN)


def addresses(spark, values):
    return table(spark, [(v,) for v in values], "address bigint").select("graph_id", "address")


RELOCATED = {"resolver": "elf-relocation", "operand_kind": "memory"}
OPEN = {"status": "unresolved", "target": None, "resolver": None, "confidence": "unknown", "operand_kind": "register", "indirect_status": "not_run"}
ROLES = [
    (1000, 2000), (2000, 3000), (2000, 5000), (2100, 3000, RELOCATED), (2000, None, OPEN), (2000, 0xDEAD, {"status": "filtered", "filter_reason": "import"}), (2000, 0xBEEF, {"status": "unmapped"}),
    (3000, 6000), (4000, 2000), (4000, 2100), (4000, 6000), (5000, 2100), (7000, 2000),
]
KNOWN = [1000, 2000, 2100, 3000, 4000, 5000, 6000, 7000]


def project(spark, rows, track, targets, root=1000, known=KNOWN, policy="address", hidden=()):
    return projection.project(functions(spark, known, hidden), calls(spark, rows), addresses(spark, targets), addresses(spark, [root]), projection.policy(track, policy), bias=0)


def kinds(got):
    return {int(r["id"][4:], 16): r["anchor_kind"] for r in got["nodes"].collect()}


def edges(got):
    return {(int(r["src"][4:], 16), int(r["dst"][4:], 16)): r["count"] for r in got["edges"].collect()}


def test_roles(spark):
    got = project(spark, ROLES, "direct-in", [2000, 2100], hidden=(3000,))
    assert kinds(got) == {1000: "root", 2000: None, 2100: None, 3000: "outgoing", 4000: "incoming", 5000: "both", 6000: "context", 7000: "incoming"}
    assert {t for s, t in edges(got) if s == 2000} == {3000, 5000}
    row = got["nodes"].where("id = 'FUN_000007d0'").first()
    assert row["unresolved_indirect_out_callsites"] == 1 and row["color_class"] is None


def test_role_colours(spark):
    got = project(spark, ROLES, "direct-in", [2000, 2100], policy="role")
    assert {r["color_class"] for r in got["nodes"].where("not scored").collect()} == {"ROLE:root", "ROLE:outgoing", "ROLE:incoming", "ROLE:both", "ROLE:context"}


def test_direct_leaves_outside_callers_out(spark):
    got = edges(project(spark, ROLES, "direct", [2000, 2100]))
    assert (3000, 6000) in got and (2100, 3000) in got and not any(s == 4000 for s, _ in got)


def test_frozen(spark):
    got = projection.project_frozen(functions(spark, KNOWN, hidden=(3000,)), calls(spark, ROLES), addresses(spark, [2000, 2100]), addresses(spark, [1000]), bias=0)
    ids = {int(r["id"][4:], 16) for r in got["nodes"].collect()}
    assert 4000 not in ids and 3000 not in ids and (5000, 2100) in edges(got) and not any(s == 2100 for s, _ in edges(got))


ALONE = [(1000, 2000), (2100, 2100), (8000, 2200)]


@pytest.mark.parametrize(("track", "gone"), [("direct", {2100, 2200}), ("direct-in", {2100})])
def test_abstention(spark, track, gone):
    got = project(spark, ALONE, track, [2000, 2100, 2200], known=[1000, 2000, 2100, 2200, 8000])
    assert {int(r["id"][4:], 16) for r in got["abstentions"].collect()} == gone
    assert kinds(got).get(8000) == ("incoming" if track == "direct-in" else None)


def test_opaque_targets(spark):
    rows = [(1000, 2000), (2000, 9000, RELOCATED | {"status": "unmapped"}), (2000, 9000, RELOCATED | {"status": "unmapped"}), (2000, 0xA000, {"status": "unmapped"})]
    got = project(spark, rows, "direct", [2000], known=[1000, 2000], policy="role")
    assert kinds(got) == {1000: "root", 2000: None, 9000: "outgoing"} and edges(got)[2000, 9000] == 2
    frozen = projection.project_frozen(functions(spark, [1000, 2000]), calls(spark, rows), addresses(spark, [2000]), addresses(spark, [1000]), bias=0)
    assert not any(s == 2000 for s, _ in edges(frozen))


def test_unknown_policy_and_track():
    with pytest.raises(ValueError):
        projection.policy("sideways")
    with pytest.raises(ValueError):
        projection.policy("direct", "colourful")


def test_closure_with_cycle_and_self_edge(spark):
    e = table(spark, [(1, 2), (2, 3), (3, 1), (3, 3), (9, 1)], "source bigint, target bigint")
    got = closure.reachable(e, table(spark, [(2,)], "node bigint").select("graph_id", "node"))
    assert {r["node"] for r in got.collect()} == {1, 2, 3}


def test_merge(spark):
    known = functions(spark, [3000, 4000])
    sites = {2010: [4000], 2020: [3000, 4000], 2040: [0xDEAD], 2050: [4000, 0xDEAD], 2060: [4000], 2070: [], 2080: [0xF000], 2090: [0xF100], 2100: [4000]}
    rows = [(2000, s, "tail-call" if s == 2100 else "call", "register", "unresolved", None, None, "unknown", None, "not_run") for s in sites]
    rows.append((2000, 2030, "call", "memory", "resolved", 3000, "elf-relocation", "exact", None, "not_applicable"))
    found = [(2000, s, t, s == 2060, [(0xF000, "import", "malloc")] if s == 2080 else [(0xF100, "unresolvable", "x")] if s == 2090 else []) for s, t in {**sites, 2030: [4000]}.items() if s != 2070]
    resolutions = table(spark, found, "source bigint, callsite bigint, targets array<bigint>, ambiguous_source boolean, target_metadata array<struct<address:bigint,category:string,name:string>>")
    merged = evidence.merge_resolutions(table(spark, rows, T), resolutions, known)
    got = {r["callsite"]: r for r in merged.collect()}
    want = {2010: "resolved_internal", 2020: "multiple_targets", 2030: "not_applicable", 2040: "unknown_target", 2050: "multiple_targets", 2060: "ambiguous_source", 2070: "no_angr_result", 2080: "resolved_import", 2090: "unresolvable_target", 2100: "resolved_internal"}
    assert {c: r["indirect_status"] for c, r in got.items()} == want
    assert got[2030]["target"] == 3000 and got[2080]["status"] == "filtered" and got[2080]["indirect_names"] == {0xF000: "malloc"} and got[2060]["indirect_targets"] == []
    assert got[2100]["kind"] == "tail-call" and got[2100]["confidence"] == "inferred"
    total = evidence.indirect_summary(merged).first()
    assert (total["total"], total["resolved_internal"], total["resolved_import"], total["unresolved"]) == (9, 2, 1, 6)
    assert checks.violations_inference(merged).isEmpty()
    impact = evidence.edge_impact(merged, addresses(spark, [4000, 5000])).first()
    assert (impact["callsites"], impact["edges"], impact["incoming_edges"], impact["unchanged"]) == (2, 1, 1, 1)


def test_containment(spark):
    known = table(spark, [(100, "a", 50, "radare2", True), (120, "b", 5, "radare2", True), (9000, "c", 9000, "radare2", True)], FN)
    points = table(spark, [(100,), (120,), (122,), (149,), (150,), (17999,)], "target bigint")
    got = {r["target"]: r["function"] for r in evidence.containing_function(points, known).collect()}
    assert got == {100: 100, 120: 120, 122: 100, 149: 100, 150: None, 17999: 9000}
    tails = table(spark, [(100, 122, "tail-call"), (9000, 100, "tail-call"), (100, 100, "tail-call"), (100, 122, "call")], "source bigint, target bigint, kind string")
    assert sorted((r["kind"], r["target"], r["function"]) for r in evidence.direct_target(tails, known).where("function is not null").collect()) == [("call", 122, 100), ("tail-call", 100, 100)]


OPS = "source bigint, callsite bigint, length bigint, mnemonic string, text string, operand string, is_call boolean, is_jump boolean, imm_target bigint, slot bigint"


def test_classify(spark):
    known = table(spark, [(1000, "a", 64, "symbol-oracle", True), (2000, "b", 16, "radare2", True), (3000, "imp", 16, "radare2", True)], FN).withColumn("is_import", F.col("address") == 3000)
    ops = [
        (1000, 1000, 5, "call", "call 2000", "immediate", True, False, 2000, None), (1000, 1005, 5, "call", "call 3000", "immediate", True, False, 3000, None), (1000, 1010, 5, "call", "call 4000", "immediate", True, False, 4000, None),
        (1000, 1015, 6, "jmp", "jmp [slot]", "memory", False, True, None, 7000), (1000, 1021, 6, "call", "call [slot]", "memory", True, False, None, 7008), (1000, 1027, 3, "mov", "mov rax, [slot]", "memory", False, False, None, 7000),
        (1000, 1030, 2, "jmp", "jmp rax", "register", False, True, None, None), (1000, 1032, 32, "nop", "nop", "unknown", False, False, None, None), (2000, 2000, 2, "jmp", "jmp 2010", "immediate", False, True, 2010, None), (2000, 2002, 14, "ret", "ret", "unknown", False, False, None, None),
    ]
    relocations, bad = evidence.relocation_targets(table(spark, [(7000, 2000), (7008, 2001), (7016, 1), (7016, 2)], "slot bigint, target bigint"))
    got = {r["callsite"]: (r["kind"], r["status"], r["target"], r["resolver"]) for r in evidence.classify(table(spark, ops, OPS), known, relocations).collect()}
    assert got == {
        1000: ("call", "resolved", 2000, "direct-immediate"), 1005: ("call", "filtered", 3000, "direct-immediate"), 1010: ("call", "unmapped", 4000, "direct-immediate"), 1015: ("tail-call", "resolved", 2000, "elf-relocation"),
        1021: ("call", "unmapped", 2001, "elf-relocation"), 1030: ("tail-call", "unresolved", None, None),
    }
    assert [r["slot"] for r in bad.collect()] == [7016]
    assert evidence.decoding_gaps(table(spark, ops, OPS), known).isEmpty()
    assert evidence.decoding_gaps(table(spark, ops[1:], OPS).where("callsite <> 1010"), known).count() == 1


def test_sites_and_bounds(spark):
    rows = calls(spark, [(1, 2)])
    assert evidence.dedup_callsites(rows.union(rows)).count() == 1
    changed = rows.union(rows.withColumn("target", F.lit(3).cast("bigint")))
    assert evidence.callsite_conflicts(changed, evidence.SITE, ["target"]).count() == 1
    bounds, known = table(spark, [(1, 32), (5, 8)], "address bigint, size bigint"), functions(spark, [1])
    assert [r["address"] for r in evidence.missing_functions(bounds, known).collect()] == [5]
    assert {(r["address"], r["found_size"]) for r in evidence.boundary_mismatches(bounds, known).collect()} == {(1, 16), (5, 0)}
    row = diagnostics.boundary_summary(bounds, known).first()
    assert (row["extents"], row["missing"], row["mismatched"]) == (2, 1, 2)


def test_flow_resolutions(spark):
    """Ownership is counted over the raw sources of a callsite, before any kind is looked at."""
    sites = calls(spark, [(1, None, OPEN)]).select("graph_id", "kind").limit(1)
    sites = sites.crossJoin(spark.createDataFrame([(10, 100), (20, 100), (30, 300), (40, 400), (50, 500), (60, 500), (70, 700)], "source bigint, callsite bigint"))
    flow = table(spark, [(100, "Ijk_Call", 500), (300, "Ijk_Call", 7), (300, "Ijk_Boring", 8), (300, "Ijk_Call", None), (700, "Ijk_Ret", 1)], "callsite bigint, jump_kind string, target bigint")
    jumps = table(spark, [(300, "Ijk_Call", [9, 7, None]), (400, "Ijk_Call", [5]), (400, "Ijk_Boring", [6]), (500, "Ijk_Ret", []), (700, "Ijk_Call", None)], "callsite bigint, jump_kind string, targets array<bigint>")
    got = {r["source"]: (r["targets"], r["ambiguous_source"]) for r in evidence.cfg_resolutions(sites, flow, jumps).collect()}
    assert got == {10: ([], True), 20: ([], True), 30: ([7, 9], False), 40: ([5], False), 50: ([], True), 60: ([], True), 70: ([], False)}
    bare = {r["source"]: (r["targets"], r["ambiguous_source"]) for r in evidence.cfg_resolutions(sites, flow).collect()}
    assert bare[10] == ([], True) and bare[50] == ([], False) and bare[30] == ([7], False)
