"""Stored documents to scores, report text, result documents and case tables; manifests, binaries, probes, assembly."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import assembly, audit, casebook, checks, evidence, projection, refine, reports
from weftgraph.operators.numbering import numbered
from weftgraph.schemas import ABSTAIN_REASON, ABSTENTIONS, TRANSFERS
from weftgraph.session import StepLog
from weftgraph.sources import binaries, documents, layout, manifests, sinks

BUILD = {"build_id": "b1", "source_sha256": "1" * 64, "non_stripped_sha256": "2" * 64, "stripped_sha256": "3" * 64}
ANALYSIS = {
    "track": "direct", "candidate_scope": "subject", "backend": "x", "extractor_version": "1", "raw_graph_sha256": "4" * 64, "candidate_selection_sha256": "5" * 64, "projection_config_sha256": "6" * 64,
    "anchor_policy": "address", "edge_policy": ["direct-immediate"], "oracle_level": "symbol-boundary",
}


def graph_document(version=6, **more):
    """Two members of one family that call the same anchor, one of another, and one abstention."""
    node = lambda name, kind, calls: {"id": name, "type": kind, "scored": kind == "user", "calls": [{"target": t, "count": n} for t, n in calls]}
    doc = {"case": "demo", "build": "O3S", "profile": "plain", "schema_version": version, "provenance": BUILD, "extraction": {"boundary_mode": "symbol-extent", "boundary_mismatches": []}}
    doc["nodes"] = [node("a1", "user", [("x", 1)]), node("a2", "user", [("x", 1)]), node("b1", "user", [("x", 2)]), node("x", "anchor", [])]
    if version >= 5:
        doc["analysis"] = ANALYSIS
    if version >= 6:
        doc["abstentions"] = [{"id": "b2", "status": "abstain", "reason": ABSTAIN_REASON}]
    return doc | more


def truth_document(version=6, **more):
    members = {"one": ["a1", "a2"], "two": ["b1", "b2"] if version >= 6 else ["b1"]}
    names = {m: [f"demo::{o}::h0123456789abcdef"] for o, ms in members.items() for m in ms}
    return {"case": "demo", "build": "O3S", "profile": "plain", "schema_version": 5, "provenance": BUILD, "origins": [{"origin": o, "members": ms} for o, ms in members.items()], "symbols": names} | more


def stored(folder, *docs):
    out = []
    for i, doc in enumerate(docs):
        path = folder / f"{i}.json"
        path.write_text(json.dumps(doc, indent=1))
        out.append(str(path))
    return out


def scored(spark, folder, version, **more):
    graph, truth = stored(folder, graph_document(version), truth_document(version))
    return reports.score_documents(spark, graph, truth, **more)


def test_report_of_a_stored_graph(spark, tmp_path):
    got = scored(spark, tmp_path, 6)
    assert reports.format_report(reports.report_lines(got), "demo.O3S.plain").splitlines() == [
        "case : demo / O3S / plain", "track: direct", "candidate scope: subject", "mode: full", "targets: 4", "grouped candidates: 3", "candidate pairs: 3", "rounds: 2", "predicted clusters:",
        "  C1:", "    a1 | one | origin=one", "    a2 | one | origin=one", "  C2:", "    b1 | two | origin=two", "abstentions:", f"  b2 | two | origin=two | reason={ABSTAIN_REASON}", "origins:",
        "  one: k_obs=2 scored=2 abstained=0 clusters=1 pairs=1/1 collisions=-", "  two: k_obs=2 scored=1 abstained=1 clusters=1 pairs=0/0 collisions=-",
        "TP=1 FP=0 FN=0 TN=2", "PR=1.00 RE=1.00 F1=1.00 ARI=1.00", "target coverage=0.75 pair decision coverage=0.50", "same-family pair coverage=0.50 effective family-pair recall=0.50",
    ]


def test_every_mode_and_documents_by_version(spark, tmp_path):
    got = scored(spark, tmp_path, 6, modes=("full", "in"), trace=True)
    assert {r["mode"]: (r["tp"], r["fp"]) for r in got["metrics"].collect()} == {"full": (1, 0), "in": (1, 2)}
    doc = json.loads(reports.result_documents(reports.result_rows(got), ["version"]).first()["json"])
    full = next(r for r in doc["results"] if r["mode"] == "full")
    assert doc["schema_version"] == 6 and "candidate_count" not in full and full["provenance"] == BUILD and full["analysis"] == ANALYSIS
    assert full["abstentions"] == [{"id": "b2", "status": "abstain", "reason": ABSTAIN_REASON, "symbols": ["two"], "origin": "two"}]
    assert [c["cluster"] for c in full["clusters"]] == ["C1", "C2"] and [m["id"] for m in full["clusters"][0]["members"]] == ["a1", "a2"]
    assert full["origins"][1]["scored_instance_count"] == 1 and full["trace"][0]["state"] == "seed" and full["trace"][-1]["clusters"] == [["a1", "a2"], ["b1"]]
    for version, written in ((4, 3), (5, 4)):
        folder = tmp_path / str(version)
        folder.mkdir()
        rows = reports.result_rows(scored(spark, folder, version))
        doc = json.loads(reports.result_documents(rows, ["version"]).first()["json"])
        assert doc["schema_version"] == written and doc["results"][0]["candidate_count"] == 3 and "abstentions" not in doc["results"][0] and ("analysis" in doc["results"][0]) == (version == 5)
        summary = rows.select("version").distinct().withColumn("run_summary", F.lit('{"seconds":1}'))
        doc = json.loads(reports.result_documents(rows, ["version"], summary).first()["json"])
        assert doc["schema_version"] == 5 and doc["run_summary"] == {"seconds": 1}


@pytest.mark.parametrize(("change", "message"), [({"case": "other"}, "truth"), ({"provenance": BUILD | {"build_id": "b2"}}, "another provenance"), ({"origins": [{"origin": "one", "members": ["a1"]}]}, "only graph")])
def test_strict_join(spark, tmp_path, change, message):
    graph, truth = stored(tmp_path, graph_document(), truth_document(**change))
    with pytest.raises(ValueError, match=message):
        reports.score_documents(spark, graph, truth)


def test_run_documents_and_top_keys(spark, tmp_path):
    (graph,) = stored(tmp_path, graph_document())
    colors, rounds, _ = reports.run_documents(spark, graph, ("full", "in"))
    assert colors.where("scored").count() == 6 and rounds.count() == 2
    docs = [("g", json.dumps(graph_document())), ("h", json.dumps({k: v for k, v in graph_document().items() if k != "abstentions"})), ("i", json.dumps(graph_document(note="n", extra=1))), ("j", json.dumps(graph_document() | {"schema_version": 9})), ("k", None)]
    got = {tuple(r) for r in checks.violations_top_level(spark.createDataFrame(docs, "graph_id string, json string")).collect()}
    assert got == {("h", "missing key", "abstentions"), ("i", "unexpected key", "extra"), ("j", "unsupported version", "9"), ("k", "unsupported version", None)}


def test_numbering_spans_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("n"), F.lpad((4999 - F.col("id")).cast("string"), 5, "0")).alias("name"))
    got = [(r["k"], r["name"], r["place"]) for r in numbered(rows, ["k"], ["name"], "place").collect()]
    want = [(k, name, i) for k in (0, 1) for i, name in enumerate(sorted(f"n{4999 - j:05d}" for j in range(5000) if j % 2 == k))]
    assert sorted(got) == want
    assert numbered(rows.limit(0), ["k"], ["name"], "place").count() == 0


def test_case_tables(spark):
    result = {"case": "demo", "profile": "min", "mode": "full", "analysis": {"track": "angr", "anchor_policy": "role"}, "target_count": 4, "grouped_candidate_count": 3, "abstained_candidate_count": 1, "pairwise": {"TP": 1, "FP": 0, "FN": 0, "TN": 2, "precision": 1.0, "ARI": None}, "coverage": {"target_coverage": 0.75}, "origins": [{"total_target_pairs": 1, "total_pairs": 0}]}
    old = {"case": "demo", "profile": "plain", "mode": "out", "candidate_count": 1234, "pairwise": {"TP": 1}, "origins": [{"total_pairs": 3, "recovered_pairs": 1, "colliding_origins": ["o"]}]}
    doc = {"results": [result, {"case": "no scores"}, old], "run_summary": {"ground_truth": {"candidate_count": 7, "family_size": {"median": 2.5, "max": 3}}, "execution": {"warnings": [{"count": 2}, {"count": 3}]}, "extraction": {"indirect_call_summary": {"all_sources": {"analysis_status": "completed", "total": 5}}}}}
    tables = casebook.case_tables(spark.createDataFrame([("p", json.dumps(doc))], "path string, json string"))
    text = casebook.print_case(tables, "demo")
    assert "1,234" in text and "0.7500" in text and "2.5000" in text and "completed" in text
    assert [r["profile"] for r in tables["scores"].orderBy("at").collect()] == ["plain", "min"]
    families = {r["profile"]: r for r in tables["families"].collect()}
    assert (families["plain"]["e_full"], families["plain"]["r_part"], families["plain"]["collision"], families["min"]["e_insuff"], families["min"]["r_na"]) == (1, 1, 1, 1, 1)
    assert {r["warn"] for r in tables["graphs"].collect()} == {5} and tables["indirect"].count() == 4


def elf(words, order, sections):
    """An executable's headers: the sections (name, size) after a null one, and their names."""
    names, rows = b"\0", [(0, 0, 0)]
    for name, size in sections:
        rows.append((len(names), 0, size))
        names += name + b"\0"
    rows.append((len(names), 64, 0))
    names += b".shstrtab\0"
    rows[-1] = (rows[-1][0], 64, len(names))
    end = "<" if order == 1 else ">"
    table, step = 64 + len(names), struct.calcsize(end + binaries.SECTIONS[words])
    ident = b"\x7fELF" + bytes([words, order]) + bytes(10)
    head = struct.pack(end + binaries.HEADERS[words], ident, 2, 62, 1, 0, 0, table, 0, 0, 0, 0, step, len(rows), len(rows) - 1)
    body = b"".join(struct.pack(end + binaries.SECTIONS[words], n, 1, 0, 0, o, s, 0, 0, 0, 0) for n, o, s in rows)
    return head.ljust(64, b"\0") + names + body


@pytest.mark.parametrize(("words", "order"), [(1, 1), (1, 2), (2, 1), (2, 2)])
def test_section_sizes(words, order):
    whole = elf(words, order, [(b".data", 9), (b".text", 4321)])
    assert binaries.section_size(whole) == 4321 and binaries.section_size(elf(words, order, [(b".data", 9)])) is None
    assert binaries.section_size(whole[:-70]) is None and binaries.section_size(b"") is None and binaries.section_size(b"MZ" + whole) is None


def test_binary_sizes(spark, tmp_path):
    (tmp_path / "a").write_bytes(elf(2, 1, [(b".text", 77)]))
    (tmp_path / "b").write_bytes(b"text")
    assert {r["path"][-1]: (r["length"] > 0, r["text_size"]) for r in binaries.binary_sizes(spark, str(tmp_path)).collect()} == {"a": (True, 77), "b": (True, None)}


def manifest(folder, **more):
    """A manifest of real files."""
    record = {}
    for name in ("source", "whole", "stripped"):
        path = folder / name
        path.write_text(name)
        record[name] = {"path": f"file:{path}", "sha256": hashlib.sha256(name.encode()).hexdigest()}
    made = {"case": "demo", "build": "O3KS", "profile": "min", "target": manifests.TARGET, "build_id": "b", "edition": manifests.EDITION, "crate_name": "demo", "schema_version": 3, "source": record["source"] | {"kind": "case"}}
    made["artifacts"] = {"non_stripped": record["whole"], "stripped": record["stripped"] | {"stripped_from_sha256": record["whole"]["sha256"]}}
    return made | {"compiler": {"flags": manifests.flags("min", "O3KS")}, "strip": {"flags": ["--strip-all"]}} | more


def test_manifest(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (path,) = stored(tmp_path, manifest(files))
    digests = documents.file_digests(spark, str(files))
    rows = manifests.manifests(spark, path)
    got = manifests.verified(rows, digests).first()
    assert (got["graph_id"], got["namespaces"], got["provenance"]["build_id"]) == ("demo.O3KS.min", ["demo"], "b")
    (files / "whole").write_text("changed")
    (files / "stripped").unlink()
    faults = lambda rows, *more: {r["rule"] for r in manifests.violations_manifest(rows, documents.file_digests(spark, str(files)), *more).collect()}
    assert faults(rows) == {"binary differs", "stripped binary is missing"}
    (bad,) = stored(tmp_path, manifest(files, target="t", schema_version=9, compiler={"flags": []}, crate_name=None))
    assert faults(manifests.manifests(spark, bad), spark.createDataFrame([("x",)], "graph_id string")) == {"unsupported version", "target", "compiler flags", "crate name", "no manifest"}
    assert manifests.profile_config("min").splitlines()[5:8] == ["codegen-units = 1", "lto = true", 'panic = "abort"']


def test_probe_and_labels(spark, tmp_path):
    label = lambda a, stage: {"address": a, "mapped_address": "0x400000", "name": "core::ptr::drop_in_place<alloc::string::String>", "canonical_origin": "x", "owner": "x", "evidence": stage}
    doc = {"case": "demo", "build": "O3S", "profile": "plain", "schema_version": 1, "stripped_sha256": "3" * 64, "analysis": {"input": "stripped-only"}, "matches": [label("0x2000", "direct-flirt"), label("0x4000", "direct-flirt")], "propagated_wrappers": [label("0x3000", "propagated-wrapper")], "cleanup_heuristics": []}
    (path,) = stored(tmp_path, doc)
    docs = documents.read(spark, path, documents.LABELS)
    labels, builds = documents.label_rows(docs), spark.createDataFrame([("demo.O3S.plain", "3" * 64)], "graph_id string, stripped_sha256 string")
    heads = docs.select("graph_id", "schema_version", "stripped_sha256", F.col("analysis.input").alias("input"))
    assert checks.violations_probe(heads, labels, builds).count() == 0
    assert checks.violations_probe(heads.withColumn("input", F.lit("all")), labels.unionByName(labels.limit(1)), builds).count() == 2
    known = spark.createDataFrame([("demo.O3S.plain", 0x2000), ("demo.O3S.plain", 0x3000)], "graph_id string, address bigint")
    joined = audit.join_stages(labels, known)
    assert {(r["address"], r["matched"], r["owner"], r["canonical_origin"]) for r in joined.collect()} == {(a, a != 0x4000, "core", "core::ptr::drop_in_place") for a in (0x2000, 0x3000, 0x4000)}
    assert {s: df.count() for s, df in audit.probe_stages(joined).items()} == {"direct-flirt": 2, "propagated-wrapper": 1, "cleanup-heuristic": 0}


def test_boundaries_document(spark, tmp_path):
    doc = {"case": "demo", "build": "O3S", "profile": "plain", "schema_version": 1, "provenance": BUILD, "source": "nm", "function_bounds": [{"address": "0x20", "size": 4}, {"address": "0x10", "size": 2}]}
    good, bad = stored(tmp_path, doc, doc | {"function_bounds": [{"address": "0x20", "size": 0}, {"address": "0x20", "size": 1}]})
    assert {(r["address"], r["size"]) for r in documents.boundaries(spark, good).collect()} == {(32, 4), (16, 2)}
    with pytest.raises(ValueError, match="extent repeats"):
        documents.boundaries(spark, bad)


def test_extraction(spark):
    """A root that calls a candidate through a slot and another directly, an open call, and an extent that discovery missed."""
    found = spark.createDataFrame([("g", 16, "main", 8), ("g", 32, "f", 99)], "graph_id string, address bigint, name string, size bigint")
    bounds = spark.createDataFrame([("g", 16, 16), ("g", 32, 16), ("g", 48, 16)], "graph_id string, address bigint, size bigint")
    ops = spark.createDataFrame([
        ("g", 16, 16, 4, "call", "call 0x20", "immediate", True, False, 32, None, None, False, True), ("g", 16, 20, 4, "call", "call [rip]", "memory", True, False, None, 7, None, False, True),
        ("g", 32, 32, 4, "call", "call rax", "register", True, False, None, None, None, False, True),
    ], "graph_id string, source bigint, callsite bigint, length bigint, mnemonic string, text string, operand string, is_call boolean, is_jump boolean, imm_target bigint, slot bigint, pointer bigint, is_end boolean, whole boolean")
    slots = spark.createDataFrame([("g", 7, 48)], "graph_id string, slot bigint, target bigint")
    candidates = bounds.where("address > 16").select("graph_id", "address")
    flow = spark.createDataFrame([("g", 32, "Ijk_Call", 48)], "graph_id string, callsite bigint, jump_kind string, target bigint")
    log = StepLog()
    got = assembly.extract(ops, found, bounds, candidates, slots, projection.policy("angr"), flow=flow, log=log)
    assert [s[1:3] for s in log.steps] == [("functions", 3), ("roots", 1), ("transfers", 3), ("inference", 3)]
    jumps = spark.createDataFrame([("g", 32, "Ijk_Call", [48])], "graph_id string, callsite bigint, jump_kind string, targets array<bigint>")
    by_table = assembly.extract(ops, found, bounds, candidates, slots, projection.policy("angr"), flow=flow.limit(0), jumps=jumps)
    assert by_table["edges"].exceptAll(got["edges"]).isEmpty() and by_table["edges"].count() == got["edges"].count()
    assert {(r["address"], r["name"], r["size"], r["boundary_source"], r["discovered"]) for r in got["functions"].collect()} == {(16, "main", 16, "symbol-oracle", True), (32, "f", 16, "symbol-oracle", True), (48, "symbol.bound.0x30", 16, "symbol-oracle", False)}
    assert {(r["callsite"], r["status"], r["target"], r["resolver"]) for r in got["transfers"].collect()} == {(16, "resolved", 32, "direct-immediate"), (20, "resolved", 48, "elf-relocation"), (32, "resolved", 48, "angr-cfg")}
    assert {(r["src"][-2:], r["dst"][-2:]) for r in got["edges"].collect()} == {("10", "20"), ("10", "30"), ("20", "30")}
    assert got["roots"].first()["how"] == "main" and got["mismatches"].count() == 3
    with pytest.raises(ValueError, match="candidate is no function"):
        assembly.extract(ops, found, bounds, candidates.union(spark.createDataFrame([("g", 99)], candidates.schema)), slots, projection.policy("direct"))


def test_run_status(spark):
    row = lambda status: ("g", 1, 2, None, "call", "memory", "unresolved", None, None, "unknown", None, status, [], {})
    rows = lambda *s: spark.createDataFrame([row(x) for x in s], TRANSFERS)
    status = lambda s: spark.createDataFrame([("g", s)], "graph_id string, analysis_status string")
    rules = lambda *a: [r["rule"] for r in checks.violations_run_status(*a).collect()]
    assert rules(status("completed"), rows("not_run")) == ["completed, yet open"] and rules(status("not_run"), rows("no_angr_result", "not_run")) == ["not run, yet decided"]
    assert rules(status("not_run"), rows("not_run")) == [] and rules(status("completed"), rows("no_angr_result", "not_applicable")) == []
    assert evidence.indirect_summary(rows("not_run")).first()["total"] == 1


def test_paths_and_digests(spark):
    assert layout.result_path("x/demo", "scores", "MIN") == "results/demo/min/scores.json" and layout.baseline_path() == "results/micro-corpus/plain/baseline.json"
    assert layout.baseline_path("min", True) == "results/micro-corpus/min/all_modes.json"
    for case, name in (("..", "a"), ("a", ""), ("a", "x/..")):
        with pytest.raises(ValueError, match="no name"):
            layout.result_path(case, name)
    rows = [("b", b"2"), ("a", b"1")]
    want = hashlib.sha256((1).to_bytes(8, "big") + b"a" + b"1" + (1).to_bytes(8, "big") + b"b" + b"2").hexdigest()
    assert sinks.inputs_digest(rows) == want == sinks.inputs_digest(rows[::-1])
    assert sinks.stable_text({"b": 1, "a": "é"}) == '{\n  "b": 1,\n  "a": "é"\n}\n'
    row = {"z": "é\"\\/\n", "a": 3, "n": None, "t": True}
    df = spark.createDataFrame([("k", row["z"], row["a"], None, True)], "graph_id string, z string, a int, n string, t boolean")
    assert sinks.document_digests(df).first()["digest"] == sinks.canonical_digest(row)


def test_abstention_rules(spark):
    rows = [("g", "a", "abstain", ABSTAIN_REASON), ("g", "b", "other", ABSTAIN_REASON), ("g", "c", "abstain", None), ("g", " ", "abstain", ABSTAIN_REASON)]
    nodes = spark.createDataFrame([("g", "a")], "graph_id string, id string")
    got = {(r["rule"], r["key"]) for r in checks.violations_abstentions(spark.createDataFrame(rows, ABSTENTIONS), nodes).collect()}
    assert got == {("abstained id is a node", "a"), ("abstention status", "b"), ("abstention reason", "c"), ("abstained id is blank", " ")}


def test_clusters_without_member_arrays(spark):
    colors = spark.createDataFrame([("g", "full", n, True, c) for n, c in (("b", "x"), ("a", "x"), ("c", "y"))] + [("g", "full", "0", False, "z")], "graph_id string, mode string, id string, scored boolean, color string")
    got = [(r["cluster"], r["first"], r["size"]) for r in refine.scored_clusters(colors, listed=False).orderBy("cluster").collect()]
    assert got == [(0, "a", 2), (1, "c", 1)]
