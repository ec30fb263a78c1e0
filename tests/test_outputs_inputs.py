"""Readers and writers beyond plain documents: relocations, digests of large documents, publishing, nested keys, run logs."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import checks, diagnostics, evidence
from weftgraph.session import StepLog
from weftgraph.sources import binaries, sinks


def elf(sections, machine=62, order=1, bits=2):
    """A small file: sections as (type, link, bytes)."""
    body, rows = b"", [struct.pack("<IIQQQQIIQQ", *[0] * 10)]
    for kind, link, data in sections:
        rows.append(struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, 64 + len(body), len(data), link, 0, 8, 0))
        body += data
    ident = b"\x7fELF" + bytes([bits, order, 1]) + bytes(9)
    head = struct.pack("<16sHHIQQQIHHHHHH", ident, 3, machine, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(rows), 0)
    return head + body + b"".join(rows)


def rela(*entries):
    return b"".join(struct.pack("<QQq", slot, symbol << 32 | kind, addend) for slot, symbol, kind, addend in entries)


def symbols(*entries):
    return b"".join(struct.pack("<IBBHQQ", 0, 0, 0, section, value, 0) for section, value in entries)


def test_relocations(spark, tmp_path):
    table = symbols((0, 0), (1, 0x1000), (0, 0x2000), (3, 0x3000), (1, 2**64 - 16))
    entries = rela((0x10, 0, 8, 0x5000), (0x18, 1, 6, 0), (0x20, 1, 7, 8), (0x28, 2, 7, 0), (0x30, 3, 1, -16), (0x38, 3, 37, 0), (0x40, 4, 1, 32), (0x10, 1, 6, 0))
    short = b"".join(struct.pack("<QQ", slot, symbol << 32 | kind) for slot, symbol, kind in [(0x50, 3, 7), (0x58, 0, 8)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_bytes(elf([(11, 0, table), (4, 1, entries), (9, 1, short), (4, 4, rela((0x60, 1, 6, 0)))]))
    (tmp_path / "in" / "two").write_bytes(elf([(2, 0, symbols((0, 0), (1, 7))), (4, 1, rela((0x10, 1, 6, 1)))]))
    (tmp_path / "in" / "none").write_bytes(elf([]))
    got = sorted((os.path.basename(r["path"]), r["slot"], r["target"]) for r in binaries.relocations(spark, str(tmp_path / "in")).collect())
    assert got == [("one", 0x10, 0x1000), ("one", 0x10, 0x5000), ("one", 0x18, 0x1000), ("one", 0x20, 0x1008), ("one", 0x30, 0x2FF0), ("one", 0x40, 16), ("one", 0x50, 0x3000), ("one", 0x58, 0), ("two", 0x10, 8)]
    links = binaries.relocations(spark, str(tmp_path / "in")).withColumnRenamed("path", "graph_id")
    good, conflicts = evidence.relocation_targets(links)
    assert good.count() == 7 and [r["slot"] for r in conflicts.collect()] == [0x10]


@pytest.mark.parametrize("content", [elf([], machine=3), elf([], order=2), elf([], bits=1), b"#!/bin/sh\n" + bytes(80), b"x"])
def test_other_machines_are_refused(spark, tmp_path, content):
    (tmp_path / "x").write_bytes(content)
    with pytest.raises(Exception, match="x86-64 files only"):
        binaries.relocations(spark, str(tmp_path)).collect()


def test_stable_digests(spark):
    """What the digest of the whole text is, for lists of no, one and many items; one batch at a time is enough."""
    docs = {f"g{i}": {"case": f"é\"{i}", "meta": {"b": [1, {}], "a": None, "c": []}, "functions": [{"name": f"n{j}\n", "size": j, "more": [j, {"x": 1.5}]} for j in range(i * 40)], "transfers": [{"z": "ß"}] * i, "last": True} for i in range(4)}
    compact = lambda v: json.dumps(v, ensure_ascii=False)
    value = lambda name: spark.createDataFrame([(g, compact(d[name])) for g, d in docs.items()], "graph_id string, json string")
    rows = lambda name: spark.createDataFrame([(g, j, compact(v)) for g, d in docs.items() for j, v in enumerate(d[name])] + [(g, None, None) for g in docs], "graph_id string, place bigint, json string").repartition(3)
    members = {"case": value("case"), "meta": value("meta"), "functions": rows("functions"), "transfers": rows("transfers"), "last": value("last")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["graph_id"]: (r["digest"], r["bytes"]) for r in sinks.stable_digests(members).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: (sinks.stable_digest(d), len(sinks.stable_text(d).encode())) for g, d in docs.items()}
    assert sinks.stable_digests({n: df.limit(0) for n, df in members.items()}).count() == 0


def test_publish(spark, tmp_path):
    """All tables or none: an attempt that dies between two of them leaves the old state, and its files are not read."""
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.published(spark, folder)
    numbers = lambda n: spark.range(n).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"))
    assert sinks.publish({"a": numbers(3), "b": numbers(5)}, folder) == 1
    broken = numbers(4).select(F.raise_error(F.lit("dies here")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="dies here"):
        sinks.publish({"a": numbers(7), "b": broken}, folder)
    now = sinks.published(spark, folder)
    assert {n: df.count() for n, df in now.items()} == {"a": 3, "b": 5} and now["a"].columns == ["id", "name"]
    assert sinks.violations_published(spark, folder).isEmpty()
    assert sinks.publish({"a": numbers(8)}, folder) == 2
    assert list(sinks.published(spark, folder)) == ["a"] and sinks.published(spark, folder, 1)["b"].count() == 5
    with pytest.raises(ValueError, match="no version"):
        sinks.published(spark, folder, 9)
    at = json.loads((tmp_path / "out" / "manifests" / "000002.json").read_text())["tables"]["a"]["path"]
    victim = next((tmp_path / "out" / at).glob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink()
    assert [(r["rule"], r["key"]) for r in sinks.violations_published(spark, folder).collect()] == [("files changed", "a")]


def test_publish_of_two_writers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    sinks.publish({"a": spark.range(1)}, folder)
    monkeypatch.setattr(sinks, "_versions", lambda *a: [])
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.publish({"a": spark.range(2)}, folder)
    monkeypatch.undo()
    assert sinks.published(spark, folder)["a"].count() == 1


GOOD = {
    "schema_version": 6, "provenance": {"build_id": "b", "source_sha256": "", "non_stripped_sha256": "", "stripped_sha256": ""},
    "analysis": dict.fromkeys(("track", "candidate_scope", "backend", "extractor_version", "raw_graph_sha256", "candidate_selection_sha256", "projection_config_sha256", "anchor_policy", "edge_policy", "oracle_level"), "x"),
    "extraction": {"boundary_mode": "radare2", "boundary_mismatches": [{"id": "a", "address": "0x1", "symbol_size": 1, "radare2_size": 2}]},
    "nodes": [{"id": "n", "type": "user", "scored": True, "anchor_kind": None, "color_class": None, "calls": [{"target": "n", "count": 1}], "observability": dict.fromkeys(("resolved_out_calls", "unresolved_indirect_out_callsites", "address_taken_references", "resolved_in_callers"))}],
    "abstentions": [{"id": "z", "status": "abstain", "reason": "r"}],
}


def changed(**paths):
    """GOOD with values replaced: a__0__b for ["a"][0]["b"]; ``...`` takes a key away."""
    doc = json.loads(json.dumps(GOOD))
    for path, value in paths.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        at = doc
        for step in way:
            at = at[step]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return doc


def test_nested_keys(spark):
    docs = {
        "good": GOOD, "seven": changed(schema_version=7, nodes=[{}]), "text": "no json", "gone": changed(nodes=..., extraction=...),
        "node": changed(nodes__0__scored=..., nodes__0__extra=1), "call": changed(nodes__0__calls=[{"target": "n", "cnt": 1}, 5, {"target": "n", "count": 1}]), "seen": changed(nodes__0__observability__more=1), "lists": changed(nodes__0__calls=None, abstentions={}),
        "analysis": changed(analysis__track=..., provenance=[1]), "mismatch": changed(extraction__boundary_mismatches=[{}, {"id": "a", "address": "", "symbol_size": 0, "radare2_size": 0}]), "old": changed(schema_version=4, analysis={}, nodes=[{"id": "n", "type": "user", "scored": True, "calls": []}]),
        "null": changed(nodes__0__observability=None, nodes=[None]),
    }
    rows = spark.createDataFrame([(g, d if isinstance(d, str) else json.dumps(d)) for g, d in docs.items()] + [("none", None)], "graph_id string, json string")
    got = {}
    for r in checks.violations_nested_keys(rows).collect():
        got.setdefault(r["graph_id"], set()).add((r["rule"], r["key"]))
    assert got == {
        "node": {("missing key", "nodes[0].scored"), ("unexpected key", "nodes[0].extra")},
        "call": {("missing key", "nodes[0].calls[0].count"), ("unexpected key", "nodes[0].calls[0].cnt"), ("not an object", "nodes[0].calls[1]")},
        "seen": {("unexpected key", "nodes[0].observability.more")},
        "lists": {("not a list", "nodes[0].calls"), ("not a list", "abstentions")},
        "analysis": {("missing key", "analysis.track"), ("not an object", "provenance")},
        "mismatch": {("missing key", f"extraction.boundary_mismatches[0].{k}") for k in ("id", "address", "symbol_size", "radare2_size")},
        "null": {("not an object", "nodes[0]")},
    }


def test_nested_keys_walk_documents_once(spark, capsys):
    """One pass: no level reads or parses the documents again."""
    checks.violations_nested_keys(spark.createDataFrame([("g", json.dumps(GOOD))], "graph_id string, json string")).explain()
    plan = capsys.readouterr().out
    assert "Union" not in plan and plan.count("Scan") == 1


def test_edge_policy(spark):
    rows = [("a", ["direct"]), ("b", []), ("c", None), ("d", ["x", "x"]), ("e", ["x", ""]), ("f", ["x", None])]
    docs = spark.createDataFrame([(g, (p,)) for g, p in rows], "graph_id string, analysis struct<edge_policy:array<string>>")
    assert {r["graph_id"] for r in checks.violations_edge_policy(docs).collect()} == set("bcdef")


def test_run_log(spark):
    """Rows are observed in the run of the step itself."""
    log, runs = StepLog(), spark.sparkContext.accumulator(0)
    counted = spark.range(50).rdd.map(lambda r: (runs.add(1), r[0])[1:]).toDF("id bigint")
    kept = log.cut("kept", counted.where("id < 40"))
    log.cut("none", kept.where("id < 0"))
    assert runs.value == 50 and [(r["step"], r["name"], r["rows"]) for r in log.table(spark).orderBy("step").collect()] == [(0, "kept", 40), (1, "none", 0)]
    row = diagnostics.execution_summary(log.table(spark)).first()
    assert row["status"] == "completed" and row["rows"] == {"kept": 40, "none": 0} and row["duration_seconds"]["kept"] > 0 and row["peak_rss_mb"] > 1 and row["versions"]["spark"] == spark.version and row["warnings"] == []
    told = spark.createDataFrame([("c", "m", 3)], "component string, message string, n bigint")
    assert diagnostics.execution_summary(log.table(spark), told).first()["status"] == "completed_with_warnings"
