"""Symbol names, truth, constraints, audits, comparisons, documents."""

import json
import random

import plain_brackets
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars, symbols
from weftgraph.operators import audit, checks, diagnostics, truth
from weftgraph.schemas import EDGES, NODES, SYMBOLS, TRUTH
from weftgraph.sources import documents, layout, sinks


@pytest.mark.parametrize(
    ("name", "owner"),
    [("core::fmt::write", "core"), ("<app::Thing as core::fmt::Debug>::fmt", "app"), ("<&T as core::fmt::Debug>::fmt", "core"), ("main", None), ("<unclosed::x", None), ("<alloc::vec::Vec<T> as billing::Local>::m", "billing"), (None, None)],
)
def test_owner(spark, name, owner):
    assert plain_brackets.owner_of(name) == owner
    assert spark.createDataFrame([(name,)], "n string").select(symbols.symbol_owner(F.col("n"))).first()[0] == owner


@pytest.mark.parametrize(
    ("name", "origin"),
    [
        ("a::process::<i32>", "a::process"), ("a::f::h0123456789abcdef", "a::f"), ("a::_::<impl serde::Deserialize for a::X>::deserialize", "a::_::impl_for=a::X::deserialize"), ("a::<impl Foo>::g", "a::impl=Foo::g"),
        ("a::f::<Vec<u8>, B<C>>::g::<D>", "a::f::g"), ("a::f::<open", "a::f"), ("<alloc::vec::Vec<T> as b::L>::m", "<alloc::vec::Vec<T> as b::L>::m"),
    ],
)
def test_origin(spark, name, origin):
    assert plain_brackets.origin_of(name) == origin
    assert spark.createDataFrame([(name,)], "n string").select(symbols.normalise_origin(F.col("n"))).first()[0] == origin


@pytest.mark.parametrize(
    ("name", "origin"),
    [("core::ptr::drop_in_place<T>", "core::ptr::drop_in_place"), ("<alloc::vec::Vec<T> as b::L>::m", "<alloc::vec::Vec as b::L>::m"), ("a::f<B<C>>::g", "a::f::g"), ("a::f<open", "a::f<open"), ("x::<A as B>", "x"), ("<<A<T> as B<U>>::C as D<E<F>>>::m::<G>", "<<A as B>::C as D>::m"), ("a<b<c>", "a<b"), ("f(<A as B<C>>::d, e<g>)", "f(<A as B>::d, e)"), ("a>b<c>d", "a>bd"), ("<&T<u8> as X>::y<Z<W>>::h0123456789abcdef", "<&T as X>::y")],
)
def test_catalog_origin(spark, name, origin):
    assert plain_brackets.catalog_origin_of(name) == origin
    assert spark.createDataFrame([(name,)], "n string").select(symbols.normalise_catalog_origin(F.col("n"))).first()[0] == origin


def test_brackets_of_random_names(spark):
    """Folds over tokens against plain Python, on names with unclosed, nested and stray brackets; no Python in the plan."""
    rng = random.Random(7)
    pieces = ["<", "<", ">", ">", "::<", "::", " as ", " ", "impl ", " for ", "core", "app", "é", "std::", "x", "::h0123456789abcdef", "::::", "&", "\t", "𝒳"]
    names = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16))) for _ in range(1500)] + ["", None]
    functions = {"owner": symbols.symbol_owner, "origin": symbols.normalise_origin, "catalog": symbols.normalise_catalog_origin, "probe": symbols.probe_origin}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[f(F.col("n")).alias(k) for k, f in functions.items()])
    assert "Python" not in spark.range(1).select(*[f(F.col("id").cast("string")).alias(k) for k, f in functions.items()])._jdf.queryExecution().toString()
    plain = {"owner": plain_brackets.owner_of, "origin": plain_brackets.origin_of, "catalog": plain_brackets.catalog_origin_of, "probe": plain_brackets.outside_brackets}
    for r in df.collect():
        if r["n"] is not None:
            assert {k: r[k] for k in plain} == {k: f(r["n"]) for k, f in plain.items()}, r["n"]


def syms(spark, rows):
    return spark.createDataFrame([(a, s, "t", n) for a, s, n in rows], SYMBOLS)


def test_truth_scopes(spark):
    rows = syms(spark, [(0x10, 4, "fam::beta::<i32>"), (0x20, 4, "fam::beta"), (0x20, 4, "fam::beta::<u8>"), (0x30, 4, "fam::main"), (0x40, 4, "core::x"), (0x50, 4, "dep::a"), (0x50, 4, "dep::b")])
    subject = truth.ground_truth(rows, ["fam"], "subject", bias=0)
    assert {(r["member"], r["origin"], len(r["names"])) for r in subject.collect()} == {("FUN_00000010", "beta", 1), ("FUN_00000020", "beta", 2)}
    wide = truth.ground_truth(rows, ["fam"], "rust-nonstd", "fam", bias=0)
    assert {r["origin"] for r in wide.collect()} == {"fam::beta", "shared-address@FUN_00000050"}
    assert truth.alias_conflicts(wide).first()["origins"] == ["dep::a", "dep::b"]
    groups = truth.origins(wide).orderBy("first").collect()
    assert groups[0]["members"] == ["FUN_00000010", "FUN_00000020"] and truth.origin_by_member(truth.origins(wide)).count() == 3
    catalog = {r["member"]: r["owner"] for r in truth.catalog(rows, "fam", bias=0).collect()}
    assert catalog == {"FUN_00000010": "fam", "FUN_00000020": "fam", "FUN_00000040": "core", "FUN_00000050": "shared-address"}
    assert truth.candidate_addresses(rows, ["fam"], "rust-nonstd", "fam").count() == 3


def test_bounds(spark):
    rows = syms(spark, [(1, 4, "a::f"), (1, 8, "a::g"), (2, 0, "a::h"), (3, 5, "a::i"), (4, 9, "main")])
    good, bad = truth.bounds(rows, root_namespace="a")
    assert [tuple(r) for r in good.collect()] == [(3, 5)] and {r["address"] for r in bad.collect()} == {1, 2}
    assert {r["address"] for r in truth.bounds(rows, every=True)[0].collect()} == {3, 4}
    with pytest.raises(ValueError):
        symbols.symbol_origin(F.lit("a"), [])


def test_node_checks(spark):
    node = lambda i, t, s, k=None, c=None, n=0: ("g", i, t, s, k, c, n, 0, None, 0)
    good = spark.createDataFrame([node("a", "user", True), node("b", "anchor", False, "root", "ADDR:b")], NODES)
    assert checks.violations_nodes(good).isEmpty() and checks.violations_metadata(good).isEmpty()
    bad = spark.createDataFrame([node("a", "user", True, "root"), node("a", "anchor", True, "odd", "x"), node(" ", "thing", False, n=-1)], NODES)
    rules = {r["rule"] for r in checks.violations_nodes(bad).union(checks.violations_metadata(bad)).collect()}
    assert rules == {"node id repeats", "node id is blank", "type is user or anchor", "anchor is scored", "anchor fields", "counters"}
    assert checks.violations_nodes(good.where("type = 'anchor'"), 5).first()["rule"] == "nothing is scored"
    edges = spark.createDataFrame([("g", "a", "b", 1), ("g", "a", "b", 0), ("g", "a", "z", 1)], EDGES)
    assert {r["rule"] for r in checks.violations_edges(good, edges).collect()} == {"edge repeats", "count is positive", "unknown dst"}
    with pytest.raises(ValueError, match="unknown dst"):
        checks.assert_valid(checks.violations_edges(good, edges).where("rule = 'unknown dst'"))
    checks.assert_valid(checks.violations_edges(good, edges.limit(0)))


def test_universe_and_keys(spark):
    nodes = spark.createDataFrame([("g", "a", True), ("g", "b", True)], "graph_id string, id string, scored boolean")
    gone, members = spark.createDataFrame([("g", "c")], "graph_id string, id string"), spark.createDataFrame([("g", "o", "a"), ("g", "o", "c"), ("g", "o", "d")], TRUTH)
    assert {(r["id"], r["side"]) for r in checks.universe_diff(nodes, gone, members).collect()} == {("b", "only graph"), ("d", "only truth")}
    docs = spark.createDataFrame([("g", '{"case":1,"odd":2}')], "graph_id string, json string")
    assert {(r["rule"], r["key"]) for r in checks.violations_keys(docs, ["case", "build"], ["case", "build"]).collect()} == {("missing key", "build"), ("unexpected key", "odd")}


def test_audit(spark):
    catalog = spark.createDataFrame([("FUN_00000001", "core::a", "core"), ("FUN_00000002", "app::b", "app"), ("FUN_00000003", "core::c", "core"), ("FUN_00000004", "app::d", "app"), ("FUN_00000005", "core::c", "core")], "member string, origin string, owner string")
    rows = [(1, "n", "core::a", "core", "direct-flirt"), (2, "n", "core::b", "core", "direct-flirt"), (3, "n", "core::c", "core", "direct-flirt"), (9, "n", "x", "core", "direct-flirt"), (4, "n", "x", "app", "propagated")]
    labels = audit.join_labels(spark.createDataFrame(rows, "address bigint, name string, canonical_origin string, owner string, evidence string"), spark.createDataFrame([(i,) for i in range(1, 6)], "address bigint"))
    members = audit.label_members(labels, catalog, bias=0)
    assert tuple(audit.std_confusion(members, catalog).first()) == (2, 1, 1, 1, 0.666667, 0.666667)
    assert tuple(audit.exact_identity(members, catalog).first()) == (3, 2, 1, 0.666667, 0.4)
    assert [tuple(r) for r in audit.mixed_families(members, catalog).collect()] == [("core::c", 1, 1, 1)]
    assert labels.where("not matched").count() == 1 and audit.probe_from_labels(labels).count() == 5
    stages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "address bigint, evidence string")
    assert {tuple(r) for r in audit.stage_labels(stages, ("a", "b")).collect()} == {(1, "a"), (2, "b")}


def test_comparisons(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "o string") for xs in ("aab", "abbc"))
    assert tuple(diagnostics.set_overlap(a, b).first()) == (2, 0, 1)
    assert tuple(diagnostics.multiset_overlap(a, b).first()) == (2, 1, 2)
    rows = spark.createDataFrame([("g", "o1", "a"), ("g", "o1", "b"), ("g", "o2", "c")], TRUTH)
    got = diagnostics.truth_summary(rows).first()
    assert (got["targets"], got["families"], got["singletons"], got["family_pairs"], got["median"]) == (3, 1, 1, 1, 2.0)
    gone = spark.createDataFrame([("g", "a")], "graph_id string, id string")
    assert diagnostics.scored_family_pairs(rows, gone).first()["pairs"] == 0
    warnings = spark.createDataFrame([("x", "bad  at 0x10"), ("x", "bad at 0x2f")], "component string, message string")
    assert diagnostics.warning_counts(warnings).first()["n"] == 2


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.node_id(F.lit(0x1234567890)).alias("id"), scalars.parse_hex(F.lit("0x7fffffffffffffff")).alias("big"), scalars.parse_hex(F.lit("0xffffffffffffffff")).alias("over"), scalars.parse_hex(F.lit("12")).alias("no"),
        scalars.ratio(F.lit(1), F.lit(128)).alias("r"), scalars.ratio(F.lit(1), F.lit(0)).alias("z"), scalars.display_symbol(F.lit("c::f::h0123456789abcdef"), F.lit("c")).alias("d"), scalars.metric_text(F.lit(None).cast("double")).alias("na"),
    ).first()
    assert row["id"] == "FUN_1234667890" and row["big"] == 2**63 - 1 and row["over"] is None and row["no"] is None
    assert row["r"] == 0.007812 and row["z"] is None and row["d"] == "f" and row["na"] == "N/A"


def test_documents(spark, tmp_path):
    doc = {"case": "c", "build": "O3S", "profile": "plain", "schema_version": 6, "nodes": [{"id": "a", "type": "user", "scored": True, "calls": [{"target": "a", "count": 2}]}], "abstentions": [{"id": "z", "status": "abstain", "reason": "r"}]}
    (tmp_path / "good.json").write_text(json.dumps(doc))
    got = documents.graphs(documents.read(spark, str(tmp_path / "good.json"), documents.FIXTURE, "fixture"))
    assert got["edges"].first()["count"] == 2 and got["abstentions"].first()["id"] == "z" and got["nodes"].first()["graph_id"] == "c.O3S.plain"
    (tmp_path / "old.json").write_text(json.dumps(doc | {"schema_version": 1}))
    with pytest.raises(ValueError, match="version"):
        documents.read(spark, str(tmp_path / "old.json"), documents.FIXTURE, "fixture")
    raw = {"case": "c", "build": "b", "profile": "p", "schema_version": 5, "root": "0x10", "functions": [{"address": "0x10", "name": "f", "size": 4, "boundary_source": "radare2", "discovered_by_radare2": True}], "transfers": [{"source": "0x10", "callsite": "0x12", "angr_targets": ["0x20"], "angr_target_names": {"0x20": "m"}}]}
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    got = documents.evidence(documents.read(spark, str(tmp_path / "raw.json"), documents.RAW, "raw"))
    assert got["transfers"].first()["indirect_names"] == {32: "m"} and got["roots"].first()["address"] == 16
    assert documents.file_digests(spark, str(tmp_path)).count() == 3


def test_listing(spark):
    lines = ["0000000000001000 0000000000000010 T a::f(x) y", "0000000000002000 t b::g", "zz 10 t bad", "0000000000003000 0000000000000010 d data", ""]
    got = documents.parse_listing(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r["address"], r["size"], r["name"]) for r in got.collect()} == {(4096, 16, "a::f(x) y"), (8192, 0, "b::g")}


def test_layout_and_sinks(spark, tmp_path):
    assert layout.split_case_build("x/fam.o3s.fixture.json") == ("fam", "O3S") and layout.split_case_build("fam.json") == ("fam", "O3S") and layout.split_case_build("a.b") == ("a.b", "O3S")
    assert layout.graph_path("c", "O3S") == "fixtures/rust-nonstd/plain/c.O3S.fixture.json"
    assert layout.graph_path("c", "O3S", "min", "direct-in", "subject", "role") == "fixtures/direct-in/role/min/c.O3S.fixture.json"
    with pytest.raises(ValueError):
        layout.normalise("profile", "odd")
    assert sinks.canonical_digest({"b": 1, "a": "é"}) == sinks.canonical_digest({"a": "é", "b": 1}) != sinks.canonical_digest({"a": "é", "b": 1}, escape=True)
    rows = spark.createDataFrame([("g", 1)], "graph_id string, n int")
    sinks.write_rows(rows, str(tmp_path / "out"), by=["graph_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert json.loads(sinks.as_documents(rows).first()["json"]) == {"n": 1}
