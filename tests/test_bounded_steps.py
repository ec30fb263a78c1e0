"""Steps whose cost must follow the tables: what is broadcast, how long a document gets, what a row carries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weftgraph.operators import casebook, closure, evidence, refine, reports, scoring
from weftgraph.plans import queries, report_queries, source_queries
from weftgraph.session import Beside, Scratch, cut, partitions
from weftgraph.sources import binaries


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_symbols_are_not_broadcast(spark, capsys):
    links = spark.createDataFrame([("f", False, 1, 5, 1, 8, 2), ("f", True, 1, 5, 0, 0, 40)], binaries._LINKS_DDL)
    found = binaries.linked_targets(links)
    assert [tuple(r) for r in found.collect()] == [("f", 8, 42)]
    plan = _plan(found, capsys)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_documents_span_few_keys(spark, tmp_path):
    spark.createDataFrame([(0,), (1,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    span = source_queries.SPAN
    rows = spark.createDataFrame([(0, 1), (0, 2), (0, span), (7, 1)], "nation int, key bigint")
    docs = source_queries._nations(spark, str(tmp_path), items=source_queries._list(rows, "nation", F.struct("key"), "key"))
    got = sorted((r["graph_id"], r["json"]) for r in docs.collect())
    start = '{"schema_version":6,"items":['
    assert got == [("0", start + '{"key":1},{"key":2}]}'), ("0", start + '{"key":%d}]}' % span), ("1", start + "]}")]


def test_truths_span_few_keys(spark, tmp_path, monkeypatch):
    """Every customer of a known nation is a member, nameless, keyless and repeated ones included; segments are origins once a document."""
    spark.createDataFrame([(0,), (1,), (2,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    span = source_queries.SPAN
    rows = [(3, "b", 0, "X"), (2, "a", 0, "X"), (2, "a", 0, "X"), (1, None, 0, "Y"), (span, "c", 0, "X"), (-1, 'q"\\\n\u00e9', 0, ""), (5, "d", 0, None), (None, "e", 0, "X"), (6, "a", 2, "X"), (7, "f", 9, "X"), (8, "g", None, "X")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    made = []
    monkeypatch.setattr(source_queries, "_document", lambda df, schema, read=source_queries._document: (made.append(df), read(df, schema))[1])
    got = sorted(map(repr, map(tuple, source_queries.document_truths(spark, str(tmp_path)).collect())))
    assert got == sorted(repr((str(nation), segment, name)) for _, name, nation, segment in rows if nation in (0, 2))
    docs = [r["json"] for r in made[0].where("graph_id = 0").collect()]
    first = '{"schema_version":6,"origins":[{"origin":null,"members":["d"]},{"origin":"X","members":["a","a","b"]},{"origin":"Y","members":[null]}]}'
    assert len(docs) == 4 and first in docs and '{"schema_version":6,"origins":[{"origin":"X","members":["c"]}]}' in docs


def test_results_do_not_carry_their_document(spark, capsys):
    docs = spark.createDataFrame([("p", '{"results":[{"case":"a","pairwise":{"TP":1}}],"run_summary":{}}')], "path string, json string")
    rows = casebook.records(docs)
    assert rows.count() == 1
    carried = re.search(r"Generate posexplode\(.*?\), \[([^\]]*)\]", _plan(rows, capsys)).group(1)
    assert [c.split("#")[0].strip() for c in carried.split(",")] == ["path", "s"]


def test_gaps_sort_instructions_once(spark, capsys):
    ops = spark.createDataFrame([("g", 0, 0, 4), ("g", 0, 4, 4), ("g", 0, 9, 3), ("g", 64, 64, 64), ("g", 128, 128, 8), ("g", 5, 5, 1)], "graph_id string, source bigint, callsite bigint, length bigint")
    functions = spark.createDataFrame([("g", a, 64, "symbol-oracle") for a in (0, 64, 128)], "graph_id string, address bigint, size bigint, boundary_source string")
    found = evidence.decoding_gaps(ops, functions)
    assert sorted(tuple(r) for r in found.collect()) == [("g", 0, 8), ("g", 0, 12), ("g", 128, 136)]
    plan = _plan(found, capsys)
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("+- Sort [") + initial.count(":- Sort [") == 2  # the instructions', the extents'


def test_ready_edges_are_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(closure, "cut", lambda df: (written.append(set(df.columns)), cut(df))[1])
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 2), ("g", 2, 3), ("g", 4, 5)], "graph_id string, source bigint, target bigint")
    seeds = spark.createDataFrame([("g", 1), ("g", 9)], "graph_id string, node bigint")
    universe = spark.createDataFrame([("g", n) for n in range(1, 6)], "graph_id string, node bigint")
    got = closure.reachable(edges, seeds, universe, ready=True)
    assert sorted(r["node"] for r in got.collect()) == [1, 2, 3]
    assert all("source" not in columns for columns in written)


def test_rounds_shuffle_colours_not_edges(spark, capsys, monkeypatch):
    """Edges are laid out by the node that is seen, in buckets by their number; what nodes see is summed before it is shuffled."""
    nodes = spark.createDataFrame([("g", n, "user", True, None) for n in "abcd"], "graph_id string, id string, type string, scored boolean, color_class string")
    edges = spark.createDataFrame([("g", "a", "b", 1), ("g", "c", "d", 1), ("g", "d", "a", 2), ("g", "a", "a", 1), ("g", "b", "x", 1)], "graph_id string, src string, dst string, count bigint")
    with Scratch(spark) as scratch, Beside(scratch) as beside:
        layout = refine._Layout(nodes, edges, scratch, beside)
        colors = scratch.table(layout.seeds(("full",), refine.ANCHORS))
        assert layout.ends.count() == 8  # a self edge and one to a stranger have one row
        seen = layout.seen(colors.hint("shuffle_hash"))
        plan = _plan(seen, capsys)
        assert plan.count("Exchange") == 1
        assert layout.buckets == beside.buckets
        monkeypatch.setattr(refine, "BUCKET", 1)
        assert refine._Layout(nodes, edges, scratch, beside).buckets == 10


def test_anchors_share_the_edges(spark):
    nodes = spark.createDataFrame([("g", "a", "user", True, None), ("g", "b", "user", True, None), ("g", "s", "anchor", False, "ROLE:x"), ("g", "t", "anchor", False, "ROLE:x")], "graph_id string, id string, type string, scored boolean, color_class string")
    edges = spark.createDataFrame([("g", "a", "s", 1), ("g", "b", "t", 1)], "graph_id string, src string, dst string, count bigint")
    colors = refine.refine(nodes, edges, anchors=refine.ANCHORS)[0]
    got = {(r["anchors"], r["id"]): r["class_id"] for r in refine.with_class(colors, ("graph_id", "mode", "anchors")).collect()}
    assert got == {("role", "a"): "a", ("role", "b"): "a", ("role", "s"): "s", ("role", "t"): "s"} | {("address", n): n for n in "abst"}


def test_classified_partitions_follow_instructions(spark, monkeypatch):
    """More instructions, more shuffle partitions; rows without a slot or a target meet no table by it."""
    seen, joined = [], []
    monkeypatch.setattr(evidence, "TASK", 1)
    monkeypatch.setattr(evidence, "cut", lambda df: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), cut(df))[1])
    placed = evidence.direct_target
    monkeypatch.setattr(evidence, "direct_target", lambda sites, functions: (joined.extend(r["target"] for r in sites.collect()), placed(sites, functions))[1])
    ops = [("g", 0, 8 * i, 8, "call", "x", "memory", True, False, None, i % 3 or None) for i in range(7)]
    ops = spark.createDataFrame(ops, "graph_id string, source bigint, callsite bigint, length bigint, mnemonic string, text string, operand string, is_call boolean, is_jump boolean, imm_target bigint, slot bigint")
    functions = spark.createDataFrame([("g", 0, 64, False)], "graph_id string, address bigint, size bigint, is_import boolean")
    slots = spark.createDataFrame([("g", 1, 0)], "graph_id string, slot bigint, slot_target bigint")
    got = {(r["callsite"], r["status"], r["target"]) for r in evidence.classify(ops, functions, slots).collect()}
    assert got == {(8 * i, "resolved", 0) if i % 3 == 1 else (8 * i, "unresolved", None) for i in range(7)}
    assert joined == [0, 0] and set(seen) == {7} and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_packed_tables_are_not_broadcast(spark, capsys):
    """A table of numbers takes a small part of its rows' size on disk; it counts as what its rows take."""
    with Scratch(spark) as scratch:
        nodes = scratch.table(spark.range(1 << 20).select("id", F.lit(1).alias("m")))
        with partitions(spark, 9):
            assert "BroadcastHashJoin" not in _plan(nodes.join(nodes.withColumnRenamed("m", "n"), "id"), capsys)
            assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_multiset_partitions_follow_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(refine, "BUCKET", 1000)
    monkeypatch.setattr(queries, "cut", lambda df: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), cut(df))[1])
    rows = queries.neighbor_multiset_out(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and seen == [6, 6]


GRAPH_NODES = "graph_id string, id string, type string, scored boolean, color_class string"
GRAPH_EDGES = "graph_id string, src string, dst string, count bigint"


def test_modes_count_their_cells_once(spark, capsys, monkeypatch):
    """Scores of modes number no clusters, and read members once: what follows reads their counted cells."""
    kept = []
    monkeypatch.setattr(refine, "scored_clusters", None)
    monkeypatch.setattr(reports, "cut", lambda df: (kept.append(cut(df)), kept[-1])[1])
    rows = report_queries.score_modes(spark, "/root/testdata/sf0.001")
    assert len(rows.collect()) == 4
    (cells,) = kept
    assert cells.columns == ["graph_id", "mode", "cluster", "origin", "n"] and cells.count() < 1000
    assert "color" not in _plan(rows, capsys)


def test_sums_meet_the_nodes_once(spark, capsys):
    nodes = spark.createDataFrame([("g", n, "user", True, None) for n in "abcd"], GRAPH_NODES)
    edges = spark.createDataFrame([("g", "a", "b", 1), ("g", "c", "d", 1), ("g", "d", "a", 2)], GRAPH_EDGES)
    with Scratch(spark) as scratch, Beside(scratch) as beside:
        layout = refine._Layout(nodes, edges, scratch, beside)
        colors = scratch.table(layout.seeds(("in",), ("role",)))
        signed = refine._signed(colors.select("m", "node", "color"), colors, layout, 128)
        assert signed.columns == [*colors.columns, "now"]
        names = {r["node"]: r["id"] for r in layout.names.collect()}
        assert sorted(names[r["node"]] for r in signed.where("now is null").collect()) == ["c"]  # the one without a caller
        assert signed.count() == 4
        plan = _plan(signed, capsys).split("== Initial Plan ==")[-1]
        assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan)) == 2  # the edges, the nodes


def test_labels_travel_with_the_nodes(spark):
    """Labels that nodes carry count like labels that are joined afterwards: several of a member, null ones, none at all."""
    nodes = spark.createDataFrame([("g", n, "user", True, None) for n in "abcdef"] + [("g", "x", "anchor", False, "ROLE:root"), ("h", "a", "user", True, None)], GRAPH_NODES)
    edges = spark.createDataFrame([("g", n, "x", 1 + (n in "ef")) for n in "abcdef"] + [("g", "a", "b", 1)], GRAPH_EDGES)
    rows = [("g", "one", "a"), ("g", "two", "a"), ("g", "one", "b"), ("g", None, "c"), ("g", "two", "d"), ("g", "two", "d"), ("g", "one", "e"), ("g", "one", "f"), ("h", "one", "a"), ("g", "one", None)]
    truth = spark.createDataFrame(rows, "graph_id string, origin string, member string")
    colors = refine.refine(scoring.with_labels(nodes, truth), edges, ("full", "in"), carry=("labels",))[0]
    plain = refine.refine(nodes, edges, ("full", "in"))[0]
    assert plain.columns == [c for c in colors.columns if c != "labels"]
    got, want = scoring.labelled_members(colors), scoring.cluster_members(plain, truth)
    named = lambda df: sorted(map(str, df.groupBy("graph_id", "mode", "id", "origin").count().collect()))
    assert named(got) == named(want) and got.count() == 18
    counts = lambda df: sorted(map(str, scoring.pair_counts(df).collect()))
    assert counts(got) == counts(want)


def test_scores_without_names_are_the_same(spark):
    graph, truth = report_queries._geo(spark, "/root/testdata/sf0.001")
    full, bare = reports.score(graph, truth, ("full", "in")), reports.score(graph, truth, ("full", "in"), named=False)
    assert set(full) == {"metrics", "coverage", "clusters", "abstentions", "origins"} and set(bare) == {"metrics", "coverage"}
    for part in bare:
        assert sorted(map(str, bare[part].collect())) == sorted(map(str, full[part].collect())), part
