"""The library's queries over the bridge views, each with its DuckDB counterpart beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.functions import scalars, symbols
from weftgraph.operators import audit, checks, closure, diagnostics, evidence, projection, refine, scoring, truth
from weftgraph.plans import oracle
from weftgraph.schemas import MODES
from weftgraph.session import cut, partitions, table
from weftgraph.sources import sinks
from weftgraph.sources.bridges import view, with_views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bind(spark, sf_dir):
    return lambda *names: [view(spark, sf_dir, n) for n in names]


# Colour refinement


@query(with_views("click_nodes", "click_edges") + """
    SELECT n.id, CAST(coalesce(l.c, 0) AS BIGINT) AS self_count, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM click_nodes n
    LEFT JOIN (SELECT src, sum(count) AS c FROM click_edges WHERE src = dst GROUP BY src) l ON l.src = n.id
    LEFT JOIN (SELECT src, count(DISTINCT dst) AS c FROM click_edges WHERE src <> dst GROUP BY src) o ON o.src = n.id
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS c FROM click_edges WHERE src <> dst GROUP BY dst) i ON i.dst = n.id""")
def self_and_degree(spark, sf_dir):
    nodes, edges = _bind(spark, sf_dir)("click_nodes", "click_edges")
    return refine.relation_view(nodes, edges).select("id", "self_count", "out_degree", "in_degree")


def _seed_classes(spark, sf_dir, mode):
    nodes, edges = _bind(spark, sf_dir)("trade_nodes", "trade_edges")
    return refine.seeds(nodes, edges, (mode,)).groupBy("color").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(oracle.seed_classes("trade", "out"))
def seed_classes_out(spark, sf_dir):
    return _seed_classes(spark, sf_dir, "out")


@query(oracle.seed_classes("trade", "in"))
def seed_classes_in(spark, sf_dir):
    return _seed_classes(spark, sf_dir, "in")


def _multiset(spark, sf_dir, direction):
    """Edges are made once, and shuffle partitions follow the lines that make them."""
    with partitions(spark, -(-table(spark, sf_dir, "lineitem").count() // refine.BUCKET)):
        nodes, edges = _bind(spark, sf_dir)("trade_nodes", "trade_edges")
        edges = cut(edges)
        return cut(refine.neighbour_multiset(refine.seeds(nodes, edges, ("full",)), edges, direction).select("id", "color", "weight"))


@query(oracle.multiset("trade", "src", "dst"))
def neighbor_multiset_out(spark, sf_dir):
    return _multiset(spark, sf_dir, "out")


@query(oracle.multiset("trade", "dst", "src"))
def neighbor_multiset_in(spark, sf_dir):
    return _multiset(spark, sf_dir, "in")


def _refined(spark, sf_dir, graph, modes=("full",), trace=False):
    nodes, edges = _bind(spark, sf_dir)(f"{graph}_nodes", f"{graph}_edges")
    return refine.refine(nodes, edges, modes, trace)


def _classes(spark, sf_dir, mode):
    return refine.with_class(_refined(spark, sf_dir, "geo", (mode,))[0]).select("id", "scored", "class_id")


@query(oracle.refined("geo", "full", 6) + " SELECT id, scored, c AS class_id FROM last")
def refine_full(spark, sf_dir):
    return _classes(spark, sf_dir, "full")


@query(oracle.refined("geo", "out", 6) + " SELECT id, scored, c AS class_id FROM last")
def refine_out(spark, sf_dir):
    return _classes(spark, sf_dir, "out")


@query(oracle.refined("geo", "in", 6) + " SELECT id, scored, c AS class_id FROM last")
def refine_in(spark, sf_dir):
    return _classes(spark, sf_dir, "in")


@query(oracle.refined("geo", "out-in", 6) + " SELECT id, scored, c AS class_id FROM last")
def refine_out_in(spark, sf_dir):
    return _classes(spark, sf_dir, "out-in")


@query(oracle.refined("click", "full", 8) + " SELECT id, c AS class_id FROM last")
def refine_cyclic(spark, sf_dir):
    return refine.with_class(_refined(spark, sf_dir, "click")[0]).select("id", "class_id")


@query(oracle.rounds("geo", 6))
def refine_rounds(spark, sf_dir):
    return _refined(spark, sf_dir, "geo", MODES)[1].select("mode", F.col("rounds").cast("bigint").alias("rounds"))


@query(oracle.refined("geo", "full", 6) + " SELECT * FROM trace WHERE round <= (SELECT min(round) FROM trace WHERE state = 'fixpoint')")
def refine_trace(spark, sf_dir):
    history = _refined(spark, sf_dir, "geo", trace=True)[2]
    return refine.trace_states(history).select(F.col("round").cast("bigint").alias("round"), "classes", "scored_classes", "state")


@query(oracle.refined("geo", "full", 6) + """ SELECT CAST(row_number() OVER (ORDER BY first, size) - 1 AS BIGINT) AS cluster, first, size
    FROM (SELECT min(id) AS first, count(*) AS size FROM last WHERE scored GROUP BY c)""")
def scored_clusters(spark, sf_dir):
    return refine.scored_clusters(_refined(spark, sf_dir, "geo")[0], listed=False).select("cluster", "first", "size")


@query("SELECT * FROM (" + oracle.refined("trade", "full", 4) + " SELECT 'role' AS policy, id, c AS class_id FROM last WHERE scored) UNION ALL SELECT * FROM (" + oracle.refined("trade", "full", 4, "CAST(NULL AS STRING)") + " SELECT 'address' AS policy, id, c AS class_id FROM last WHERE scored)")
def role_vs_address_anchors(spark, sf_dir):
    nodes, edges = _bind(spark, sf_dir)("trade_nodes", "trade_edges")
    colors = refine.refine(nodes, edges, anchors=refine.ANCHORS)[0]
    return refine.with_class(colors.where("scored"), ("anchors",)).select(F.col("anchors").alias("policy"), "id", "class_id")


# Scoring


def _members(spark, sf_dir, modes=("full",)):
    (labels,) = _bind(spark, sf_dir)("geo_truth")
    return scoring.cluster_members(_refined(spark, sf_dir, "geo", modes)[0], labels)


@query(oracle.pair_counts() + " SELECT 'full' AS mode, tp, fp, fn, tn FROM pairs")
def pairwise_counts(spark, sf_dir):
    return scoring.pair_counts(_members(spark, sf_dir)).select("mode", "tp", "fp", "fn", "tn")


@query(oracle.pair_counts() + oracle.METRICS)
def pairwise_metrics(spark, sf_dir):
    return scoring.with_metrics(scoring.pair_counts(_members(spark, sf_dir))).select("precision", "recall", "f1", "ari")


def _origin_scores(spark, sf_dir, named=False):
    (labels,) = _bind(spark, sf_dir)("geo_truth")
    members = _members(spark, sf_dir).select("graph_id", "id", "cluster", "origin")
    return scoring.origin_scores(labels, members, members.select("graph_id", "id").limit(0), named=named)


@query(oracle.ORIGINS)
def origin_scores(spark, sf_dir):
    return _origin_scores(spark, sf_dir, named=True).withColumn("colliding", F.array_join("colliding", ",")).drop("graph_id", "collides")


@query(oracle.FAMILIES)
def family_status(spark, sf_dir):
    return scoring.family_status(_origin_scores(spark, sf_dir)).drop("graph_id")


# Reachability and projection


@query(with_views("click_edges", "click_nodes", recursive=True) + """, seeds AS (SELECT DISTINCT src AS node FROM click_edges WHERE src = dst),
    r AS (SELECT node FROM seeds UNION SELECT e.dst FROM r JOIN click_edges e ON e.src = r.node) SELECT node FROM r""")
def closure_multi_seed(spark, sf_dir):
    (edges,) = _bind(spark, sf_dir)("click_edges")
    seeds = edges.where("src = dst").select("graph_id", F.col("src").alias("node"))
    return closure.reachable(edges.select("graph_id", F.col("src").alias("source"), F.col("dst").alias("target")), seeds).select("node")


@query(with_views("geo_edges", recursive=True) + """, r AS (SELECT 'R0' AS node UNION SELECT e.src FROM r JOIN geo_edges e ON e.dst = r.node) SELECT node FROM r""")
def reachable_from_root(spark, sf_dir):
    (edges,) = _bind(spark, sf_dir)("geo_edges")
    root = spark.createDataFrame([("geo", "R0")], "graph_id string, node string")
    return closure.reachable(edges.select("graph_id", F.col("dst").alias("source"), F.col("src").alias("target")), root).select("node")


def _flow(spark, sf_dir):
    functions, transfers, candidates, roots = _bind(spark, sf_dir)("flow_functions", "flow_transfers", "flow_candidates", "flow_roots")
    return functions, transfers, candidates, roots


@query(with_views("flow_transfers") + """ SELECT source, target, count(*) AS count FROM flow_transfers
    WHERE (status = 'resolved' AND resolver IN ('direct-immediate', 'direct-tail', 'elf-relocation')) OR (status = 'unmapped' AND resolver = 'elf-relocation' AND confidence = 'exact') GROUP BY source, target""")
def edge_multiplicity(spark, sf_dir):
    _, transfers, _, _ = _flow(spark, sf_dir)
    return projection.resolved_edges(transfers, projection.policy("direct-in")).select("source", "target", "count")


def _projected(spark, sf_dir, track, anchors="address"):
    functions, transfers, candidates, roots = _flow(spark, sf_dir)
    return projection.project(functions, transfers, candidates, roots, projection.policy(track, anchors))


_NODE = ("id", "type", "scored", "anchor_kind", "color_class", "resolved_out_calls", "unresolved_indirect_out_callsites", "resolved_in_callers")


@query(oracle.projected(False, "address") + oracle.PROJECTED_NODES)
def project_direct(spark, sf_dir):
    return _projected(spark, sf_dir, "direct")["nodes"].select(*_NODE)


@query(oracle.projected(True, "role") + oracle.PROJECTED_NODES)
def project_direct_in(spark, sf_dir):
    return _projected(spark, sf_dir, "direct-in", "role")["nodes"].select(*_NODE)


@query(oracle.projected(True, "address") + oracle.PROJECTED_EDGES)
def project_edges(spark, sf_dir):
    return _projected(spark, sf_dir, "direct-in")["edges"].select("src", "dst", "count")


@query(oracle.projected(False, "address") + oracle.ABSTAINED)
def abstentions(spark, sf_dir):
    return _projected(spark, sf_dir, "direct")["abstentions"].select("id")


@query(oracle.FROZEN)
def project_frozen(spark, sf_dir):
    return projection.project_frozen(*_flow(spark, sf_dir))["edges"].select("src", "dst", "count")


@query(oracle.merged() + oracle.inferred_projection())
def project_inferred(spark, sf_dir):
    functions, _, candidates, roots = _flow(spark, sf_dir)
    return projection.project(functions, _merged(spark, sf_dir), candidates, roots, projection.policy("angr"))["edges"].select("src", "dst", "count")


# Evidence

_SITE_COLUMNS = ["kind", "operand_kind", "status", "target", "resolver"]


@query(with_views("flow_transfers") + """ SELECT source, callsite, count(DISTINCT concat_ws('|', kind, operand_kind, status, coalesce(CAST(target AS STRING), '-'), coalesce(resolver, '-'))) AS variants
    FROM flow_transfers GROUP BY source, callsite HAVING count(DISTINCT concat_ws('|', kind, operand_kind, status, coalesce(CAST(target AS STRING), '-'), coalesce(resolver, '-'))) > 1""")
def callsite_conflicts(spark, sf_dir):
    _, transfers, _, _ = _flow(spark, sf_dir)
    return evidence.callsite_conflicts(transfers, ["source", "callsite"], _SITE_COLUMNS)


@query(with_views("flow_transfers") + " SELECT DISTINCT source, callsite, kind, operand_kind, status, target, resolver FROM flow_transfers")
def callsite_dedup(spark, sf_dir):
    _, transfers, _, _ = _flow(spark, sf_dir)
    return evidence.dedup_callsites(transfers.select("source", "callsite", *_SITE_COLUMNS))


def _points(spark, sf_dir):
    (parts,) = _bind(spark, sf_dir)("symbols")
    extents = parts.groupBy("address").agg(F.max("size").alias("size")).select(F.lit("parts").alias("graph_id"), "address", "size")
    points = parts.select(F.lit("parts").alias("graph_id"), "p_partkey", (F.col("address") + F.col("size") - 3).alias("target"), F.col("address").alias("source"), F.when(F.col("size") > 25, "tail-call").otherwise("call").alias("kind"))
    return points, extents


_POINTS = with_views("symbols") + """, f AS (SELECT address, max(size) AS size FROM symbols GROUP BY address),
    p AS (SELECT p_partkey, address + size - 3 AS target, address AS source, CASE WHEN size > 25 THEN 'tail-call' ELSE 'call' END AS kind FROM symbols),
    u AS (SELECT DISTINCT target FROM p), w AS (SELECT u.target, coalesce(min(e.address), min(f.address)) AS fn FROM u LEFT JOIN f e ON e.address = u.target LEFT JOIN f ON f.address <= u.target AND u.target < f.address + f.size GROUP BY u.target)"""


@query(_POINTS + " SELECT p_partkey, p.target, fn AS function FROM p JOIN w USING (target)")
def containing_function(spark, sf_dir):
    return evidence.containing_function(*_points(spark, sf_dir)).select("p_partkey", "target", "function")


@query(_POINTS + " SELECT p_partkey, kind, CASE WHEN kind = 'tail-call' AND (fn <> p.target OR fn = source) THEN NULL ELSE fn END AS function FROM p JOIN w USING (target)")
def tail_exact_start(spark, sf_dir):
    return evidence.direct_target(*_points(spark, sf_dir)).select("p_partkey", "kind", "function")


def _merged(spark, sf_dir):
    functions, transfers, _, _ = _flow(spark, sf_dir)
    (found,) = _bind(spark, sf_dir)("flow_found")
    empty = F.array().cast("array<struct<address:bigint,category:string,name:string>>")
    resolutions = found.select(F.lit("flow").alias("graph_id"), "source", "callsite", F.array("target").alias("targets"), F.col("ambiguous").alias("ambiguous_source"), empty.alias("target_metadata"))
    return evidence.merge_resolutions(transfers.dropDuplicates(["graph_id", "source", "callsite", "status", "target", "operand_kind"]), resolutions, functions)


@query(oracle.merged() + " SELECT source, callsite, status, target, resolver, confidence, indirect_status, targets FROM merged")
def merge_resolutions(spark, sf_dir):
    return _merged(spark, sf_dir).select("source", "callsite", "status", "target", "resolver", "confidence", "indirect_status", F.size("indirect_targets").cast("bigint").alias("targets"))


@query(oracle.merged() + oracle.SUMMARY)
def indirect_summary(spark, sf_dir):
    return evidence.indirect_summary(_merged(spark, sf_dir)).drop("graph_id")


@query(oracle.merged() + oracle.BY_OPERAND)
def indirect_by_operand(spark, sf_dir):
    return evidence.indirect_by_operand(_merged(spark, sf_dir)).drop("graph_id")


@query(with_views("flow_transfers") + """ SELECT count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved_internal, count(*) FILTER (status = 'filtered') AS filtered_import, count(*) FILTER (status = 'unmapped') AS unmapped
    FROM flow_transfers WHERE operand_kind IN ('memory', 'register') AND resolver = 'elf-relocation'""")
def exact_static_summary(spark, sf_dir):
    _, transfers, _, _ = _flow(spark, sf_dir)
    return evidence.exact_static_summary(transfers).drop("graph_id")


@query(oracle.merged() + oracle.IMPACT)
def edge_impact(spark, sf_dir):
    _, _, candidates, _ = _flow(spark, sf_dir)
    return evidence.edge_impact(_merged(spark, sf_dir), candidates).drop("graph_id")


@query(oracle.projected(True, "address") + oracle.OBSERVED)
def observability(spark, sf_dir):
    functions, transfers, candidates, roots = _flow(spark, sf_dir)
    got = projection.project(functions, transfers, candidates, roots, projection.policy("direct-in"))
    ids = lambda df: df.select("graph_id", scalars.node_id(F.col("address")).alias("id"))
    waiting = transfers.where("status = 'unresolved' and operand_kind in ('memory', 'register')").select("graph_id", F.col("source").alias("address")).distinct()
    return diagnostics.observability(got["nodes"], got["edges"], ids(candidates), got["abstentions"], ids(roots), ids(waiting)).drop("graph_id")


@query(oracle.projected(False, "address") + oracle.COVERAGE)
def coverage_metrics(spark, sf_dir):
    got = _projected(spark, sf_dir, "direct")
    (nations,) = _bind(spark, sf_dir)("flow_candidates")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    labels = supplier.select(F.lit("flow").alias("graph_id"), F.col("s_nationkey").cast("string").alias("origin"), scalars.node_id(F.col("s_suppkey") + 1000000).alias("member"))
    colors = refine.refine(got["nodes"], got["edges"])[0]
    members = scoring.cluster_members(colors, labels)
    counts = scoring.pair_counts(members, ("graph_id",))
    return scoring.coverage(members.select("graph_id", "id"), got["abstentions"], labels, counts).select("targets", "grouped", "abstained", "target_pairs", "family_pairs", "scored_family_pairs", "target_coverage", "pair_decision_coverage")


# Symbols and truth

_SYM = with_views("symbols")
_OWNER = "regexp_extract(name, '^([A-Za-z_][A-Za-z0-9_]*)::', 1)"
_ORIGIN = "regexp_replace(name, '::<[^>]*>', '', 'g')"
_STD = "('core', 'alloc', 'std', '__rustc')"


def _symbols(spark, sf_dir):
    return view(spark, sf_dir, "symbols")


@query(_SYM + f" SELECT p_partkey, {_OWNER} AS owner FROM symbols")
def symbol_owner(spark, sf_dir):
    return _symbols(spark, sf_dir).select("p_partkey", symbols.symbol_owner(F.col("name")).alias("owner"))


@query(_SYM + f" SELECT p_partkey, CASE WHEN {_OWNER} NOT IN {_STD} THEN {_ORIGIN} END AS origin FROM symbols")
def symbol_origin(spark, sf_dir):
    return _symbols(spark, sf_dir).select("p_partkey", symbols.symbol_origin(F.col("name"), [], root_namespace="app").alias("origin"))


@query(_SYM + " SELECT p_partkey, starts_with(name, 'brand_1::') OR starts_with(name, 'brand_2::') AS inside, CASE WHEN starts_with(name, 'brand_1::') OR starts_with(name, 'brand_2::') THEN regexp_replace(name, '::<[^>]*>', '', 'g') END AS origin FROM symbols")
def subject_scope(spark, sf_dir):
    name = F.col("name")
    return _symbols(spark, sf_dir).select("p_partkey", symbols.belongs_to_subject(name, ["brand_1", "brand_2"]).alias("inside"), symbols.symbol_origin(name, ["brand_1", "brand_2"], "subject").alias("origin"))


@query(_SYM + f" SELECT p_partkey, {_OWNER} NOT IN {_STD} AS candidate, {_ORIGIN} AS catalog_origin FROM symbols")
def nonstd_scope(spark, sf_dir):
    return _symbols(spark, sf_dir).select("p_partkey", symbols.is_nonstd_candidate(F.col("name"), "app").alias("candidate"), symbols.catalog_origin(F.col("name"), "app").alias("catalog_origin"))


_PARTITION = _SYM + f""", s AS (SELECT address, name, {_ORIGIN} AS origin FROM symbols WHERE {_OWNER} NOT IN {_STD}),
    t AS (SELECT address, printf('FUN_%08x', address + 1048576) AS member, count(DISTINCT origin) AS origins, min(origin) AS first, count(DISTINCT name) AS names FROM s GROUP BY address)"""


def _truth(spark, sf_dir):
    return truth.ground_truth(_symbols(spark, sf_dir), [], root_namespace="app")


@query(_PARTITION + " SELECT member, CASE WHEN origins > 1 THEN concat('shared-address@', member) ELSE first END AS origin, names FROM t")
def truth_partition(spark, sf_dir):
    return _truth(spark, sf_dir).select("member", "origin", F.size("names").cast("bigint").alias("names"))


@query(_PARTITION + " SELECT t.member, string_agg(DISTINCT s.origin, ',' ORDER BY s.origin) AS origins FROM t JOIN s USING (address) WHERE t.origins > 1 GROUP BY t.member")
def shared_address_aliases(spark, sf_dir):
    return truth.alias_conflicts(_truth(spark, sf_dir)).select("member", F.array_join("origins", ",").alias("origins"))


@query(_SYM + f" SELECT address, min(size) AS size, min(size) <> max(size) AS conflict FROM symbols WHERE {_OWNER} NOT IN {_STD} GROUP BY address")
def function_bounds(spark, sf_dir):
    good, bad = truth.bounds(_symbols(spark, sf_dir), scope="rust-nonstd", root_namespace="app")
    sized = _symbols(spark, sf_dir).where(symbols.is_nonstd_candidate(F.col("name"), "app")).groupBy("address").agg(F.min("size").alias("size"))
    return good.withColumn("conflict", F.lit(False)).unionByName(sized.join(bad, "address", "left_semi").withColumn("conflict", F.lit(True)))


@query(_PARTITION + """, g AS (SELECT CASE WHEN origins > 1 THEN concat('shared-address@', member) ELSE first END AS origin, count(*) AS n FROM t GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS targets, count(*) AS origins, count(*) FILTER (n > 1) AS families, count(*) FILTER (n = 1) AS singletons, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS family_members,
    CAST(sum(n * (n - 1) // 2) AS BIGINT) AS family_pairs, min(n) FILTER (n > 1) AS smallest, CAST(median(n) FILTER (n > 1) AS DOUBLE) AS median, max(n) FILTER (n > 1) AS largest FROM g""")
def truth_summary(spark, sf_dir):
    rows = _truth(spark, sf_dir).select(F.lit("parts").alias("graph_id"), "origin", "member")
    return diagnostics.truth_summary(rows).drop("graph_id")


def _profiles(spark, sf_dir):
    rows = _symbols(spark, sf_dir).withColumn("origin", symbols.normalise_origin(F.col("name")))
    return rows.where("size <= 25").select("origin"), rows.where("size > 25").select("origin")


@query(_SYM + f""", a AS (SELECT DISTINCT {_ORIGIN} AS o FROM symbols WHERE size <= 25), b AS (SELECT DISTINCT {_ORIGIN} AS o FROM symbols WHERE size > 25)
    SELECT (SELECT count(*) FROM a SEMI JOIN b USING (o)) AS common, (SELECT count(*) FROM a ANTI JOIN b USING (o)) AS first_only, (SELECT count(*) FROM b ANTI JOIN a USING (o)) AS second_only""")
def profile_set_overlap(spark, sf_dir):
    return diagnostics.set_overlap(*_profiles(spark, sf_dir))


@query(_SYM + f""", a AS (SELECT {_ORIGIN} AS o FROM symbols WHERE size <= 25), b AS (SELECT {_ORIGIN} AS o FROM symbols WHERE size > 25)
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS first_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS second_only""")
def profile_multiset_overlap(spark, sf_dir):
    return diagnostics.multiset_overlap(*_profiles(spark, sf_dir))


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 99 END, event_id) AS r FROM events) WHERE r = 1""")
def first_per_key(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "event_id")
    return diagnostics.first_by(events, ["user_id"], [diagnostics.rank_of(F.col("event_type"), ("purchase", "click")), "event_id"])


# Label audit

_AUDIT = with_views("label_rows") + """, cat AS (SELECT DISTINCT printf('FUN_%08x', doc_id + 1048576) AS member, source AS origin, CASE WHEN toxic = 0 THEN 'std' ELSE 'app' END AS owner FROM labels JOIN documents USING (doc_id)),
    lab AS (SELECT printf('FUN_%08x', address + 1048576) AS member, owner, canonical_origin FROM label_rows)"""


def _labels(spark, sf_dir):
    labels = view(spark, sf_dir, "label_rows").select("address", "owner", "canonical_origin", F.lit(audit.DIRECT).alias("evidence"))
    labels = labels.unionByName(labels.where("owner = 'std'").withColumn("address", -1 - F.col("address")))  # at no known function
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    catalog = rows.select(scalars.node_id(F.col("doc_id")).alias("member"), F.col("source").alias("origin"), F.when(F.col("toxic") == 0, "std").otherwise("app").alias("owner")).distinct()
    joined = audit.join_labels(labels, rows.select(F.col("doc_id").alias("address")))
    return joined, catalog, audit.label_members(joined, catalog)


@query(with_views("label_rows") + ", l AS (SELECT address, owner FROM label_rows UNION ALL SELECT -1 - address, owner FROM label_rows WHERE owner = 'std') SELECT address, owner, address IN (SELECT doc_id FROM documents) AS matched FROM l")
def label_join(spark, sf_dir):
    return _labels(spark, sf_dir)[0].select("address", "owner", "matched")


@query(_AUDIT + """, j AS (SELECT cat.member, cat.owner = 'std' AS actual, lab.owner IS NOT NULL AND lab.owner = 'std' AS said FROM cat LEFT JOIN lab USING (member)),
    k AS (SELECT count(*) FILTER (said AND actual) AS tp, count(*) FILTER (said AND NOT actual) AS fp, count(*) FILTER (NOT said AND actual) AS fn, count(*) FILTER (NOT said AND NOT actual) AS tn FROM j)
    SELECT *, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 6) END AS recall FROM k""")
def std_confusion(spark, sf_dir):
    _, catalog, members = _labels(spark, sf_dir)
    return audit.std_confusion(members, catalog)


@query(_AUDIT + """, j AS (SELECT lab.canonical_origin = cat.origin AND lab.owner = cat.owner AS good FROM lab JOIN cat USING (member)), k AS (SELECT count(*) AS matched, count(*) FILTER (good) AS correct FROM j)
    SELECT matched, correct, matched - correct AS incorrect, CASE WHEN matched > 0 THEN round_even(correct / matched, 6) END AS precision, round_even(correct / (SELECT count(*) FROM cat), 6) AS coverage FROM k""")
def exact_identity(spark, sf_dir):
    _, catalog, members = _labels(spark, sf_dir)
    return audit.exact_identity(members, catalog)


@query(_AUDIT + """, j AS (SELECT cat.origin, coalesce(lab.owner = 'std', FALSE) AS known FROM cat LEFT JOIN lab USING (member)), k AS (SELECT origin, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS unknown FROM j GROUP BY origin)
    SELECT *, known * unknown AS cross_pairs FROM k WHERE known > 0 AND unknown > 0""")
def mixed_families(spark, sf_dir):
    _, catalog, members = _labels(spark, sf_dir)
    return audit.mixed_families(members, catalog)


# Constraints, on tables with faults put in


@query(with_views("geo_nodes") + """, n AS (SELECT id, type, scored OR id = 'N1' AS scored FROM geo_nodes UNION ALL SELECT id, type, scored FROM geo_nodes WHERE type = 'anchor')
    SELECT 'node id repeats' AS rule, id AS key FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'anchor is scored', id FROM n WHERE type = 'anchor' AND scored""")
def violations_nodes(spark, sf_dir):
    (nodes,) = _bind(spark, sf_dir)("geo_nodes")
    faulty = nodes.withColumn("scored", F.col("scored") | (F.col("id") == "N1")).unionByName(nodes.where("type = 'anchor'"))
    return checks.violations_nodes(faulty).select("rule", "key")


@query(with_views("geo_nodes", "geo_edges") + """, n AS (SELECT id FROM geo_nodes WHERE id <> 'N3') SELECT 'unknown dst' AS rule, concat_ws(' ', src, dst) AS key FROM geo_edges WHERE dst NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'unknown src', concat_ws(' ', src, dst) FROM geo_edges WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'count is positive', concat_ws(' ', src, dst) FROM geo_edges WHERE count - 1 <= 0""")
def violations_edges(spark, sf_dir):
    nodes, edges = _bind(spark, sf_dir)("geo_nodes", "geo_edges")
    return checks.violations_edges(nodes.where("id <> 'N3'"), edges.withColumn("count", F.col("count") - 1)).select("rule", "key")


@query(with_views("flow_transfers", "flow_functions") + """, b AS (SELECT t.*, f.size, f.boundary_source FROM flow_transfers t LEFT JOIN flow_functions f ON f.address = t.source), k AS (SELECT concat_ws(' ', CAST(source AS STRING), CAST(callsite AS STRING)) AS key, * FROM b)
    SELECT 'callsite is outside the extent' AS rule, key FROM k WHERE boundary_source = 'symbol-oracle' AND size > 0 AND NOT (callsite BETWEEN source AND source + size - 1)
    UNION ALL SELECT 'callsite repeats', concat_ws(' ', CAST(source AS STRING), CAST(callsite AS STRING)) FROM flow_transfers GROUP BY source, callsite HAVING count(*) > 1""")
def violations_transfers(spark, sf_dir):
    functions, transfers, _, _ = _flow(spark, sf_dir)
    return checks.violations_transfers(transfers, functions).select("rule", "key")


@query(with_views("geo_nodes", "geo_truth") + """, g AS (SELECT id FROM geo_nodes WHERE scored UNION SELECT 'Y' || id FROM geo_nodes WHERE scored UNION SELECT 'X' || member FROM geo_truth WHERE member >= 'C2'), t AS (SELECT member FROM geo_truth UNION SELECT 'X' || member FROM geo_truth)
    (SELECT id, 'only graph' AS side FROM (SELECT id FROM g EXCEPT SELECT member FROM t)) UNION ALL (SELECT member, 'only truth' FROM (SELECT member FROM t EXCEPT SELECT id FROM g))""")
def universe_diff(spark, sf_dir):
    """Whole tables, and foreign ids on either side; some of the truth's are abstained from, so they aren't missing."""
    nodes, labels = _bind(spark, sf_dir)("geo_nodes", "geo_truth")
    foreign = labels.withColumn("member", F.concat(F.lit("X"), "member"))
    graph = nodes.unionByName(nodes.withColumn("id", F.concat(F.lit("Y"), "id")))
    return checks.universe_diff(graph, foreign.where("member >= 'XC2'").select("graph_id", F.col("member").alias("id")), labels.unionByName(foreign)).select("id", "side")


# Scalars


@query("SELECT p_partkey, printf('FUN_%08x', p_partkey * 1000003 + 1048576) AS id, concat('0x', printf('%x', p_partkey * 1000003)) AS hex, p_partkey * 1000003 AS back FROM part")
def node_ids(spark, sf_dir):
    address = F.col("p_partkey") * 1000003
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.node_id(address).alias("id"), scalars.to_hex(address).alias("hex"), scalars.parse_hex(scalars.to_hex(address)).alias("back"))


@query("""SELECT p_partkey, sha256(concat('{"p_brand":"', p_brand, '","p_name":"', p_name, '","p_size":', CAST(p_size AS STRING), ',"p_type":"', p_type, '"}')) AS digest FROM part""")
def content_hash(spark, sf_dir):
    return sinks.document_digests(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


# Decoded operands and warnings

_TEXTS = ["call 0x4010", "jmp rax", "call  qword [rip + 0x20]", "ret", "call 4198400", "jmp 0x40", "ret ", "push rbx, [rsp]"]
_KINDS = [("unknown", "immediate"), ("register", "register"), ("memory", "memory"), ("unknown", "immediate"), ("register", "register"), ("unknown", "immediate"), ("unknown", "immediate"), ("memory", "memory")]


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {[k[1] for k in _KINDS]}[p_partkey % {len(_KINDS)} + 1] ELSE {[k[0] for k in _KINDS]}[p_partkey % {len(_KINDS)} + 1] END AS kind FROM part""")
def operand_kinds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("text", F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int")))
    return rows.select("p_partkey", evidence.operand_kind(F.col("text"), F.col("p_partkey") % 3 == 0).alias("kind"))


@query("SELECT p_size, concat('at 0x<addr> in ', p_brand, ' 0xZZ') AS message, count(*) AS n FROM part GROUP BY p_size, p_brand")
def warning_texts(spark, sf_dir):
    noisy = F.concat(F.lit("  at 0x"), F.lower(F.hex("p_partkey")), F.lit(" in \t "), "p_brand", F.lit(" 0xZZ\n"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("component"), noisy.alias("message"))
    return diagnostics.warning_counts(rows).select(F.col("component").alias("p_size"), "message", "n")
