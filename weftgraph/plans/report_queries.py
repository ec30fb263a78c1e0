"""Queries over scored results: clusters, abstentions, modes, families, case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import casebook, diagnostics, projection, refine, reports, scoring
from weftgraph.plans import oracle
from weftgraph.plans.queries import query
from weftgraph.plans.source_queries import SPAN
from weftgraph.schemas import ABSTAIN_REASON, MODES
from weftgraph.session import table
from weftgraph.sources.bridges import view


def _geo(spark, sf_dir):
    nodes, edges, labels = (view(spark, sf_dir, f"geo_{n}") for n in ("nodes", "edges", "truth"))
    names = labels.select("graph_id", "member", F.array(F.concat(F.lit("geo::"), "member", F.lit("::h0123456789abcdef")), F.concat(F.lit("x::"), "member")).alias("names"))
    gone = spark.createDataFrame([], "graph_id string, id string, status string, reason string")
    return {"nodes": nodes, "edges": edges, "abstentions": gone}, {"truth": labels, "symbols": names}


def _clusters(spark, sf_dir):
    graph, truth = _geo(spark, sf_dir)
    return reports.predicted_clusters(refine.refine(graph["nodes"], graph["edges"])[0], truth["truth"], truth["symbols"])


@query(oracle.MEMBERS + " SELECT dense_rank() OVER (ORDER BY c) AS number, concat('C', CAST(dense_rank() OVER (ORDER BY c) AS STRING)) AS cluster, id, concat(id, '|x::', id) AS symbols, origin FROM m")
def predicted_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("number", "cluster", "id", F.array_join("symbols", "|").alias("symbols"), "origin")


@query(oracle.MEMBERS + ", n AS (SELECT dense_rank() OVER (ORDER BY c) AS number, origin FROM m) SELECT number, count(*) AS size, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM n GROUP BY number")
def cluster_origins(spark, sf_dir):
    return reports.cluster_origins(_clusters(spark, sf_dir)).select("number", "size", F.array_join("origins", ",").alias("origins"))


_ONE = """ SELECT '{0}' AS mode, (SELECT min(round) FROM trace WHERE state = 'fixpoint') AS rounds, tp, fp, fn, tn, CAST(1 AS DOUBLE) AS target_coverage, tp / (tp + fn) AS effective_family_pair_recall FROM pairs"""


@query(" UNION ALL ".join(f"SELECT * FROM ({oracle.pair_counts(m)}{_ONE.format(m)})" for m in MODES))
def score_modes(spark, sf_dir):
    scored = reports.score(*_geo(spark, sf_dir), MODES, named=False)
    covered = scored["coverage"].select("mode", "target_coverage", "effective_family_pair_recall")
    return scored["metrics"].join(covered, "mode").select("mode", F.col("rounds").cast("bigint").alias("rounds"), "tp", "fp", "fn", "tn", "target_coverage", "effective_family_pair_recall")


def _heads(spark):
    build = F.struct(*[F.lit("0" * 64).alias(c) for c in ("build_id", "source_sha256")])
    return spark.range(1).select(F.lit("geo").alias("graph_id"), F.lit("geo").alias("case"), F.lit("O3S").alias("build"), F.lit("plain").alias("profile"), F.lit(6).alias("schema_version"), build.alias("provenance"), F.struct(F.lit("direct").alias("track"), F.lit("subject").alias("candidate_scope")).alias("analysis"))


@query(oracle.ORIGINS.replace("SELECT * FROM rows", "SELECT concat('  ', origin, ': k_obs=', CAST(instances AS STRING), ' scored=', CAST(scored AS STRING), ' abstained=0 clusters=', CAST(clusters AS STRING), ' pairs=', CAST(recovered_pairs AS STRING), '/', CAST(total_pairs AS STRING), ' collisions=', CASE WHEN colliding = '' THEN '-' ELSE replace(colliding, ',', ', ') END) AS line FROM rows"))
def report_origins(spark, sf_dir):
    scored = reports.score(*_geo(spark, sf_dir)) | {"heads": _heads(spark)}
    return reports.report_lines(scored).where("part = 3 and number = 1").select("line")


@query(oracle.pair_counts() + """ SELECT CAST(6 AS BIGINT) AS document, CAST(6 AS BIGINT) AS result, tp, fp, fn, tn, (SELECT count(DISTINCT c) FROM m) AS clusters, (SELECT count(*) FROM m) AS grouped, CAST(0 AS BIGINT) AS abstained FROM pairs""")
def result_document(spark, sf_dir):
    """The version 6 document of the graph, read back by its paths."""
    scored = reports.score(*_geo(spark, sf_dir)) | {"heads": _heads(spark)}
    got = reports.result_documents(reports.result_rows(scored), ["graph_id"])
    number = lambda *keys: F.get_json_object("json", "$" + "".join(f".{k}" if isinstance(k, str) else f"[{k}]" for k in keys)).cast("bigint")
    clusters = F.json_array_length(F.get_json_object("json", "$.results[0].clusters")).cast("bigint")
    return got.select(
        number("schema_version").alias("document"), number("results", 0, "schema_version").alias("result"), *[number("results", 0, "pairwise", c.upper()).alias(c) for c in ("tp", "fp", "fn", "tn")],
        clusters.alias("clusters"), number("results", 0, "grouped_candidate_count").alias("grouped"), number("results", 0, "abstained_candidate_count").alias("abstained"),
    )


def _flow(spark, sf_dir):
    functions, transfers, candidates, roots = (view(spark, sf_dir, f"flow_{n}") for n in ("functions", "transfers", "candidates", "roots"))
    got = projection.project(functions, transfers, candidates, roots, projection.policy("direct"))
    labels = table(spark, sf_dir, "supplier").select(F.lit("flow").alias("graph_id"), F.col("s_nationkey").cast("string").alias("origin"), scalars.node_id(F.col("s_suppkey") + 1000000).alias("member"))
    return got, labels


@query(oracle.projected(False, "address") + f" SELECT printf('FUN_%08x', a + 1048576) AS id, concat('s', CAST(s_suppkey AS STRING)) AS symbols, CAST(s_nationkey AS STRING) AS origin, '{ABSTAIN_REASON}' AS reason FROM gone JOIN supplier ON 1000000 + s_suppkey = a")
def scored_abstentions(spark, sf_dir):
    got, labels = _flow(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(F.lit("flow").alias("graph_id"), scalars.node_id(F.col("s_suppkey") + 1000000).alias("member"), F.array(F.concat(F.lit("flow::s"), F.col("s_suppkey").cast("string"))).alias("names"))
    rows = reports.scored_abstentions(got["abstentions"].withColumn("reason", F.lit(ABSTAIN_REASON)), labels, names)
    return rows.select("id", F.array_join("symbols", "|").alias("symbols"), "origin", "reason")


_EVIDENCE = oracle.projected(False, "address") + """, t AS (SELECT s_nationkey AS origin, 1000000 + s_suppkey IN (SELECT a FROM gone) AS gone FROM supplier),
    o AS (SELECT origin, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (NOT gone) AS k FROM t GROUP BY origin)"""


@query(_EVIDENCE + """ SELECT count(*) FILTER (k > 1 AND g = 0) AS evidence_full, count(*) FILTER (k > 1 AND g > 0) AS evidence_partial, count(*) FILTER (k < 2) AS evidence_insufficient, CAST(0 AS BIGINT) AS recovery_complete, CAST(0 AS BIGINT) AS recovery_partial,
    count(*) FILTER (k > 1) AS recovery_missed, count(*) FILTER (k < 2) AS recovery_na, CAST(0 AS BIGINT) AS collision FROM o WHERE n > 1 HAVING count(*) > 0""")
def family_evidence(spark, sf_dir):
    """Families where many members are abstained from; every scored node is a cluster of its own."""
    got, labels = _flow(spark, sf_dir)
    members = got["nodes"].where("scored").select("graph_id", "id", F.col("id").alias("cluster")).join(labels.withColumnRenamed("member", "id"), ["graph_id", "id"])
    return scoring.family_status(scoring.origin_scores(labels, members, got["abstentions"])).drop("graph_id")


@query(_EVIDENCE + " SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairs FROM o")
def scored_family_pairs(spark, sf_dir):
    got, labels = _flow(spark, sf_dir)
    return diagnostics.scored_family_pairs(labels, got["abstentions"]).select("pairs")


# Result documents: a nation's customers as results, a span of keys in each, so that no document grows with the tables


def _documents(spark, sf_dir):
    n = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    result = text(
        '{"case":"n', n("c_nationkey"), '","profile":"', F.when(F.col("c_custkey") % 2 == 0, "min").otherwise("plain"), '","mode":"out","analysis":{"track":"', F.lower("c_mktsegment"), '"},"candidate_count":', n("c_custkey"), ',"pairwise":{"TP":', n("c_custkey"), ',"FP":', n("c_nationkey"),
        ',"precision":null},"origins":[{"total_pairs":', (F.col("c_custkey") % 3).cast("string"), ',"recovered_pairs":', (F.col("c_custkey") % 2).cast("string"), ',"abstained_instance_count":', (F.col("c_custkey") % 5).cast("string"), ',"total_target_pairs":4,"colliding_origins":[]}]}',
    )
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.floor(F.col("c_custkey") / SPAN).alias("part"), F.struct("c_custkey", result.alias("json")).alias("r"))
    lists = rows.groupBy("c_nationkey", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]), ",").alias("list"))
    return lists.select(F.concat(F.lit("n"), n("c_nationkey"), F.lit("/"), n("part")).alias("path"), F.concat(F.lit('{"results":['), "list", F.lit('],"run_summary":{"candidate_observability":{"candidate_count":7,"reachable_from_root":3}}}')).alias("json"))


@query("""SELECT concat('n', CAST(c_nationkey AS STRING)) AS "case", CASE WHEN c_custkey % 2 = 0 THEN 'min' ELSE 'plain' END AS profile, lower(c_mktsegment) AS track, c_custkey AS tp, CAST(c_nationkey AS BIGINT) AS fp, CAST(1 AS DOUBLE) AS target_cov,
    CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 = 0 THEN 1 ELSE 0 END AS e_full, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS e_insuff, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = c_custkey % 3 THEN 1 ELSE 0 END AS r_complete FROM customer""")
def case_scores(spark, sf_dir):
    tables = casebook.case_tables(_documents(spark, sf_dir))
    rows = tables["scores"].select("case", "profile", "track", "at", "tp", "fp").join(tables["coverage"].select("case", "at", "target_cov"), ["case", "at"])
    rows = rows.join(tables["families"].select("case", "at", "e_full", "e_insuff", "r_complete"), ["case", "at"])
    return rows.select("case", "profile", "track", "tp", "fp", "target_cov", *[F.col(c).cast("int").alias(c) for c in ("e_full", "e_insuff", "r_complete")])


@query("""SELECT DISTINCT concat('n', CAST(c_nationkey AS STRING)) AS "case", CASE WHEN c_custkey % 2 = 0 THEN 'min' ELSE 'plain' END AS profile, lower(c_mktsegment) AS track, '7' AS target, '0' AS abstain, '3' AS reach, '-' AS nodes, '0' AS warn FROM customer""")
def case_graphs(spark, sf_dir):
    return casebook.as_text(casebook.case_tables(_documents(spark, sf_dir))["graphs"]).select("case", "profile", "track", "target", "abstain", "reach", "nodes", "warn")
