"""Stored graphs and truths to scored results: strict join, modes, named clusters, abstentions, report lines, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.functions.scalars import display_symbol, metric_text
from weftgraph.operators import checks, refine, scoring
from weftgraph.schemas import MODES
from weftgraph.session import cut
from weftgraph.sources import documents

KEYS = ("graph_id", "mode")
# Cases and builds of the frozen baseline.
BASELINE = (("family_graph_01", "O3S"), ("family_graph_02", "O3S"), ("family_graph_03", "O3S"), ("family_graph_03", "O3KS"))


def run_documents(spark: SparkSession, paths: str | list[str], modes: tuple[str, ...] = ("full",), trace: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Read graph documents, check them, refine: (colours, rounds, history)."""
    graph = documents.graphs(documents.read(spark, paths, documents.FIXTURE, "fixture"))
    checks.assert_valid(checks.violations_nodes(graph["nodes"]).unionByName(checks.violations_edges(graph["nodes"], graph["edges"])))
    return refine.refine(graph["nodes"], graph["edges"], modes, trace)


def case_of(graph: Column) -> Column:
    """The case in a graph id case.build.profile; the whole id where it has no such parts."""
    return F.regexp_replace(graph, r"\.[^.]*\.[^.]*$", "")


def _shown(symbols: DataFrame) -> DataFrame:
    """(graph_id, id, symbols) as reports show them."""
    return symbols.select("graph_id", F.col("member").alias("id"), F.transform("names", lambda n: display_symbol(n, case_of(F.col("graph_id")))).alias("symbols"))


def predicted_clusters(colors: DataFrame, truth: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row per scored member: (graph_id, mode, number, cluster, id, symbols, origin). Clusters are C1, C2, ... by first member."""
    names = refine.scored_clusters(colors, listed=False).select(*KEYS, "color", (F.col("cluster") + 1).alias("number"))
    rows = colors.where("scored").select(*KEYS, "id", "color").join(names, [*KEYS, "color"])
    rows = rows.join(truth.select("graph_id", F.col("member").alias("id"), "origin"), ["graph_id", "id"], "left").join(_shown(symbols), ["graph_id", "id"], "left")
    return rows.select(*KEYS, "number", F.concat(F.lit("C"), F.col("number").cast("string")).alias("cluster"), "id", "symbols", "origin")


def cluster_origins(members: DataFrame) -> DataFrame:
    """A row per predicted cluster: its size and its distinct origins, sorted."""
    return members.groupBy(*KEYS, "number", "cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("origin")).alias("origins"))


def scored_abstentions(abstentions: DataFrame, truth: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row per abstention: (graph_id, id, symbols, origin, reason)."""
    rows = abstentions.join(truth.select("graph_id", F.col("member").alias("id"), "origin"), ["graph_id", "id"], "left").join(_shown(symbols), ["graph_id", "id"], "left")
    return rows.select("graph_id", "id", "symbols", "origin", "reason")


def score(graph: dict[str, DataFrame], truth: dict[str, DataFrame], modes: tuple[str, ...] = ("full",), trace: bool = False, named: bool = True) -> dict[str, DataFrame]:
    """Refine graphs in the modes and score them. Ids must be the truth's exactly; otherwise an error names the first ones.

    graph: nodes, edges, abstentions; truth: truth, symbols. Gives metrics (with rounds), coverage, clusters,
    abstentions, origins and, with ``trace``, history; all by (graph_id, mode) but the abstentions. Without ``named``
    it gives metrics, coverage and history alone: clusters are numbered at once, by a sort that these don't need.
    """
    labels = truth["truth"]
    checks.assert_valid(checks.violations_universe(graph["nodes"], graph["abstentions"], labels))
    colors, rounds, history = refine.refine(scoring.with_labels(graph["nodes"], labels), graph["edges"], modes, trace, carry=("labels",))
    by_mode = lambda df: df.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    members = scoring.labelled_members(colors)
    counts = scoring.cell_counts(cut(scoring.contingency(members, KEYS)), KEYS)
    metrics = scoring.with_metrics(rounds.select(*KEYS, "rounds").join(counts, [*KEYS], "left").fillna(0, ["members", "tp", "fp", "fn", "tn"]))
    gone = by_mode(graph["abstentions"].select("graph_id", "id"))
    scored = {"metrics": metrics, "coverage": scoring.coverage(None, gone, by_mode(labels), counts, KEYS)} | ({"history": history} if trace else {})
    if not named:
        return scored
    cells, first = members.select(*KEYS, "id", "cluster", "origin"), labels.groupBy("graph_id", "origin").agg(F.min("member").alias("first"))
    return scored | {
        "clusters": predicted_clusters(colors, labels, truth["symbols"]), "abstentions": scored_abstentions(graph["abstentions"], labels, truth["symbols"]),
        "origins": scoring.origin_scores(by_mode(labels), cells, gone, KEYS, named=True).join(first, ["graph_id", "origin"]),
    }


def score_documents(spark: SparkSession, graphs: str | list[str], truths: str | list[str], modes: tuple[str, ...] = ("full",), trace: bool = False) -> dict[str, DataFrame]:
    """``score`` of stored documents, whose identities and provenance must agree; adds ``heads``, a row per graph."""
    heads, labels = documents.read(spark, graphs, documents.FIXTURE, "fixture"), documents.read(spark, truths, documents.TRUTH, "truth")
    checks.assert_valid(checks.violations_pairing(heads, labels, "truth"))
    return score(documents.graphs(heads), documents.truths(labels), modes, trace) | {"heads": heads.select("graph_id", "case", "build", "profile", "schema_version", "provenance", "analysis")}


def score_all_modes(spark: SparkSession, graphs: str | list[str], truths: str | list[str], trace: bool = False) -> dict[str, DataFrame]:
    return score_documents(spark, graphs, truths, MODES, trace)


def score_baseline(spark: SparkSession, root: str, profile: str = "plain", modes: tuple[str, ...] = ("full",), trace: bool = False) -> dict[str, DataFrame]:
    """The frozen baseline's graphs under ``root``, in one job."""
    from weftgraph.sources.layout import artifact_path, graph_path

    graphs = [f"{root}/{graph_path(c, b, profile, scope='subject')}" for c, b in BASELINE]
    return score_documents(spark, graphs, [f"{root}/{artifact_path('gt', c, b, profile, scope='subject')}" for c, b in BASELINE], modes, trace)


def _symbols_text() -> Column:
    return F.coalesce(F.array_join("symbols", " | "), F.lit(""))


def report_lines(scored: dict[str, DataFrame]) -> DataFrame:
    """The report as rows (graph_id, mode, part, number, key, line), in this order; a report of any size is a table.

    scored: ``score_documents``. Before version 6 targets, coverage and abstained counts aren't shown.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    row = lambda df, part, number, key, line: df.select(*KEYS, F.lit(part).alias("part"), F.lit(number).alias("number") if isinstance(number, int) else number.alias("number"), key.alias("key"), line.alias("line"))
    m, none, heads = scored["metrics"], F.lit(""), scored["heads"]
    new = F.col("schema_version") >= 6
    top = m.join(heads, "graph_id").join(scored["coverage"], [*KEYS], "left")
    head = F.filter(F.array(
        text("case : ", F.col("case"), " / ", F.col("build"), " / ", F.col("profile")), text("track: ", F.col("analysis.track")), text("candidate scope: ", F.col("analysis.candidate_scope")), text("mode: ", F.col("mode")),
        F.when(new, text("targets: ", F.col("targets"))), text("grouped candidates: ", F.col("members")), text("candidate pairs: ", scoring.pairs(F.col("members"))), text("rounds: ", F.col("rounds")), F.lit("predicted clusters:"),
    ), lambda line: line.isNotNull())
    lines = [top.select(*KEYS, F.lit(0).alias("part"), F.posexplode(head).alias("number", "line")).select(*KEYS, "part", "number", none.alias("key"), "line")]
    clusters = scored["clusters"]
    lines.append(row(clusters.select(*KEYS, "number", "cluster").distinct(), 1, F.col("number"), none, text("  ", F.col("cluster"), ":")))
    lines.append(row(clusters, 1, F.col("number"), F.col("id"), text("    ", F.col("id"), " | ", _symbols_text(), " | origin=", F.col("origin"))))
    gone = scored["abstentions"].join(m.select(*KEYS), "graph_id")
    lines.append(row(gone.select(*KEYS).distinct(), 2, 0, none, F.lit("abstentions:")))
    lines.append(row(gone, 2, 1, F.col("id"), text("  ", F.col("id"), " | ", _symbols_text(), " | origin=", F.col("origin"), " | reason=", F.col("reason"))))
    lines.append(row(m, 3, 0, none, F.lit("origins:")))
    origins = scored["origins"].join(heads.select("graph_id", "schema_version"), "graph_id")
    seen = F.when(new, text("scored=", F.col("scored"), " abstained=", F.col("abstained"), " ")).otherwise("")
    collisions = F.when(F.size("colliding") > 0, F.array_join("colliding", ", ")).otherwise("-")
    line = text("  ", F.col("origin"), ": k_obs=", F.col("instances"), " ", seen, "clusters=", F.col("clusters"), " pairs=", F.col("recovered_pairs"), "/", F.col("total_pairs"), " collisions=", collisions)
    lines.append(row(origins, 3, 1, text(F.col("first"), " ", F.col("origin")), line))
    lines.append(row(m, 4, 0, none, text("TP=", F.col("tp"), " FP=", F.col("fp"), " FN=", F.col("fn"), " TN=", F.col("tn"))))
    show = {c: metric_text(F.col(c)) for c in ("precision", "recall", "f1", "ari", "target_coverage", "pair_decision_coverage", "same_family_pair_coverage", "effective_family_pair_recall")}
    lines.append(row(m, 4, 1, none, text("PR=", show["precision"], " RE=", show["recall"], " F1=", show["f1"], " ARI=", show["ari"])))
    lines.append(row(top.where(new), 4, 2, none, text("target coverage=", show["target_coverage"], " pair decision coverage=", show["pair_decision_coverage"])))
    lines.append(row(top.where(new), 4, 3, none, text("same-family pair coverage=", show["same_family_pair_coverage"], " effective family-pair recall=", show["effective_family_pair_recall"])))
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more.select(out.columns))
    return out


def format_report(lines: DataFrame, graph: str, mode: str = "full") -> str:
    """One report as text, for a console."""
    rows = lines.where((F.col("graph_id") == graph) & (F.col("mode") == mode)).orderBy("part", "number", "key").select("line")
    return "\n".join(r["line"] for r in rows.toLocalIterator())


def result_rows(scored: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, mode, version, json): one result object per graph and mode, its fields by the graph's version.

    Version 6 adds coverage and abstentions and has no candidate_count; version 4 has no analysis.
    """
    named = lambda **fields: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
    listed = lambda df, by, name, order, item: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], item.alias("item")))), lambda x: x["item"]).alias(name))
    members = listed(scored["clusters"], [*KEYS, "number", "cluster"], "members", ["id"], named(id="id", symbols="symbols", origin="origin"))
    clusters = listed(members.join(cluster_origins(scored["clusters"]).drop("cluster", "size"), [*KEYS, "number"]), KEYS, "clusters", ["number"], named(cluster="cluster", origins="origins", members="members"))
    old = {"origin": "origin", "k_obs": "instances", "predicted_cluster_count": "clusters", "recovered_pairs": "recovered_pairs", "total_pairs": "total_pairs", "colliding_origins": "colliding"}
    more = {"scored_instance_count": "scored", "abstained_instance_count": "abstained", "total_target_pairs": "target_pairs", "scored_pair_coverage": "scored_pair_coverage", "effective_recall": "effective_recall"}
    item = lambda fields: listed(scored["origins"], KEYS, "origins", ["first", "origin"], named(**fields))
    gone = listed(scored["abstentions"], ["graph_id"], "abstentions", ["id"], named(id="id", status=F.lit("abstain"), reason="reason", symbols="symbols", origin="origin"))
    rows = scored["metrics"].join(scored["heads"], "graph_id").join(clusters, [*KEYS], "left").join(scored["coverage"], [*KEYS], "left").join(gone, "graph_id", "left")
    if "history" in scored:
        states = refine.trace_states(scored["history"]).select(*KEYS, "round", "state")
        groups = scored["history"].where("scored").groupBy(*KEYS, "round", "color").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        groups = groups.groupBy(*KEYS, "round").agg(F.array_sort(F.collect_list("ids")).alias("clusters")).join(states, [*KEYS, "round"])
        rows = rows.join(listed(groups, KEYS, "trace", ["round"], named(round="round", state="state", clusters="clusters")), [*KEYS], "left")
    base = {"case": "case", "build": "build", "profile": "profile", "mode": "mode", "provenance": "provenance"}
    pairwise = named(TP="tp", FP="fp", FN="fn", TN="tn", precision="precision", recall="recall", F1="f1", ARI="ari")
    tail = {"pair_count": scoring.pairs(F.col("members")), "rounds": "rounds", "pairwise": pairwise, "clusters": "clusters", "origins": "origins"} | ({"trace": "trace"} if "history" in scored else {})
    covered = named(target_pair_count="target_pairs", decision_pair_count=scoring.pairs(F.col("members")), total_same_family_pair_count="family_pairs", scored_same_family_pair_count="scored_family_pairs", target_coverage="target_coverage", pair_decision_coverage="pair_decision_coverage", same_family_pair_coverage="same_family_pair_coverage", effective_family_pair_recall="effective_family_pair_recall")
    counts = {"schema_version": F.lit(6), "grouped_candidate_count": "members", "abstained_candidate_count": "abstained", "target_count": "targets", "coverage": covered, "abstentions": F.coalesce("abstentions", F.expr("array()").cast(gone.schema["abstentions"].dataType))}
    forms = [
        (F.col("schema_version") < 5, base | {"candidate_count": "members"} | tail, old), (F.col("schema_version") == 5, base | {"candidate_count": "members"} | tail | {"analysis": "analysis"}, old),
        (F.col("schema_version") >= 6, base | tail | counts | {"analysis": "analysis"}, old | more),
    ]
    parts = [rows.where(test).join(item(fields), [*KEYS], "left").select(*KEYS, F.col("schema_version").alias("version"), F.to_json(named(**form), {"ignoreNullFields": "false"}).alias("json")) for test, form, fields in forms]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def result_documents(results: DataFrame, by: list[str], summaries: DataFrame | None = None) -> DataFrame:
    """(by, json): result documents; their version follows from the results' versions and from a run summary's presence.

    summaries: (by, run_summary) with the summary as JSON text.
    """
    rows = results.groupBy(*by).agg(F.max("version").alias("newest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("graph_id", "mode", "json"))), lambda r: r["json"]), ",").alias("list"))
    rows = rows.withColumn("run_summary", F.lit(None).cast("string")) if summaries is None else rows.join(summaries.select(*by, "run_summary"), by, "left")
    version = F.when(F.col("newest") >= 6, 6).when(F.col("run_summary").isNotNull(), 5).when(F.col("newest") >= 5, 4).otherwise(3)
    tail = F.when(F.col("run_summary").isNotNull(), F.concat(F.lit(',"run_summary":'), "run_summary")).otherwise("")
    return rows.select(*by, F.concat(F.lit('{"schema_version":'), version.cast("string"), F.lit(',"results":['), "list", F.lit("]"), tail, F.lit("}")).alias("json"))
