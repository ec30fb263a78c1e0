"""Tables per case over result documents: truths, scores, coverage, families, graphs, indirect transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions.scalars import value_text
from weftgraph.operators.diagnostics import first_by, rank_of
from weftgraph.schemas import MODES, POLICIES, PROFILES

TRACKS = ("direct", "direct-in", "angr")
_RATES = "total:bigint,resolved_internal:bigint,resolved_import:bigint,filtered_import:bigint,unmapped:bigint,unresolved:bigint,analysis_status:string,target_resolution_rate:double,internal_resolution_rate:double,by_resolver:struct<`elf-relocation`:bigint>"
_RESULT = """struct<case:string,profile:string,mode:string,analysis:struct<track:string,anchor_policy:string>,candidate_count:bigint,target_count:bigint,grouped_candidate_count:bigint,abstained_candidate_count:bigint,
 pairwise:struct<TP:bigint,FP:bigint,FN:bigint,TN:bigint,precision:double,recall:double,F1:double,ARI:double>,
 coverage:struct<target_coverage:double,pair_decision_coverage:double,same_family_pair_coverage:double,effective_family_pair_recall:double>,
 origins:array<struct<total_target_pairs:bigint,total_pairs:bigint,recovered_pairs:bigint,abstained_instance_count:bigint,colliding_origins:array<string>>>>"""
_SUMMARY = f"""struct<ground_truth:struct<target_count:bigint,candidate_count:bigint,origin_count:bigint,generic_family_count:bigint,singleton_origin_count:bigint,same_family_pair_count:bigint,family_size:struct<median:double,max:bigint>>,
 artifact_summary:struct<fixture_node_count:bigint>,
 candidate_observability:struct<candidate_count:bigint,target_count:bigint,grouped_candidate_count:bigint,abstained_candidate_count:bigint,reachable_from_root:bigint,unreachable_from_root:bigint,fully_isolated:bigint>,
 execution:struct<duration_seconds:struct<total:double>,peak_rss_mb:double,warnings:array<struct<count:bigint>>>,
 extraction:struct<exact_static_indirect_summary:struct<all_sources:struct<{_RATES}>,candidate_sources:struct<{_RATES}>>,indirect_call_summary:struct<all_sources:struct<{_RATES}>,candidate_sources:struct<{_RATES}>>>>"""
DOCUMENT = f"results array<{_RESULT}>, run_summary {_SUMMARY}"
IDENTITY = ("profile", "track", "anchor", "mode")


def records(documents: DataFrame) -> DataFrame:
    """A row per result that has pairwise scores: case, identity, order, result ``r`` and summary ``s``. documents: (path, json)."""
    parts = documents.select("path", F.from_json("json", DOCUMENT).alias("d")).select("path", F.col("d.results").alias("results"), F.col("d.run_summary").alias("s"))
    rows = parts.select("path", F.posexplode("results").alias("place", "r"), "s").where("r.pairwise is not null")  # not out of ``d``: each row would hold all results
    named = rows.select(F.col("r.case").alias("case"), F.col("r.profile").alias("profile"), F.col("r.analysis.track").alias("track"), F.col("r.analysis.anchor_policy").alias("anchor"), F.col("r.mode").alias("mode"), "path", "place", "r", "s")
    return named.withColumn("at", F.struct(*[F.coalesce(rank_of(F.col(c), order), F.lit(99)).alias(c) for c, order in zip(IDENTITY, (PROFILES, TRACKS, POLICIES, MODES))], "path", "place"))


def _families() -> dict[str, Column]:
    """Counts of families by evidence, recovery and collision, from a result's origins."""
    count = lambda test: F.coalesce(F.size(F.filter("r.origins", lambda o: (F.coalesce(o["total_target_pairs"], o["total_pairs"], F.lit(0)) > 0) & test(F.coalesce(o["total_pairs"], F.lit(0)), F.coalesce(o["recovered_pairs"], F.lit(0)), o))), F.lit(0)).cast("bigint")
    part = lambda o: F.coalesce(o["abstained_instance_count"], F.lit(0)) > 0
    return {
        "e_full": count(lambda n, got, o: (n > 0) & ~part(o)), "e_part": count(lambda n, got, o: (n > 0) & part(o)), "e_insuff": count(lambda n, got, o: n == 0), "r_complete": count(lambda n, got, o: (n > 0) & (got == n)),
        "r_part": count(lambda n, got, o: (n > 0) & (got > 0) & (got != n)), "r_missed": count(lambda n, got, o: (n > 0) & (got == 0)), "r_na": count(lambda n, got, o: n == 0),
        "collision": count(lambda n, got, o: F.coalesce(F.size(o["colliding_origins"]), F.lit(0)) > 0),
    }


def case_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The seven tables by case; ``at`` orders their rows."""
    rows = records(documents)
    show = lambda df, **columns: df.select("case", "at", *[F.col(c) for c in IDENTITY], *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])
    target, grouped = F.coalesce("r.target_count", "r.candidate_count"), F.coalesce("r.grouped_candidate_count", "r.candidate_count")
    covered = F.when(F.col("r.coverage.target_coverage").isNotNull(), F.col("r.coverage.target_coverage")).when(F.col("r.coverage").isNull() & target.eqNullSafe(grouped), 1.0)
    truth, graphs = first_by(rows, ["case", "profile"], ["at"]), first_by(rows, ["case", "profile", "track"], ["at"])
    seen, size = "s.candidate_observability", F.col("s.ground_truth.family_size")
    old = F.col(f"{seen}.candidate_count")
    warned = F.aggregate(F.coalesce("s.execution.warnings", F.array().cast("array<struct<count:bigint>>")), F.lit(0).cast("bigint"), lambda n, w: n + F.coalesce(w["count"], F.lit(0)))
    sides = F.explode(F.array(F.struct(F.lit("all").alias("source"), F.col("s.extraction.exact_static_indirect_summary.all_sources").alias("exact"), F.col("s.extraction.indirect_call_summary.all_sources").alias("open")), F.struct(F.lit("candidate").alias("source"), F.col("s.extraction.exact_static_indirect_summary.candidate_sources").alias("exact"), F.col("s.extraction.indirect_call_summary.candidate_sources").alias("open"))))
    by_source = graphs.withColumn("x", sides)
    return {
        "truth": show(truth, target=F.coalesce("s.ground_truth.target_count", "s.ground_truth.candidate_count"), origin="s.ground_truth.origin_count", family="s.ground_truth.generic_family_count", single="s.ground_truth.singleton_origin_count", true_pairs="s.ground_truth.same_family_pair_count", fam_med=size["median"], fam_max=size["max"]),
        "scores": show(rows, tp="r.pairwise.TP", fp="r.pairwise.FP", fn="r.pairwise.FN", tn="r.pairwise.TN", prec="r.pairwise.precision", recall="r.pairwise.recall", f1="r.pairwise.F1", ari="r.pairwise.ARI"),
        "coverage": show(rows, target=target, grouped=grouped, abstain=F.coalesce("r.abstained_candidate_count", F.lit(0)), target_cov=covered, pair_cov="r.coverage.pair_decision_coverage", family_cov="r.coverage.same_family_pair_coverage", effective_recall="r.coverage.effective_family_pair_recall"),
        "families": show(rows, **_families()),
        "graphs": show(graphs, target=F.coalesce(f"{seen}.target_count", old), grouped=F.coalesce(f"{seen}.grouped_candidate_count", old), abstain=F.coalesce(f"{seen}.abstained_candidate_count", F.when(old.isNotNull(), 0)), nodes="s.artifact_summary.fixture_node_count", reach=f"{seen}.reachable_from_root", unreach=f"{seen}.unreachable_from_root", isolated=f"{seen}.fully_isolated", sec="s.execution.duration_seconds.total", rss_mb="s.execution.peak_rss_mb", warn=warned),
        "exact": show(by_source, source="x.source", total="x.exact.total", internal="x.exact.resolved_internal", filtered="x.exact.filtered_import", unmapped="x.exact.unmapped", elf_reloc=F.col("x.exact.by_resolver")["elf-relocation"]),
        "indirect": show(by_source, source="x.source", status="x.open.analysis_status", total="x.open.total", internal="x.open.resolved_internal", imported="x.open.resolved_import", unres="x.open.unresolved", target_rate="x.open.target_resolution_rate", internal_rate="x.open.internal_resolution_rate"),
    }


def as_text(table: DataFrame) -> DataFrame:
    """A table's cells as a console shows them; case and order stay."""
    kinds = dict(table.dtypes)
    return table.select("case", "at", *[value_text(F.col(c).cast("bigint") if kinds[c] == "int" else F.col(c), "bigint" if kinds[c] == "int" else kinds[c]).alias(c) for c in table.columns if c not in ("case", "at")])


def print_case(tables: dict[str, DataFrame], case: str) -> str:
    """One case's tables as text: left-aligned identity, right-aligned values."""
    out = [f"======== {case} ========"]
    for title, table in tables.items():
        rows = [r[2:] for r in as_text(table).where(F.col("case") == case).orderBy("at", *[c for c in ("source",) if c in table.columns]).toLocalIterator()]
        heads = [c.upper() for c in table.columns[2:]]
        wide = [max(len(x) for x in column) for column in zip(heads, *rows)]
        cells = lambda row: "  ".join(x.ljust(w) if i < len(IDENTITY) else x.rjust(w) for i, (x, w) in enumerate(zip(row, wide)))
        out += ["", title, "  ".join(h.ljust(w) for h, w in zip(heads, wide)), "  ".join("-" * w for w in wide), *map(cells, rows)]
    return "\n".join(out)
