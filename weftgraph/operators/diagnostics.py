"""Diagnostics and comparisons over evidence, graphs and truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from weftgraph.operators.closure import reachable
from weftgraph.operators.scoring import pairs


def observability(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, abstained: DataFrame, roots: DataFrame, open_sources: DataFrame) -> DataFrame:
    """Candidates by reachability from the root, missing sides and open callsites; all tables by (graph_id, id).

    An abstained candidate lacks both sides; a call to itself counts as a side here.
    """
    ids = nodes.select("graph_id", F.col("id").alias("node"))
    reached = reachable(edges.select("graph_id", F.col("src").alias("source"), F.col("dst").alias("target")), roots.withColumnRenamed("id", "node"), ids).withColumnRenamed("node", "id")
    rows = candidates.select("graph_id", "id").distinct()
    calls, called = edges.select("graph_id", F.col("src").alias("id")), edges.select("graph_id", F.col("dst").alias("id"))
    for df, name in ((abstained, "gone"), (reached, "reached"), (calls, "calls"), (called, "called"), (open_sources, "open")):
        rows = rows.join(df.select("graph_id", "id").distinct().withColumn(name, F.lit(True)), ["graph_id", "id"], "left")
    rows = rows.fillna(False, ["gone", "reached", "calls", "called", "open"])
    no_out, no_in = F.col("gone") | ~F.col("calls"), F.col("gone") | ~F.col("called")
    return rows.groupBy("graph_id").agg(
        F.count("*").alias("targets"), F.count_if(~F.col("gone")).alias("grouped"), F.count_if("gone").alias("abstained"), F.count_if("reached").alias("reachable"), F.count_if(~F.col("reached")).alias("unreachable"),
        F.count_if(no_out).alias("zero_outgoing"), F.count_if(no_in).alias("zero_incoming"), F.count_if(no_out & no_in).alias("isolated"), F.count_if("open").alias("with_open_callsites"),
    )


def truth_summary(truth: DataFrame, key: str = "graph_id") -> DataFrame:
    """Sizes of a partition (graph_id, origin, member): families are origins of two members or more."""
    sizes = truth.groupBy(key, "origin").agg(F.count("*").alias("n"))
    family = F.when(F.col("n") >= 2, F.col("n"))
    return sizes.groupBy(key).agg(
        F.sum("n").alias("targets"), F.count("*").alias("origins"), F.count(family).alias("families"), F.count_if(F.col("n") == 1).alias("singletons"), F.coalesce(F.sum(family), F.lit(0)).alias("family_members"),
        F.sum(pairs(F.col("n"))).alias("family_pairs"), F.min(family).alias("smallest"), F.median(family).alias("median"), F.max(family).alias("largest"),
    )


def scored_family_pairs(truth: DataFrame, abstained: DataFrame) -> DataFrame:
    """Same-origin pairs without abstained members."""
    left = truth.join(abstained.select("graph_id", F.col("id").alias("member")), ["graph_id", "member"], "left_anti")
    return left.groupBy("graph_id", "origin").agg(F.count("*").alias("n")).groupBy("graph_id").agg(F.sum(pairs(F.col("n"))).alias("pairs"))


def set_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct rows in both, only the first, only the second; equal schemas."""
    rows = first.distinct().withColumn("a__", F.lit(1)).unionByName(second.distinct().withColumn("a__", F.lit(2)))
    sides = rows.groupBy(*first.columns).agg(F.sum("a__").alias("side"))
    return sides.agg(F.count_if(F.col("side") == 3).alias("common"), F.count_if(F.col("side") == 1).alias("first_only"), F.count_if(F.col("side") == 2).alias("second_only"))


def multiset_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """As ``set_overlap``, with repeats counted."""
    rows = first.withColumn("a__", F.lit(1)).withColumn("b__", F.lit(0)).unionByName(second.withColumn("a__", F.lit(0)).withColumn("b__", F.lit(1)))
    sums = rows.groupBy(*first.columns).agg(F.sum("a__").alias("a"), F.sum("b__").alias("b"))
    zero = F.lit(0).cast("bigint")
    return sums.agg(*[F.coalesce(F.sum(x), zero).alias(n) for x, n in ((F.least("a", "b"), "common"), (F.greatest(F.col("a") - F.col("b"), zero), "first_only"), (F.greatest(F.col("b") - F.col("a"), zero), "second_only"))])


def boundary_summary(bounds: DataFrame, functions: DataFrame) -> DataFrame:
    """Extents of a selection against discovery: found, missing, of another size."""
    found = functions.where("discovered").select("graph_id", "address", F.col("size").alias("found_size"))
    rows = bounds.join(found, ["graph_id", "address"], "left")
    missing = F.col("found_size").isNull()
    return rows.groupBy("graph_id").agg(F.count("*").alias("extents"), F.count_if(~missing).alias("found"), F.count_if(missing).alias("missing"), F.count_if(F.coalesce(F.col("found_size"), F.lit(0)) != F.col("size")).alias("mismatched"))


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a closed order; 99 for anything else."""
    out = F.lit(99)
    for i, name in enumerate(order):
        out = F.when(value == name, i).otherwise(out)
    return out


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank__ = 1").drop("rank__")


def run_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per graph with a struct per part; each part has one row per graph."""
    out = None
    for name, df in parts.items():
        packed = df.select("graph_id", F.struct(*[c for c in df.columns if c != "graph_id"]).alias(name))
        out = packed if out is None else out.join(packed, "graph_id", "full_outer")
    return out


def warning_counts(warnings: DataFrame) -> DataFrame:
    """Warnings (component, message) counted by component and normalised message."""
    from weftgraph.functions.scalars import normalised_warning

    return warnings.groupBy("component", normalised_warning(F.col("message")).alias("message")).agg(F.count("*").alias("n"))


def execution_summary(steps: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row of how a run went: status, seconds and rows by step, peak memory of the driver's process, versions, warnings.

    steps: ``StepLog.table``; warnings: ``warning_counts``. The lists are as long as the steps' and warnings' kinds.
    """
    import platform
    import resource
    import sys

    rows = steps.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.round("seconds", 6).alias("seconds"))))).alias("duration_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rows")))).alias("rows"),
    )
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1024 * 1024 if sys.platform == "darwin" else 1024)
    versions = {"python": platform.python_version(), "spark": steps.sparkSession.version}
    rows = rows.withColumns({"peak_rss_mb": F.round(F.lit(peak), 3), "versions": F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])})
    told = F.array().cast("array<struct<component:string,message:string,n:bigint>>")
    if warnings is None:
        rows = rows.withColumn("warnings", told)
    else:
        rows = rows.crossJoin(warnings.agg(F.array_sort(F.collect_list(F.struct("component", "message", "n"))).alias("warnings")))  # one row by one
    return rows.select(F.when(F.size("warnings") > 0, "completed_with_warnings").otherwise("completed").alias("status"), "duration_seconds", "rows", "peak_rss_mb", "versions", "warnings")
