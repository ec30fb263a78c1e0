"""Comparison of a partition with a labelled one, by contingency counts: no pair is ever formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pairs(n: Column) -> Column:
    """n choose 2, exact in integers."""
    return F.shiftright((n * (n - 1)).cast("bigint"), 1)


def contingency(members: DataFrame, keys: tuple[str, ...] = ("graph_id", "mode")) -> DataFrame:
    """Members counted by (cluster, origin)."""
    return members.groupBy(*keys, "cluster", "origin").agg(F.count("*").alias("n"))


def pair_counts(members: DataFrame, keys: tuple[str, ...] = ("graph_id", "mode")) -> DataFrame:
    """tp, fp, fn, tn over unordered member pairs. members: keys, cluster, origin; one row per member."""
    return cell_counts(contingency(members, keys), keys)


def cell_counts(cells: DataFrame, keys: tuple[str, ...] = ("graph_id", "mode")) -> DataFrame:
    """``pair_counts`` of members that are counted already: cells as of ``contingency``, read three times."""
    together = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("tp"), F.sum("n").alias("members"))
    clusters = cells.groupBy(*keys, "cluster").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("same_cluster"))
    origins = cells.groupBy(*keys, "origin").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("same_origin"))
    joined = together.join(clusters, list(keys)).join(origins, list(keys))
    return joined.select(*keys, "members", "tp", (F.col("same_cluster") - F.col("tp")).alias("fp"), (F.col("same_origin") - F.col("tp")).alias("fn"), (pairs(F.col("members")) - F.col("same_cluster") - F.col("same_origin") + F.col("tp")).alias("tn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and adjusted Rand index from tp, fp, fn, tn; null where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    plain = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    f1 = F.when(total == 0, None).when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(plain)
    expected, most = F.try_divide((tp + fp) * (tp + fn), total), 0.5 * ((tp + fp) + (tp + fn))
    ari = F.when(total == 0, None).when(most == expected, 1.0).otherwise(F.try_divide(tp - expected, most - expected))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1, "ari": ari})


def coverage(scored: DataFrame | None, abstained: DataFrame, truth: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Target, pair-decision and same-family coverage and effective recall, by keys.

    scored, abstained: (keys, id); truth: (keys, origin, member); counts: pair_counts by keys, which count the scored, too,
    where these are None.
    """
    grouped = counts.select(*keys, F.col("members").alias("grouped")) if scored is None else scored.groupBy(*keys).agg(F.count("*").alias("grouped"))
    left = abstained.groupBy(*keys).agg(F.count("*").alias("abstained"))
    families = truth.groupBy(*keys, "origin").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("family_pairs"))
    rows = families.join(grouped, [*keys], "left").join(left, [*keys], "left").join(counts.select(*keys, "tp", "fn"), [*keys], "left")
    rows = rows.fillna(0, ["grouped", "abstained", "tp", "fn"]).withColumn("targets", F.col("grouped") + F.col("abstained"))
    return rows.select(
        *keys, "targets", "grouped", "abstained", pairs(F.col("targets")).alias("target_pairs"), "family_pairs", (F.col("tp") + F.col("fn")).alias("scored_family_pairs"),
        F.try_divide(F.col("grouped").cast("double"), F.col("targets")).alias("target_coverage"),
        F.try_divide(pairs(F.col("grouped")).cast("double"), pairs(F.col("targets"))).alias("pair_decision_coverage"),
        F.try_divide((F.col("tp") + F.col("fn")).cast("double"), F.col("family_pairs")).alias("same_family_pair_coverage"),
        F.try_divide(F.col("tp").cast("double"), F.col("family_pairs")).alias("effective_family_pair_recall"),
    )


def origin_scores(truth: DataFrame, members: DataFrame, abstained: DataFrame, keys: tuple[str, ...] = ("graph_id",), named: bool = False) -> DataFrame:
    """One row per origin: sizes, clusters, recovered and total pairs, coverage, recall, collisions.

    truth: (keys, origin, member); members: (keys, id, cluster, origin) of scored nodes; abstained: (keys, id).
    ``collides`` comes from counts. ``named`` adds the colliding origins by name: cells of clusters with several origins
    meet for that, and a cluster of m origins makes m lists of m - 1 names, so it is for reports that show them.
    """
    keys = [*keys]
    sizes = truth.groupBy(*keys, "origin").agg(F.count("*").alias("instances"))
    gone = truth.join(abstained.select(*keys, F.col("id").alias("member")), [*keys, "member"], "left_semi").groupBy(*keys, "origin").agg(F.count("*").alias("abstained"))
    cells = contingency(members, tuple(keys))
    shared = cells.groupBy(*keys, "cluster").agg(F.count("*").alias("origins__")).where("origins__ > 1").select(*keys, "cluster", F.lit(True).alias("shared"))
    cells = cells.join(shared, [*keys, "cluster"], "left").fillna(False, ["shared"])
    found = cells.groupBy(*keys, "origin").agg(F.sum("n").alias("scored"), F.count("*").alias("clusters"), F.sum(pairs(F.col("n"))).alias("recovered_pairs"), F.max("shared").alias("collides"))
    rows = sizes.join(gone, [*keys, "origin"], "left").join(found, [*keys, "origin"], "left")
    rows = rows.fillna(0, ["abstained", "scored", "clusters", "recovered_pairs"]).fillna(False, ["collides"])
    more = ["collides"]
    if named:
        mixed = cells.where("shared")
        clash = mixed.join(mixed.select(*keys, "cluster", F.col("origin").alias("other")), [*keys, "cluster"]).where("origin <> other")
        rows = rows.join(clash.groupBy(*keys, "origin").agg(F.array_sort(F.collect_set("other")).alias("colliding")), [*keys, "origin"], "left")
        more.append(F.coalesce("colliding", F.array().cast("array<string>")).alias("colliding"))
    many = pairs(F.col("instances"))
    return rows.select(
        *keys, "origin", "instances", "scored", "abstained", "clusters", "recovered_pairs", pairs(F.col("scored")).alias("total_pairs"), many.alias("target_pairs"),
        F.try_divide(pairs(F.col("scored")).cast("double"), many).alias("scored_pair_coverage"), F.try_divide(F.col("recovered_pairs").cast("double"), many).alias("effective_recall"), *more,
    )


def family_status(origins: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Families (origins with target pairs) by evidence, recovery and collision; one row per keys."""
    rows = origins.where("target_pairs > 0")
    none, part = F.col("total_pairs") == 0, F.col("abstained") > 0
    tests = {
        "evidence_full": ~none & ~part, "evidence_partial": ~none & part, "evidence_insufficient": none,
        "recovery_complete": ~none & (F.col("recovered_pairs") == F.col("total_pairs")), "recovery_partial": ~none & (F.col("recovered_pairs") > 0) & (F.col("recovered_pairs") < F.col("total_pairs")),
        "recovery_missed": ~none & (F.col("recovered_pairs") == 0), "recovery_na": none, "collision": F.col("collides"),
    }
    return rows.groupBy(*keys).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def cluster_members(colors: DataFrame, truth: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Scored members with their cluster (colour), origin and, where given, display names."""
    rows = colors.where("scored").select("graph_id", "mode", "id", F.col("color").alias("cluster")).join(truth.withColumnRenamed("member", "id"), ["graph_id", "id"], "left")
    return rows if symbols is None else rows.join(symbols.withColumnRenamed("member", "id"), ["graph_id", "id"], "left")


def with_labels(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """Nodes with ``labels``, an array of their truth's rows, so that members of all modes need no join of their own."""
    held = truth.groupBy("graph_id", F.col("member").alias("id")).agg(F.collect_list(F.struct("origin")).alias("labels"))
    return nodes.join(held, ["graph_id", "id"], "left")


def labelled_members(colors: DataFrame) -> DataFrame:
    """``cluster_members`` of colours that carry ``labels``."""
    rows = colors.where("scored").select("graph_id", "mode", "id", F.col("color").alias("cluster"), F.explode_outer("labels").alias("label"))
    return rows.select("graph_id", "mode", "id", "cluster", "label.origin")
