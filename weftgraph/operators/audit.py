"""Audit of external labels against a catalog of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.scalars import node_id, ratio
from weftgraph.schemas import AUDIT_STD_OWNERS, ID_BIAS, STAGES

DIRECT = "direct-flirt"


def stage_labels(snapshots: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Snapshots (address, evidence, ...) where a later stage keeps only addresses that no earlier stage has."""
    rank = F.coalesce(*[F.when(F.col("evidence") == e, F.lit(i)) for i, e in enumerate(order)])
    first = snapshots.withColumn("stage", rank).groupBy("address").agg(F.min("stage").alias("first"))
    return snapshots.withColumn("stage", rank).join(first, "address").where("stage = first").drop("stage", "first")


def join_labels(labels: DataFrame, functions: DataFrame) -> DataFrame:
    """Labels with ``matched``: whether the address is a known function."""
    known = functions.select("address").distinct().withColumn("matched", F.lit(True))
    return labels.join(known, "address", "left").fillna(False, ["matched"])


def label_members(labels: DataFrame, catalog: DataFrame, bias: int = ID_BIAS) -> DataFrame:
    """Directly matched labels joined to their catalog members."""
    direct = labels.where((F.col("evidence") == DIRECT) & F.col("matched")).withColumn("member", node_id(F.col("address"), bias))
    return direct.select("member", F.col("canonical_origin").alias("label_origin"), F.col("owner").alias("label_owner")).join(catalog.select("member", "origin", "owner"), "member")


def std_confusion(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Label says standard library against the owner says so, over all catalog members."""
    said = members.where(F.col("label_owner").isin(*AUDIT_STD_OWNERS)).select("member").distinct().withColumn("said", F.lit(True))
    rows = catalog_members(catalog).join(said, "member", "left").fillna(False, ["said"])
    tests = {"tp": F.col("said") & F.col("is_std"), "fp": F.col("said") & ~F.col("is_std"), "fn": ~F.col("said") & F.col("is_std"), "tn": ~F.col("said") & ~F.col("is_std")}
    rows = rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def exact_identity(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels whose origin and owner are the catalog's, over joined members."""
    right = (F.col("label_origin") == F.col("origin")) & (F.col("label_owner") == F.col("owner"))
    sums = members.agg(F.count("*").alias("matched"), F.count_if(right).alias("correct")).withColumn("incorrect", F.col("matched") - F.col("correct"))
    return sums.crossJoin(catalog.agg(F.count_distinct("member").alias("members"))).select("matched", "correct", "incorrect", ratio(F.col("correct"), F.col("matched")).alias("precision"), ratio(F.col("correct"), F.col("members")).alias("coverage"))


def mixed_families(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Origins with members both known (labelled as standard library) and unknown, and their cross pairs."""
    known = members.where(F.col("label_owner").isin(*AUDIT_STD_OWNERS)).select("member").distinct().withColumn("known", F.lit(True))
    rows = catalog.join(known, "member", "left").fillna(False, ["known"])
    sums = rows.groupBy("origin").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown")).where("known > 0 and unknown > 0")
    return sums.withColumn("cross_pairs", F.col("known") * F.col("unknown"))


def probe_from_labels(labels: DataFrame) -> DataFrame:
    """The probe's relation again: every label, matched or not, by stage."""
    return labels.drop("matched").dropDuplicates(["address", "evidence"])


def probe_stages(labels: DataFrame) -> dict[str, DataFrame]:
    """The probe's relations by stage, of label tables of many graphs, as a probe's document lists them."""
    return {stage: labels.where(F.col("evidence") == stage).drop("matched") for stage in STAGES}


def join_stages(labels: DataFrame, functions: DataFrame) -> DataFrame:
    """Labels of every stage by graph, with ``matched``, origin and owner derived anew: what a label document holds."""
    from weftgraph.sources.documents import renormalised

    known = functions.select("graph_id", "address").distinct().withColumn("matched", F.lit(True))
    return renormalised(labels.drop("matched").join(known, ["graph_id", "address"], "left").fillna(False, ["matched"]))


def catalog_members(catalog: DataFrame) -> DataFrame:
    """Catalog rows with ``is_std``: whether the audit counts the owner as standard library."""
    return catalog.withColumn("is_std", F.coalesce(F.col("owner").isin(*AUDIT_STD_OWNERS), F.lit(False)))
