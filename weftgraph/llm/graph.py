"""Connected components of a link table, by local union-find and minimum hooking. Nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.skew import look_up
from weftgraph.llm.workers import task
from weftgraph.session import Scratch


@task
def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (node, root) of a partition's links, root the smallest node; held in memory, at most two rows a link."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(n, find(n)) for n in list(parent)]
    stars = [(n, r) for n, r in stars if n != r]
    for i in range(0, len(stars), 100_000):
        yield pd.DataFrame(stars[i : i + 100_000], columns=["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Each round contracts the links of each partition to stars, hooks every node to its smallest root, and keeps links
    between the roots that met at a node. It ends when every node has one root and no root is a node. The number of
    rounds grows with the logarithm of the longest path at most.

    Links are dealt by their larger end, which after the first contraction has at most one root from each partition,
    so a giant component is spread over all tasks; roots with many nodes are looked up as hot keys.
    """
    links = links.select("a", "b").where("a <> b")
    stars = scratch.table(links.mapInPandas(_forest, "a long, b long"))
    while True:
        hooks = scratch.table(stars.groupBy("a").agg(F.min("b").alias("root"), F.count_distinct("b").alias("roots")))
        nodes, many = hooks.agg(F.count("*"), F.max("roots")).first()
        up = hooks.groupBy("root").agg(F.count("*").alias("n")).join(hooks.select(F.col("a").alias("root"), F.col("root").alias("above")), "root")
        up = scratch.table(up)
        chained = up.limit(1).count()
        if not chained and (many or 1) == 1:
            return hooks.select(F.col("a").alias("node"), F.col("root").alias("component"))
        jumped = look_up(hooks, up, "root", "n", nodes)
        met = stars.join(hooks.where("roots > 1").select("a", "root"), "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        moved = jumped.select("a", F.coalesce("above", "root").alias("b"))
        kept = up.select(F.col("root").alias("a"), F.col("above").alias("b"))
        both = moved.unionByName(met).unionByName(kept).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        stars = scratch.table(both.repartition("a").mapInPandas(_forest, "a long, b long"))
