"""Reachability from many seeds over many graphs: a frontier loop of joins, with shortcuts where paths are long."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weftgraph.session import cut

#: Rounds that follow edges alone; graphs that need more get shortcuts, which pay on long paths only.
PLAIN = 4
#: Tables of earlier frontiers that a round reads before they are written as one.
PARTS = 8


def _two_of(edges: DataFrame, level: int) -> DataFrame:
    """At most two edges of each source, chosen by hash, so that hubs combine on the map side."""
    by = F.struct(F.xxhash64(F.lit(level), "source", "node").alias("h"), "node")
    both = edges.groupBy("graph_id", "source").agg(F.min(by).alias("a"), F.max(by).alias("b"))
    return both.select("graph_id", "source", F.explode(F.array_distinct(F.array("a.node", "b.node"))).alias("node"))


def _doubled(jumps: DataFrame, level: int) -> DataFrame:
    """Shortcuts of two jumps each, at most two from a node."""
    on = jumps.select("graph_id", F.col("source").alias("node"), F.col("node").alias("far"))
    return _two_of(jumps.join(on, ["graph_id", "node"]).where("far <> source").select("graph_id", "source", F.col("far").alias("node")), level)


def frontiers(edges: DataFrame, seeds: DataFrame, universe: DataFrame | None = None, ready: bool = False) -> Iterator[DataFrame]:
    """The nodes (graph_id, node) that each round finds, seeds first; together each node once. For arguments see ``reachable``."""
    edges = edges.select("graph_id", "source", F.col("target").alias("node")).where("source <> target")
    if universe is not None:
        seeds = seeds.join(universe, ["graph_id", "node"], "left_semi")
    if not ready:
        edges = edges.distinct()
        edges = cut(edges if universe is None else edges.join(universe, ["graph_id", "node"], "left_semi"))
    frontier = cut(seeds.select("graph_id", "node").distinct())
    seen, jumps, number = [frontier], None, 0
    follow = lambda ways, nodes: ways.join(nodes.withColumnRenamed("node", "source"), ["graph_id", "source"]).select("graph_id", "node")
    while not frontier.isEmpty():
        yield frontier
        number += 1
        every = reduce(DataFrame.unionByName, seen)
        near = follow(edges, frontier)
        if number > PLAIN:
            # a jump spans twice the rounds that made it, so what is seen grows by about as much again
            jumps = cut(_two_of(edges, 0) if jumps is None else _doubled(jumps, number))
            near = near.unionByName(follow(jumps, every))
        frontier = cut(near.distinct().join(every, ["graph_id", "node"], "left_anti"))
        seen.append(frontier)
        if len(seen) > PARTS:
            seen = [cut(reduce(DataFrame.unionByName, seen))]


def reachable(edges: DataFrame, seeds: DataFrame, universe: DataFrame | None = None, ready: bool = False) -> DataFrame:
    """(graph_id, node) reachable from ``seeds`` (graph_id, node), seeds included. edges: (graph_id, source, target).

    Seeds outside ``universe`` are dropped; edges lead only into it. ``ready``: edges are a table already, each once, and
    lead into the universe anyway. A round follows the edges of the newest nodes, so an
    edge is followed once. After PLAIN rounds each one also doubles a set of shortcuts (at most two from a node, chosen by
    hash) and follows them from all nodes seen: a path of n steps ends after about PLAIN + log2(n) rounds, and where the
    choice misses a node, edges reach it as before. Frontiers stay tables of their own until PARTS of them are written as
    one. The loop ends when edges lead to nothing new; shortcuts only hasten it.
    """
    found = list(frontiers(edges, seeds, universe, ready))
    return reduce(DataFrame.unionByName, found) if found else seeds.select("graph_id", "node").limit(0)
