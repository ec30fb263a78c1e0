"""Interval look-up by a sweep and reachability with shortcuts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import closure, evidence, sweep

rng = random.Random(5)
EDGE = "graph_id string, source bigint, target bigint"
NODE = "graph_id string, node bigint"


def test_running_max_over_ranges(spark):
    """One group over many ranges, others within one, and values before each row only."""
    rows = [("hot", i, rng.randrange(1000) if i % 3 else None) for i in range(2000)] + [(f"g{i % 40}", i, i * 7 % 50) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sweep.running_max(spark.createDataFrame(rows, "g string, at bigint, v bigint").repartition(4), "g", ["at"], F.col("v"), "upto").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = {}
    for g, at, v in sorted(rows, key=lambda r: (r[0], r[1])):
        want = upto.get(g)
        assert next(r["upto"] for r in got if (r["g"], r["at"]) == (g, at)) == want if at % 97 == 0 else True
        if v is not None:
            upto[g] = v if want is None else max(want, v)
    assert len(got) == len(rows)


def test_first_holding(spark):
    extents, points = [], []
    for g in "abc":
        for _ in range(120):
            start = rng.randrange(10_000)
            extents.append((g, start, start + rng.choice([0, 1, 5, 80, 900])))
        points += [(g, p) for p in rng.sample(range(11_000), 700)]
    extents += [("a", 0, 1), ("d", 5, 6), (None, 1, 2), ("b", None, 9), ("b", 3, None)]
    points += [("e", 5), ("a", None)]
    got = {(r["graph_id"], r["p"]): r["around"] for r in sweep.first_holding(spark.createDataFrame(points, "graph_id string, p bigint"), spark.createDataFrame(extents, "graph_id string, start bigint, stop bigint"), "graph_id", "p").collect()}
    want = {}
    for g, p in points:
        held = [s for e, s, t in extents if e == g and None not in (s, t, p) and s <= p < t]
        if held:
            want[g, p] = min(held)
    assert got == want


def test_long_extents_cost_a_row(spark):
    """An extent of a gigabyte is one row in every step, and its points find it."""
    functions = spark.createDataFrame([("x", 0, 1 << 30), ("x", 5000, 10), ("x", 1 << 29, 1 << 31)], "graph_id string, address bigint, size bigint")
    points = spark.createDataFrame([("x", 5001), ("x", (1 << 30) - 1), ("x", 1 << 30), ("x", 5 << 29)], "graph_id string, target bigint")
    got = {r["target"]: r["function"] for r in evidence.containing_function(points, functions).collect()}
    assert got == {5001: 0, (1 << 30) - 1: 0, 1 << 30: 1 << 29, 5 << 29: None}
    assert "Generate" not in evidence.containing_function(points, functions)._jdf.queryExecution().toString()


def plain_reach(edges, seeds):
    out, todo = set(seeds), list(seeds)
    while todo:
        g, n = todo.pop()
        for h, a, b in edges:
            if (h, a) == (g, n) and (h, b) not in out:
                out.add((h, b))
                todo.append((h, b))
    return out


@pytest.mark.parametrize("nodes,degree", [(60, 1), (80, 2), (40, 5)])
def test_reachable(spark, nodes, degree):
    edges = list({(g, rng.randrange(nodes), rng.randrange(nodes)) for g in "ab" for _ in range(nodes * degree)}) + [("a", i, i + 1) for i in range(nodes, nodes + 30)] + [("a", 3, nodes)]
    seeds = [("a", 3), ("b", 0), ("b", 1), ("c", 9)]
    got = closure.reachable(spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, NODE)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_reach(edges, seeds)


def test_long_path(spark):
    """Ten thousand steps, and a ladder of two such paths with rungs, take few rounds."""
    steps = 10_000
    path = spark.range(steps).select(F.lit("p").alias("graph_id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    rounds = list(closure.frontiers(path, spark.createDataFrame([("p", 0)], NODE)))
    assert len(rounds) < 20 and sum(r.count() for r in rounds) == steps + 1


def test_no_seeds(spark):
    assert closure.reachable(spark.createDataFrame([("a", 1, 2)], EDGE), spark.createDataFrame([], NODE)).count() == 0
