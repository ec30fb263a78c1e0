"""Refinement and scoring: hand-made graphs, metric corner cases, the eight published rows, and refinement by brute force."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import refine, scoring
from weftgraph.schemas import ABSTENTIONS, EDGES, MODES, TRUTH
NODE = "graph_id string, id string, type string, scored boolean, color_class string"


def graph(spark, nodes, edges):
    return spark.createDataFrame([("g", *n) for n in nodes], NODE), spark.createDataFrame([("g", *e) for e in edges], EDGES)


def clusters(colors, mode="full"):
    rows = refine.scored_clusters(colors).where(F.col("mode") == mode).orderBy("cluster").collect()
    return [r["members"] for r in rows]


LEAVES = [("caller_a", "anchor", False, None), ("caller_b", "anchor", False, None), ("leaf_a", "user", True, None), ("leaf_b", "user", True, None)]
CALLS = [("caller_a", "leaf_a", 1), ("caller_b", "leaf_b", 1)]


def test_modes(spark):
    colors, rounds, _ = refine.refine(*graph(spark, LEAVES, CALLS), MODES)
    apart, together = [["leaf_a"], ["leaf_b"]], [["leaf_a", "leaf_b"]]
    assert {m: clusters(colors, m) for m in MODES} == {"full": apart, "in": apart, "out-in": apart, "out": together}
    assert rounds.count() == 4


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        refine.refine(*graph(spark, LEAVES, CALLS), ("sideways",))


def test_anchor_classes(spark):
    shared = [(i, t, s, "ROLE:incoming" if t == "anchor" else None) for i, t, s, _ in LEAVES]
    assert clusters(refine.refine(*graph(spark, shared, CALLS))[0]) == [["leaf_a", "leaf_b"]]
    more = [*shared, ("context_a", "anchor", False, "ROLE:context")]
    assert clusters(refine.refine(*graph(spark, more, [*CALLS, ("caller_a", "context_a", 1)]))[0]) == [["leaf_a"], ["leaf_b"]]


def test_multiset_sums_by_colour(spark):
    colors = spark.createDataFrame([("g", "full", "a", "leaf"), ("g", "full", "b", "leaf"), ("g", "full", "c", "other")], "graph_id string, mode string, id string, color string")
    edges = spark.createDataFrame([("g", "x", "a", 1), ("g", "x", "b", 2), ("g", "x", "c", 4)], EDGES)
    got = {(r["color"], r["weight"]) for r in refine.neighbour_multiset(colors, edges, "out").collect()}
    assert got == {("leaf", 3), ("other", 4)}


def test_trace(spark):
    colors, rounds, history = refine.refine(*graph(spark, LEAVES, CALLS), trace=True)
    states = [r["state"] for r in refine.trace_states(history).orderBy("round").collect()]
    assert states[0] == "seed" and states[-1] == "fixpoint" and len(states) == rounds.first()["rounds"] + 1
    assert refine.same_partition(colors.select("graph_id", "id", "color"), history.where(F.col("round") == len(states) - 1).select("graph_id", "id", "color"))


def test_self_call_only_uses_callers(spark):
    nodes = [("a", "user", True, None), ("b", "user", True, None), ("x", "anchor", False, None)]
    colors, _, _ = refine.refine(*graph(spark, nodes, [("a", "a", 1), ("b", "b", 1), ("x", "a", 1)]), ("out-in",))
    assert clusters(colors, "out-in") == [["a"], ["b"]]


@pytest.mark.parametrize(("counts", "want"), [((0, 0, 3, 7), (None, 0.0, 0.0)), ((0, 2, 3, 5), (0.0, 0.0, 0.0)), ((0, 0, 0, 0), (None, None, None)), ((4, 10, 0, 52), (0.2857142857142857, 1.0, 0.4444444444444445))])
def test_metrics(spark, counts, want):
    row = scoring.with_metrics(spark.createDataFrame([counts], "tp bigint, fp bigint, fn bigint, tn bigint")).first()
    assert (row["precision"], row["recall"], row["f1"]) == want


def test_no_pairs_and_perfect(spark):
    members = spark.createDataFrame([("g", "full", "a", "c1", "o1"), ("h", "full", "a", "c1", "o1"), ("h", "full", "b", "c1", "o1")], "graph_id string, mode string, id string, cluster string, origin string")
    rows = {r["graph_id"]: r for r in scoring.with_metrics(scoring.pair_counts(members)).collect()}
    assert rows["g"]["ari"] is None and rows["g"]["f1"] is None
    assert rows["h"]["tp"] == 1 and rows["h"]["ari"] == 1.0


def test_large_counts_do_not_overflow(spark):
    row = scoring.with_metrics(spark.createDataFrame([(2**40, 2**41, 2**42, 2**43)], "tp bigint, fp bigint, fn bigint, tn bigint")).first()
    assert 0 < row["f1"] < 1 and -1 < row["ari"] < 1


def test_coverage_with_abstentions(spark):
    truth = spark.createDataFrame([("g", "shared", "a"), ("g", "shared", "b"), ("g", "external_only", "c")], TRUTH)
    scored, gone = spark.createDataFrame([("g", "a")], "graph_id string, id string"), spark.createDataFrame([("g", "b", "abstain", "x"), ("g", "c", "abstain", "x")], ABSTENTIONS)
    members = scored.select("graph_id", "id", F.lit("c1").alias("cluster"), F.lit("shared").alias("origin"))
    row = scoring.coverage(scored, gone, truth, scoring.pair_counts(members, ("graph_id",))).first()
    assert (row["targets"], row["grouped"], row["target_coverage"], row["effective_family_pair_recall"]) == (3, 1, 1 / 3, 0.0)
    origins = scoring.origin_scores(truth, members, gone, named=True)
    status = scoring.family_status(origins).first()
    assert (status["evidence_insufficient"], status["recovery_na"]) == (1, 1)


def test_colliding_origins(spark):
    truth = spark.createDataFrame([("g", "o1", "a"), ("g", "o1", "b"), ("g", "o2", "c")], TRUTH)
    members = spark.createDataFrame([("g", "a", "c1", "o1"), ("g", "b", "c2", "o1"), ("g", "c", "c1", "o2")], "graph_id string, id string, cluster string, origin string")
    rows = {r["origin"]: r for r in scoring.origin_scores(truth, members, members.select("graph_id", "id").limit(0), named=True).collect()}
    assert rows["o1"]["colliding"] == ["o2"] and rows["o1"]["recovered_pairs"] == 0 and rows["o1"]["clusters"] == 2


#: Published rows: graph, rounds, tp, fp, fn, tn, precision, recall, F1, ARI; equal for both profiles. Fixed values.
PUBLISHED = [
    ("one.O3S", 1, 6, 0, 0, 9, 1.0, 1.0, 1.0, 1.0),
    ("two.O3S", 2, 4, 10, 0, 52, 0.2857142857142857, 1.0, 0.4444444444444445, 0.3866171003717472),
    ("three.O3S", 2, 4, 1, 6, 67, 0.8, 0.4, 0.5333333333333333, 0.48971962616822434),
    ("three.O3KS", 2, 15, 1, 0, 120, 0.9375, 1.0, 0.967741935483871, 0.9635974304068522),
]


def published_graphs():
    """(graph, calls, anchors, families) of the programs behind the published rows, by the roles of their functions.

    A program's main calls each entry function twice. Copies of one generic function are a family.
    """
    out = []

    def add(name, entries, calls, families, anchors=("main",)):
        calls = [*calls, *[("main", e, 2) for e in entries]]
        out.append((name, calls, anchors, families))

    three = (0, 1, 2)
    # every caller calls its own leaf five times; leaves call themselves; all are entries
    leaf, caller = [f"leaf{i}" for i in three], [f"caller{i}" for i in three]
    for profile in ("plain", "min"):
        add(f"one.O3S.{profile}", leaf + caller, [(x, x, 1) for x in leaf] + [(c, x, 5) for c, x in zip(caller, leaf, strict=True)], [leaf, caller])
    # pairs of wrapper and inner function; the inner ones of family a call themselves twice, the others once
    wrappers = ["a0", "a1", "b0", "b1", "c0", "d0"]
    wrapped = [(w, f"{w}_inner", 5) for w in wrappers] + [(f"{w}_inner", f"{w}_inner", 2 if w[0] == "a" else 1) for w in wrappers]
    families = [[w for w in wrappers if w[0] == f] for f in "abcd"]
    families += [[f"{w}_inner" for w in f] for f in families]
    add("two.O3S.plain", wrappers, wrapped, families)
    add("two.O3S.min", wrappers, wrapped + [(w, "helper", 1) for w in wrappers], families, ("main", "helper"))
    # two drivers of each shared function, one calls it twice, the other thrice; the shared ones have inner calls left
    shared, twice, thrice = [f"shared{i}" for i in three], [f"twice{i}" for i in three], [f"thrice{i}" for i in three]
    driven = [(t, s, 2) for t, s in zip(twice, shared, strict=True)] + [(t, s, 3) for t, s in zip(thrice, shared, strict=True)]
    entries = ["alone0", "alone1", *twice, *thrice]
    for profile in ("plain", "min"):
        inner = ["inner0", "inner1"]  # the third one's was inlined
        add(f"three.O3S.{profile}", entries, driven + [(s, i, 2) for s, i in zip(shared, inner)], [shared, inner, twice, thrice, ["alone0"], ["alone1"]])
        inner, last = [f"inner{i}" for i in three], [f"last{i}" for i in three]
        calls = driven + [(s, i, 2) for s, i in zip(shared, inner, strict=True)] + [(s, x, 1) for s, x in zip(shared, last, strict=True)]
        add(f"three.O3KS.{profile}", entries, calls, [shared, inner, last, twice, thrice, ["alone0"], ["alone1"]])
    return out


def test_published_rows(spark):
    nodes, edges, truth = [], [], []
    for name, calls, anchors, families in published_graphs():
        members = sorted({x for c in calls for x in c[:2]})
        nodes += [(name, m, "anchor" if m in anchors else "user", m not in anchors, None) for m in members]
        edges += [(name, *c) for c in calls]
        truth += [(name, f"family{i}", m) for i, f in enumerate(families) for m in f]
    colors, rounds, _ = refine.refine(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGES))
    members = scoring.cluster_members(colors, spark.createDataFrame(truth, TRUTH))
    rows = scoring.with_metrics(scoring.pair_counts(members)).join(rounds, ["graph_id", "mode"]).collect()
    got = {r["graph_id"]: tuple(r[c] for c in ("rounds", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "ari")) for r in rows}
    assert got == {f"{g[0]}.{p}": g[1:] for p in ("plain", "min") for g in PUBLISHED}


# Work by what changed, and the certificate


def plain_refine(nodes, edges, mode, most=10**6):
    """Partition and rounds by whole multisets, nothing hashed."""
    from collections import Counter

    out, into, self_count = {}, {}, Counter()
    for s, d, c in edges:
        if s == d:
            self_count[s] += c
        else:
            out.setdefault(s, Counter())[d] += c
            into.setdefault(d, Counter())[s] += c
    color = {}
    for i, kind, _, klass in nodes:
        seen = into if mode == "in" else out
        color[i] = ("anchor", klass or i) if kind == "anchor" else ("user", self_count[i], len(seen.get(i, ())))
    rounds = 0
    while rounds < most:
        def profile(side, i):
            sums = Counter()
            for j, c in side.get(i, {}).items():
                sums[color[j]] += c
            return frozenset(sums.items())

        rounds += 1
        new = {i: (color[i], profile(out, i) if mode != "in" else None, profile(into, i) if mode in ("full", "in") or (mode == "out-in" and i not in out) else None) for i in color}
        names = {}
        new = {i: names.setdefault(v, len(names)) for i, v in new.items()}
        stable = len(names) == len(set(color.values()))
        color = new
        if stable:
            break
    parts = {}
    for i, c in color.items():
        parts.setdefault(c, set()).add(i)
    return {frozenset(p) for p in parts.values()}, rounds


def random_graph(n, degree, seed):
    import random

    rng = random.Random(seed)
    nodes = [(f"n{i:03}", "anchor" if i % 17 == 0 else "user", i % 17 != 0, "ROLE:x" if i % 34 == 0 else None) for i in range(n)]
    edges = {(f"n{rng.randrange(n):03}", f"n{min(n - 1, int(rng.random() ** 3 * n)):03}"): rng.choice([1, 1, 2]) for _ in range(int(n * degree))}
    edges |= {(f"n{i:03}", f"n{i + 1:03}"): 1 for i in range(n // 2, n - 1)}
    return nodes, [(a, b, c) for (a, b), c in edges.items()]


def partition(colors, mode):
    parts = {}
    for r in colors.where(F.col("mode") == mode).collect():
        parts.setdefault(r["color"], set()).add(r["id"])
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("bits", [128, 8])
def test_partition_is_exact(spark, bits):
    """Whatever the digests' width, the partition is that of whole multisets."""
    nodes, edges = random_graph(70, 0.6, 3)
    colors, rounds, _ = refine.refine(*graph(spark, nodes, edges), MODES, bits=bits)
    for mode in MODES:
        want, n = plain_refine(nodes, edges, mode)
        assert partition(colors, mode) == want, mode
        assert bits < 128 or rounds.where(F.col("mode") == mode).first()["rounds"] == n


def test_rounds_are_those_of_whole_rounds(spark):
    nodes, edges = random_graph(50, 0.5, 8)
    history = refine.refine(*graph(spark, nodes, edges), trace=True)[2]
    for number in range(history.agg(F.max("round")).first()[0] + 1):
        want = plain_refine(nodes, edges, "full", number)[0]
        assert partition(history.where(F.col("round") == number), "full") == want


def test_work_follows_splits(spark):
    """On a path each round digests the neighbours of the few nodes that left, not all nodes."""
    n = 16
    nodes = [(f"n{i:03}", "user", True, None) for i in range(n)]
    edges = [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(n - 1)]
    digested = []
    colors, rounds, _ = refine.refine(*graph(spark, nodes, edges), digested=digested)
    assert partition(colors, "full") == {frozenset([f"n{i:03}"]) for i in range(n)}
    assert len(digested) == rounds.first()["rounds"] and digested[0] == n and max(digested[1:]) <= 6, digested
