"""Product codes: plain Lloyd in Python integers, what changes a round, and the edge cases of the docstring."""

import hashlib
import math
import random

import numpy as np
import pytest

from weftgraph.llm import vector_codes as vc
from weftgraph.session import Beside, Scratch

rng = random.Random(13)
TABLE = "vec_id bigint, embedding array<float>, label int"


def brute(rows, rounds=4, entries=256):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in good), default=0)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in good if len(v) == width and width]
    size = width // 4
    cut = [[v[p * size : (p + 1) * size] for p in range(4)] for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda j: (good[j][0] is None, good[j][0] or 0, good[j][1]))[:entries]
    books = [[list(cut[j][p]) for j in order] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            of = [near(p, x[p])[1] for x in cut]
            for e in range(len(books[p])):
                mine = [x[p] for x, f in zip(cut, of, strict=True) if f == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(p, x[p]) for p in range(4)] for x in cut]
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(good, errors, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), error, by[label], digest) for (i, _, label), f, error in zip(good, found, errors, strict=True)), key=str)


def vectors(n, width=8):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(20)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((i * 3, [c + rng.gauss(0, 0.3) for c in centre], rng.choice([None, 0, 1, 2])))
    return rows


@pytest.mark.parametrize("n", [5, 256, 700])
def test_against_plain_lloyd(spark, n):
    rows = vectors(n)
    rows += [(i + 10**6, rows[0][1], 1) for i in range(n // 3)]  # one vector in many rows
    rng.shuffle(rows)
    got = vc.compress(spark.createDataFrame(rows, TABLE).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_bad_rows(spark):
    rows = [*vectors(20, 4), (1, None, 0), (2, [1.0, None, 0.0, 0.0], 0), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (7, [], 2), (8, [1.0] * 3, 2), (None, [0.5] * 4, None), (9, [0.0] * 4, 3), (9, [-0.1] * 4, 3), (9, [-0.1] * 4, 3)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], f"{TABLE}, code string, key int")
    assert sorted((tuple(r) for r in vc.compress(docs).collect()), key=str) == brute(rows)
    assert vc.compress(docs.where("vec_id in (1, 2)")).count() == 0 and vc.compress(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], TABLE))


def test_only_changes_are_shuffled(spark):
    """Rounds after the first contribute fewer parts, joins lie side by side, and sums stay exact."""
    rows = vectors(900)
    kept = spark.createDataFrame(rows, TABLE).selectExpr("vec_id i", "label l", "embedding v").repartition(4)
    with Scratch(spark) as scratch, Beside(scratch) as beside:
        blocks = kept.mapInArrow(vc._blocks(8), "block string, ids array<long>, labels array<int>, vectors binary")
        blocks = beside.table(blocks, "block")
        first = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in rows[:256]]).reshape(256, 4, 2).transpose(1, 0, 2)
        _, changed = vc.lloyd(blocks, first, beside)
        assert changed[0] == 4 * 900 and all(0 < c < 1800 for c in changed[1:])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = blocks.join(spark.table(beside.names[-1]).where("block is not null").select("block", "codes"), "block")._jdf.queryExecution().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Join" in plan and "Exchange" not in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("beside_")]


def test_large_components():
    """Distances beyond the exact range of doubles are taken in integers."""
    x = np.array([[2**27, 1, 0, 0], [2**27 - 1, 0, 5, 0]], np.int32)
    codebooks = np.array([[[2**27], [2**27 - 1]], [[0], [1]], [[0], [5]], [[0], [0]]])
    codes, error = vc.nearest(x, codebooks)
    assert codes.tolist() == [[0, 1, 0, 0], [1, 0, 1, 0]] and error.tolist() == [0, 0]
