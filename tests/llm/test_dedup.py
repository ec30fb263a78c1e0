"""Exact and near dedup, embeddings, components: brute force on small tables, and the edge cases of the docstrings."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from weftgraph.llm import embedding_dedup, exact_dedup, graph, near_dedup
from weftgraph.session import Scratch

DOCS = "doc_id bigint, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]")
rng = random.Random(3)


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


def want_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((i, t or ""))
    out = set()
    for body, group in groups.items():
        keep = min(group, key=lambda g: (-len(g[1]), g[0]))[0]
        out |= {(i, keep, len(group), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i, _ in group}
    return out


EXACT = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b"), (7, "A b"), (8, "é b"), (9, "éb "), (10, "a b"), (11, "x" * 200_000), (12, "x" * 199_999 + " x"), (13, "ab")]


@pytest.mark.parametrize("memtable", [1, 10_000, 1 << 25])
@pytest.mark.parametrize("digest", [32, 1])
def test_exact(spark, memtable, digest):
    rows = EXACT + [(100 + i, f"text {i // 3}") for i in range(60)]
    got = exact_dedup.exact_dedup(docs(spark, rows), memtable_bytes=memtable, digest_bytes=digest)
    assert {tuple(r) for r in got.collect()} == want_exact(rows)


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a", "z", True), (1, "a", "z", True), (None, "a", "y", False)], "doc_id bigint, text string, digest string, kept boolean")
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_dedup(rows).collect()), key=str)
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False)]
    kept = exact_dedup.keep(rows)
    assert kept.columns == rows.columns and kept.where("doc_id = 1").count() == 1


def test_exact_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(3000)]
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()} == want_exact(rows)


def test_exact_keep_loses_no_text(spark):
    """A row that stays isn't lost with a dropped one of its doc_id; null ids drop like others."""
    kept = lambda rows: sorted((tuple(r) for r in exact_dedup.keep(docs(spark, rows)).collect()), key=str)
    assert kept([(1, "a"), (1, "b"), (0, "b")]) == [(0, "b"), (1, "a")]
    assert kept([(1, "a"), (None, "a"), (None, "a")]) == [(1, "a")]
    assert kept([(None, "a"), (None, "a"), (None, "b"), (2, None), (3, "")]) == [(2, None), (None, "a"), (None, "b")]
    assert kept([(5, "a b"), (5, "b"), (5, "ab"), (5, " b"), (5, "a b")]) == [(5, " b"), (5, "a b")]


@pytest.mark.parametrize("keep", [exact_dedup.keep, near_dedup.keep])
def test_keep_reserves_no_column(spark, keep):
    names = ["row_tag", "ITS_ID", "its_tag", "found", "row_tag__", "id__", "tag__", "found__", "stays", "copied"]
    body = "one two three four five six seven eight"
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in [(1, body), (2, body), (3, "other " + body[4:]), (None, "own words here"), (5, body), (5, body)]]
    out = keep(spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *[f"{n} string" for n in names]])))
    assert out.columns == ["doc_id", "text", *names]
    got = {tuple(r) for r in out.collect()}
    assert got <= set(rows) and (None, "own words here") in {r[:2] for r in got} and len([r for r in got if r[1] == body]) == 1


def test_key_filter(spark):
    rows = [(i, f"text {i}") for i in range(4000)]
    held = exact_dedup.digested(docs(spark, rows[:1000]))
    built = exact_dedup.key_filter(held, 1000)
    passed = {r["doc_id"] for r in exact_dedup.passing(exact_dedup.digested(docs(spark, rows)), built).collect()}
    assert set(range(1000)) <= passed and len(passed) < 1300 and built[0].count() <= built[1] == 250
    may, surely = exact_dedup.parted(exact_dedup.digested(docs(spark, rows)), built)
    assert {r["doc_id"] for r in may.collect()} == passed and {r["doc_id"] for r in surely.collect()} == set(range(4000)) - passed
    full = exact_dedup.key_filter(held, 4)  # one word for all: lets too much through, loses nothing
    assert exact_dedup.passing(held, full).count() == 1000


def test_ingest_and_verification(spark):
    old, new = docs(spark, [(1, "a"), (2, "b"), (3, "a ")]), docs(spark, [(10, " b"), (11, "zzz"), (12, "a")])
    index = exact_dedup.compact_runs(exact_dedup.build_runs(exact_dedup.digested(old)))
    assert {tuple(r) for r in exact_dedup.ingest(index, new).collect()} == {(10, 2), (12, 3)}
    hits = index.where("group_size > 1").select("key")
    assert exact_dedup.verify(old, hits, 1, memtable_bytes=1) == 1
    with pytest.raises(ValueError, match="different texts"):
        exact_dedup._same(b"k", b"a", b"b")
    with pytest.raises(ValueError, match="different texts"):
        list(exact_dedup._compared(iter([exact_dedup._batch([(b"k", b"a"), (b"k", b"b")], exact_dedup.BODY)])))


def shingles(text):
    low = (text or "").translate(near_dedup._LOWER)
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def want_near(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * either:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {(i, len(s), top(i), i == top(i)) for i, s in sets.items()}


def near_rows():
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "Été x y z w v"), (8, "été x y z w v")]
    for base in range(6):
        text = words(120).split()
        for k in range(8):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((100 + base * 10 + k, " ".join(copy)))
    long = words(20_000, 10**6)
    return rows + [(900, long), (901, long + " tail")] + [(1000 + i, words(40, 10**5)) for i in range(30)]


def test_near(spark):
    rows = near_rows()
    assert {tuple(r) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == want_near(rows)


def test_near_hot_group(spark):
    """A large group of copies with edits around the threshold: links only some of them."""
    text, rows = words(60).split(), []
    for i in range(300):
        copy = list(text)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {tuple(r) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want_near(rows)


def test_near_edges(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "y")], "doc_id bigint, text string, sig string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True)]
    assert near_dedup.keep(rows).columns == rows.columns and near_dedup.keep(rows).count() == 2


def test_near_keep_loses_no_text(spark):
    """A row that stays isn't lost with a dropped one of its doc_id; repeated copies go, whatever their number."""
    texts = {"a": words(30), "b": words(30)}
    rows = [(1, "a"), (1, "b"), (0, "b"), (3, "a"), (3, "a"), (0, "b")]
    kept = near_dedup.keep(docs(spark, [(i, texts[t]) for i, t in rows])).collect()
    assert sorted(tuple(r) for r in kept) == sorted([(1, texts["a"]), (0, texts["b"])])


def test_near_repeated_rows(spark):
    """Many repeats of two linked rows are two classes: nothing is squared."""
    text = words(60)
    rows = [(i % 2, text + " tail" * (i % 2)) for i in range(4000)]
    got = near_dedup.near_duplicates(docs(spark, rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(0, 0, True, 2000), (1, 0, False, 2000)}


@pytest.mark.parametrize("chain, block", [(5, 8), (2048, 1024)])
def test_near_split_buckets(spark, monkeypatch, chain, block):
    """Chains in salted parts and small blocks give the same as whole ones: families around the threshold."""
    monkeypatch.setattr(near_dedup, "CHAIN", chain)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = []
    for family in range(3):
        text = words(80).split()
        for i in range(70):
            copy = list(text)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
            rows.append((1000 * family + i, " ".join(copy)))
    assert {tuple(r) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == want_near(rows)


def test_bayes_bounds_share_the_miss():
    """Chance that a pair at the threshold is pruned in any batch, exactly: not above MISS."""
    from math import comb

    alive, n = {0: 1.0}, 0
    for bound in near_dedup.batch_bounds():
        step = near_dedup.BATCH
        n += step
        after: dict[int, float] = {}
        for m, p in alive.items():
            for k in range(step + 1):
                after[m + k] = after.get(m + k, 0.0) + p * comb(step, k) * 0.75**k * 0.25 ** (step - k)
        alive = {m: p for m, p in after.items() if m >= bound}
    assert n == near_dedup.VALUES and 1 - sum(alive.values()) <= near_dedup.MISS


def test_bayes_bounds():
    """A pair at the threshold survives all batches but with the miss probability, a distant one doesn't."""
    bounds, gen = near_dedup.batch_bounds(), np.random.RandomState(1)
    same = lambda p: np.where(gen.rand(20_000, near_dedup.VALUES) < p, 1, 0).astype("<u2")
    ones = np.ones((20_000, near_dedup.VALUES), dtype="<u2")
    assert near_dedup.survive(ones, same(0.75), bounds).mean() > 0.998 and near_dedup.survive(ones, same(0.3), bounds).mean() < 0.001
    assert bounds == sorted(bounds)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (1002, 1001), (7, 7), (2000, 150)]
    edges += [(5000, 6000 + i) for i in range(3000)] + [(9999, 6000 + 7 * i) for i in range(300)]  # a hub at either end
    with Scratch(spark) as scratch:
        got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), scratch).collect()}
        assert got == {(i, 0) for i in range(1, 201)} | {(2000, 0), (1001, 1000), (1002, 1000)} | {(i, 5000) for i in [*range(6000, 9000), 9999]}
        assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), scratch).count() == 0


def vectors():
    gen, rows = np.random.RandomState(4), []
    for c in range(20):
        base = gen.randn(24)
        for k in range(6):
            rows.append((c * 10 + k, (base + 0.25 * k / 5 * np.linalg.norm(base) * gen.randn(24) / 4).astype(np.float32).tolist()))
    rows += [(500, rows[0][1]), (501, (2 * np.array(rows[6][1], dtype=np.float32)).tolist())]
    return rows + [(600, None), (601, []), (602, [0.0] * 24), (603, [float("nan")] * 24), (604, [1.0] * 23 + [float("inf")]), (605, [1.0, None] + [0.0] * 22), (606, [1.0] * 23)]


def want_vectors(rows):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links, up = {i: set() for i, _ in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[a].add(b)
            links[b].add(a)
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return links, {i: top(i) for i in links}


def test_embeddings(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)).collect()}
    links, comps = want_vectors(rows)
    assert set(got) == set(links) and all(r["n_links"] <= len(links[i]) for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(map(len, links.values())) > 0
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(600, 607))
    assert sum(got[i]["component_id"] == c for i, c in comps.items()) >= 0.98 * len(comps)


@pytest.mark.parametrize("crowd, k", [(8, 2), (0.1, 3)])
def test_embeddings_recall(spark, crowd, k):
    """Planted pairs at cosines from 0.9 up, in a table whose codes have two and three hashes: recall by brute force."""
    gen = np.random.RandomState(9)
    base = gen.randn(2400, 16)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = gen.randn(600, 16)
    side -= (side * base[:600]).sum(axis=1, keepdims=True) * base[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = gen.uniform(0.9, 0.97, size=(600, 1))
    v = np.vstack([base, c * base[:600] + np.sqrt(1 - c * c) * side])
    assert embedding_dedup.plan(len(v), 16, crowd=crowd)[1] == k
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(rows, crowd=crowd).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * sum(want) >= 1100


def test_sketches_lose_no_pair():
    """Distances of pairs at the threshold stay within FAR."""
    gen = np.random.RandomState(2)
    x, z = gen.randn(20_000, 64), gen.randn(20_000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = embedding_dedup.sketches(x), embedding_dedup.sketches(0.9 * x + np.sqrt(0.19) * z)
    assert np.bitwise_count(a ^ b).sum(axis=1).max() <= embedding_dedup.far(0.9) < 48


def test_embeddings_hot_group(spark):
    gen = np.random.RandomState(5)
    base = gen.randn(16)
    rows = [(i, (base + 0.01 * gen.randn(16)).tolist()) for i in range(1300)] + [(2000 + i, base.tolist()) for i in range(50)] + [(3000, gen.randn(16).tolist())]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)).collect()}
    assert all(got[i] == (1349, 0, i == 0) for i in [*range(1300), *range(2000, 2050)]) and got[3000] == (0, 3000, True)


def test_embeddings_edges(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.0], "b")], "vec_id bigint, embedding array<float>, codes string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(rows).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_hadamard_keeps_lengths():
    x = np.random.RandomState(0).randn(7, 32)
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)
