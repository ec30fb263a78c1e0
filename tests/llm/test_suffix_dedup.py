"""Suffix-array dedup: every string of 50 bytes by brute force, the sorters alone, and the edge cases of the docstring."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffix_dedup as sd

rng = random.Random(11)
DOCS = "doc_id bigint, text string"


def brute(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    bodies = [(key(i), (t or "").encode()) for i, t in rows]
    for at, b in bodies:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], at), at)
    out = []
    for (i, _), (at, b) in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < at:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def words(n, k=2000):
    return " ".join(f"w{rng.randrange(k)}é" for _ in range(n))


def corpus():
    shared = [words(rng.randrange(8, 60)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [words(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(20) :], words(rng.randrange(0, 9))]
        rows.append((rng.randrange(10**6), rng.choice(["", " ", "\n"]).join(parts)))
    near = words(90)
    rows += [(2 * 10**6 + i, near.replace(f"w{i}", "new") + f" end {i}") for i in range(40)]
    rows += [(3 * 10**6 + i, shared[0] + words(3)) for i in range(60)]  # a hot passage
    rows += [(7, "copied " * 20), (4, "copied " * 20), (9, "a" * 3000 + "b" * 60), (11, "c" + "a" * 500), (3, "a" * 49), (5, None), (6, ""), (8, "x" * 50), (10, "x" * 50)]
    rows += [(12, words(3000)), (None, shared[1] + " " + shared[2]), (None, shared[1]), (13, "copied " * 20 + "more"), (12, shared[3]), (12, shared[3] + words(5))]
    return rows


@pytest.mark.parametrize("bucket_bytes,heavy", [(1 << 12, 1000), (1 << 24, 1000), (1 << 13, 3000000), (1 << 13, 200)])
def test_against_all_strings(spark, bucket_bytes, heavy):
    """With many and few buckets, and with nearly all anchors or none taken as hot."""
    rows = corpus()
    got = sd.suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), bucket_bytes=bucket_bytes, heavy=heavy)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_small_flushes(spark, monkeypatch):
    """Tasks that deal out after each text."""
    rows = corpus()[:120]
    docs = spark.createDataFrame(rows, DOCS)
    texts = sd._texts(docs, "doc_id", "text")
    open_ = texts.mapInArrow(sd.anchors_of(3, held_bytes=1), sd.ANCHORS_DDL).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sd.open_anchors, sd.OPEN_DDL)
    held = {}
    for i, t in rows:
        for a in sd.stretches((t or "").encode())[0].tolist():
            held.setdefault(a & int(sd._LOW), set()).add((i, t))
    want = {a for a, texts_ in held.items() if len(texts_) > 1}
    assert {r["anchor"] for r in open_.collect()} == want


def test_edges(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "t" * 60, "z", 0), (1, "t" * 60, "y", 1), (2, "t" * 60 + "u", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string, at int")
    assert sorted((tuple(r) for r in sd.suffix_dedup(docs).collect()), key=str) == brute([r[:2] for r in rows])


def test_hot_copies(spark):
    rows = [(i, "same text of a page that is long enough to be cut, and so it is cut" if i % 3 else f"own {i} " * 12) for i in range(1500)]
    got = sd.suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_stretches():
    """Each string lies in one stretch, and equal strings have equal anchors."""
    body = (words(200) + "z" * 300 + words(50)).encode()
    anchors, starts, counts = sd.stretches(body + body)
    assert counts.sum() == 2 * len(body) - 49 and counts.max() <= sd.STRINGS and (starts == np.cumsum(counts) - counts).all()
    of = np.repeat(anchors, counts)
    seen = {}
    for p, a in enumerate(of.tolist()):
        assert seen.setdefault((body + body)[p : p + 50], a) == a


def test_multikey_groups():
    for _ in range(20):
        text = bytes(rng.choice(b"ab") for _ in range(400)) + b"b" * 100
        places = np.arange(420)
        groups = np.array([0, 100, 101, 300])
        padded = text + bytes(24)
        w = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,)).astype(np.uint64)
        found, sizes = sd.multikey_groups(w, places, groups)
        got, begin = set(), 0
        for n in sizes.tolist():
            got.add(frozenset(found[begin : begin + n].tolist()))
            begin += n
        want = {}
        for p in places.tolist():
            want.setdefault((int(np.searchsorted(groups, p, side="right")), text[p : p + 24].ljust(24, b"\0")), set()).add(p)
        assert got == {frozenset(x) for x in want.values() if len(x) > 1}


def test_blind_trie():
    for _ in range(50):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(60, 300)))
        trie, leaf = sd.BlindTrie(text, 6), {}
        for p in rng.sample(range(len(text) - 6), len(text) - 6):
            assert leaf.setdefault(text[p : p + 6], trie.add(p)[0]) == trie.add(p)[0]
        assert len(set(leaf.values())) == len(leaf)
