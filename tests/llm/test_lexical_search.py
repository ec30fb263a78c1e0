"""Ranked search: every score by brute force, what the blocks hold and skip, and the edge cases of the docstring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import lexical_search as ls

rng = random.Random(12)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=50):
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(UPPER))) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def sentence(n, k=300):
    return " ".join(rng.choice(["Wort", "mot", "É", "ß", "x9"]) + str(int(k * rng.random() ** 3)) for _ in range(n))


def corpus(n):
    rows = [(i, sentence(rng.randrange(1, 80)) + rng.choice([".", "\n", " - ok"])) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(70)]  # ties beyond the last rank
    rows += [(n + 100, None), (n + 101, ""), (n + 102, " .;\x7f"), (None, rows[5][1]), (7, rows[5][1]), (7, rows[5][1]), (n + 103, "Wort1 " * 70_000 + "rare"), (n + 104, "MOT1 é É a\x80b ١")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes,held_terms", [(1 << 24, 1 << 16), (3000, 40)])
def test_against_all_scores(spark, shard_bytes, held_terms):
    docs = corpus(700)
    items = [(i, sentence(rng.randrange(1, 30))) for i in range(25)] + [(100, docs[10][1]), (101, None), (102, "nothing here"), (103, "Mot1 é É a\x80b"), (None, "wort1 RARE"), (103, "mot2"), (103, "mot2")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(*i, 5) for i in items], "item_id int, text string, doc_id int")
    got = ls.rank_documents(d, q, shard_bytes=shard_bytes, held_terms=held_terms)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["item_id int", "rank int", "doc_id bigint", "score bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty(spark):
    docs, items = spark.createDataFrame(corpus(20), "doc_id bigint, text string"), spark.createDataFrame([(1, "mot1")], "item_id bigint, text string")
    assert ls.rank_documents(docs.limit(0), items).count() == ls.rank_documents(docs, items.limit(0)).count() == ls.rank_documents(docs.limit(0), items.limit(0)).count() == 0


def test_blocks_are_packed_and_skipped():
    """A shard gives back its postings, and blocks below the threshold stay packed."""
    texts = [[b"common"] * rng.randrange(1, 4) + [b"pad"] * rng.randrange(300) for _ in range(3000)]
    for i in range(900, 960):
        texts[i] = [b"common"] * 400 + [b"rare"]
    n, total = len(texts), sum(map(len, texts))
    shard = ls.Shard()
    for i in rng.sample(range(n), n):
        shard.add(i, " ".join(t.decode() for t in texts[i]))
    arrays_row = shard.row(n, total)
    arrays, places = ls._arrays(arrays_row), {t: k for k, t in enumerate(arrays_row["terms"].split(b"\n"))}
    common = ls.Postings(arrays, places[b"common"], ls.weight(n, n))
    blocks = range(len(common.last))
    assert len(blocks) == -(-n // ls.BLOCK)
    assert np.concatenate([common.documents(b) for b in blocks]).tolist() == list(range(n))
    assert np.concatenate([common.counts(b) for b in blocks]).tolist() == [t.count(b"common") for t in texts]
    best = ls.Best(50)
    lists = [ls.Postings(arrays, places[b"common"], 3), ls.Postings(arrays, places[b"rare"], 4000)]
    unpacked = ls.search_shard(lists, arrays, best, n, total)
    assert len(best.rows) == 50 and all(900 <= i < 960 for _, _, i in best.rows) and unpacked < len(blocks)
