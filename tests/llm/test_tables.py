"""Sharding, packing, chats and the pipeline."""

import json
import random
import zlib
from itertools import accumulate, combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import bpe, chat, exact_dedup, near_dedup, packing, sharding

rng = random.Random(2)


def brute_capacity(sizes, shards):
    """Smallest largest run over all ways to cut."""
    best = sum(sizes)
    for k in range(min(shards, len(sizes))):
        for cut in combinations(range(1, len(sizes)), k):
            ends = [0, *cut, len(sizes)]
            best = min(best, max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:])))
    return best


def test_smallest_capacity():
    for _ in range(50):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))]
        assert sharding.smallest_capacity(sizes, 3) == brute_capacity(sizes, 3)


@pytest.mark.parametrize("n", [1, 5, 300, 5000])
def test_shards_are_minimax(spark, n):
    """Against the exact greedy over all groups in hash order."""
    rows = spark.createDataFrame([(i, "a" * rng.randrange(0, 300) + str(rng.randrange(n))) for i in range(n)] + [(10**6 + i, "hot") for i in range(n // 3)], "doc_id bigint, text string")
    got = sharding.shard_documents(rows).join(rows, "doc_id").withColumn("h", F.xxhash64("text")).toPandas()
    groups = got.groupby("h")["size"].sum().sort_index()
    assert got.groupby("shard")["size"].sum().max() == sharding.smallest_capacity([int(x) for x in groups], 8)
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shard_values(spark):
    rows = spark.createDataFrame([(1, "é", "x"), (2, None, "y"), (3, "", "y"), (3, "", "y")], "doc_id bigint, text string, shard string")
    got = sorted(tuple(r)[:4] for r in sharding.shard_documents(rows).collect())
    assert got == [(1, 3, zlib.crc32("é".encode()), "bytes"), (2, 1, 0, "bytes"), (3, 1, 0, "bytes"), (3, 1, 0, "bytes")]
    assert sharding.shard_documents(rows.limit(0)).count() == 0


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    chats = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string")
    for df in (sharding.shard_documents(docs), packing.pack(docs), chat.format_chats(chats)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_best_boundaries():
    for _ in range(40):
        lengths = sorted(rng.randrange(1, 40) for _ in range(rng.randrange(1, 12)))
        bins = sorted(set(lengths))
        counts, tokens = [lengths.count(b) for b in bins], [b * lengths.count(b) for b in bins]
        want = min(sum(min(e for e in ends if e >= x) - x for x in lengths) for k in range(3) for cut in combinations(bins[:-1], min(k, len(bins) - 1)) for ends in [[*cut, bins[-1]]])
        assert packing.best_boundaries(counts, tokens, bins, 3)[1] == want
    assert packing.best_boundaries([], [], [], 3) == ([], 0)


def test_boundaries_of_long_documents(spark):
    """Least padding over all distinct lengths, against the plain quadratic programme; long lengths that lie close."""
    for _ in range(5):
        lengths = sorted(rng.choice([1100, 3000, 5000, 90_000]) + rng.randrange(60) for _ in range(rng.randrange(150, 300)))
        upto, n = [0, *accumulate(lengths)], len(lengths)
        best = [0] + [10**18] * n
        for _ in range(6):
            best = [0] + [min(best[j], *(best[i] + lengths[j - 1] * (j - i) - upto[j] + upto[i] for i in range(j))) for j in range(1, n + 1)]
        docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n bigint")
        got = packing.pack(docs.withColumn("text", F.lit("")), length=F.col("n"), buckets=6).agg(F.sum("padding")).first()[0]
        assert got == best[-1]


def test_packing(spark):
    rows = [(i, " ".join("w" * rng.choice([1, 5, 9, 40, 300]))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bucket string")
    got = packing.pack(docs, buckets=4, budget=100).toPandas()
    assert len(got) == len(rows) and (got.padding >= 0).all() and (got.n_tokens + got.padding == got.pad_to).all()
    lengths = dict(zip(got.doc_id, got.n_tokens))
    assert all(lengths[i] == len((t or "").split()) for i, t in rows)
    for (_, _), part in got.groupby(["bucket", "batch"]):
        assert len(part) == 1 or len(part) * part.pad_to.iloc[0] <= 100
        assert sorted(part.place) == list(range(len(part)))
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_counts_tokens(spark):
    """Lengths are the encoder's tokens: of several a word, of text without blanks, and of none in blanks."""
    texts = ["unbelievably antidisestablishmentarian 12345", "qzxv" * 5000, "it's, ok!", " \n", None]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), buckets=2).collect()}
    coder = bpe.WordBpe(bpe.vocabulary())
    assert got == {i: len(coder.encode(t or "")) for i, t in enumerate(texts)}
    assert got[0] > 3 and got[1] > 5000 and got[3] == got[4] == 0


def test_chat_linking(spark):
    call = lambda *calls: json.dumps({"content": "ok", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    reply = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "search", {"limit": "z", "foo": 1}))), (1, 3, "tool", reply("a", "r1")), (1, 0, "tool", reply("b", "r2")), (1, 4, "tool", reply("zz", "r3")),
        (1, 5, "assistant", call(("a", "nope", "bad"), (None, "calculate", {"expression": {"b": 1, "a": [2, 1.5]}}))), (None, None, None, None), (2, 1, "assistant", "{broken"),
    ]
    got = chat.format_chats(spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["position"]) for r in got] == [(None, 0), *[(1, i) for i in range(10)], (2, 0)]
    assert [(r["kind"], r["call_id"], r["status"]) for r in got[1:11]] == [
        ("message", None, "plain"), ("message", None, "plain"), ("call", "a", "answered"), ("call", "b", "answered"), ("result", "b", "linked"), ("result", "a", "linked"), ("result", "zz", "orphan"), ("message", None, "plain"), ("call", "a", "repeated"), ("call", None, "unanswered"),
    ]
    errors = {(r["call_id"], r["turn"]): r["errors"] for r in got if r["kind"] == "call"}
    assert errors["a", 1] == [] and errors["b", 1] == ["foo: unexpected", "limit: not integer", "query: missing"] and errors["a", 5] == ["arguments: not an object"] and errors[None, 5] == ["expression: not string"]
    assert got[3]["json"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","type":"call"}'
    assert all(json.loads(r["json"]) for r in got) and got[-1]["json"] == '{"content":"{broken","role":"assistant","type":"message"}'


def test_chat_rows_without_keys(spark):
    """Calls without an identifier, and rows without a conversation, link with nothing, however many there are."""
    call = lambda i: json.dumps({"content": "x", "tool_calls": [{"id": i, "name": "search", "arguments": '{"query":"a"}'}]})
    rows = [(None, i, "assistant", call("a")) for i in range(40)] + [(None, i, "tool", json.dumps({"tool_call_id": "a", "content": "r"})) for i in range(40)] + [(1, i, "assistant", call(None)) for i in range(40)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {(r["kind"], r["status"], r["count"]) for r in got.groupBy("kind", "status").count().collect()} == {("message", "plain", 80), ("call", "unanswered", 80), ("result", "orphan", 40)}


def test_chat_edges(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chats(empty).count() == 0
    hot = spark.createDataFrame([(1 if i % 3 else i, i, "user", f"t{i}") for i in range(900)], "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = chat.format_chats(hot).where("conv_id = 1").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(got))) and [r["turn"] for r in got] == sorted(r["turn"] for r in got)


def test_pipeline(spark, tmp_path):
    """Stage by stage on a small corpus: what each drops is what its operator says, and planted cases go."""
    sounds = "ta re mi so lu ven dor kel par ish".split()
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 3)))
    text = lambda n=70: " ".join(word() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(900):
        kind = i % 10
        body = " ".join([word()] * 40) if kind == 0 else text() + " stupidhead " + text(10) if kind == 1 else text()
        rows.append((i, body))
        if (i // 10) % 2 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    clean = [t for i, t in rows if i % 10 > 1]
    rows += [(2000, clean[0]), (2001, clean[0].replace(" ", "  ")), (2002, clean[1] + " extra")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {k: sum(1 for i in out if i < 2000 and min(i % 10, 2) == k) for k in range(3)}
    assert left[0] <= 9 and left[1] <= 9 and left[2] >= 690, left
    first = next(i for i, t in rows if t == clean[0])
    assert len(out & {first, 2000, 2001}) == 1 and len(out & {next(i for i, t in rows if t == clean[1]), 2002}) == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for keep, decide in ((exact_dedup.keep, exact_dedup.exact_dedup), (near_dedup.keep, near_dedup.near_duplicates)):
        assert {r["doc_id"] for r in keep(docs).collect()} == {r["doc_id"] for r in decide(docs).where("kept").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
