"""What operators leave in a Python worker that Spark uses again."""

import gc
import time
import tracemalloc
import weakref

import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from weftgraph.llm import bpe, labelled, near_dedup, quality, toxicity


def signed(texts):
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([b""] * n), pa.array(texts, pa.string())], names=["doc_id", "tag", "text"])
    return [r for b in near_dedup._signed(5)(iter([batch])) for r in b.to_pylist()]


def test_another_kind_of_task_lets_the_encoder_go():
    """Tasks that encode share an encoder; it doesn't lie beside the next operator's memory."""
    source = bpe.vocabulary()
    held = weakref.ref(bpe.shared(source))
    assert bpe.shared(source) is held()
    signed(["one two three four five"])
    gc.collect()
    assert held() is None


def test_workers_keep_the_encoder_only_for_their_kind(spark):
    """In Spark's workers: the task function is pickled, what it lets go is the worker's own."""
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), "id").alias("text")).repartition(16)
    model = quality.train(["good text of some words"] * 5, ["bad | bad | bad"] * 5)

    def encoders(frames):
        import gc as own

        from weftgraph.llm import workers

        n = sum(len(f) for f in frames)
        time.sleep(0.05)
        yield pa.record_batch([pa.array([len(workers._left)]), pa.array([sum(type(o).__name__ == "WordBpe" for o in own.get_objects())])], names=["left", "encoders"]) if n else None

    def probed(after):
        return {tuple(r) for r in after.repartition(16).select("doc_id").mapInArrow(encoders, "left long, encoders long").collect()}

    assert bpe.encode_documents(docs).count() == 64
    assert docs.select(bpe.token_counter(docs)("text").alias("n")).agg(F.min("n")).first()[0] >= 3
    assert probed(docs) & {(1, 1)}  # a worker of either kind of task has one encoder, none has two
    for _ in range(3):
        assert len(docs.select(quality.scorer(docs, model)("text")).collect()) == 64
    found = probed(docs)
    assert (0, 0) in found and all(encoders <= 1 for _, encoders in found)


def test_texts_of_a_batch_are_not_all_objects_at_once():
    texts = ["a" * 50_000] * 400
    signed(texts[:1])
    tracemalloc.start()
    try:
        assert len(signed(texts)) == 400
        assert tracemalloc.get_traced_memory()[1] < 10 << 20  # of 20 MB
    finally:
        tracemalloc.stop()


def test_nulls_and_empty_batches_are_scored(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    for model, module in ((quality.train(["good text"] * 4, ["bad | bad"] * 4), quality), (toxicity.NOTHING, toxicity)):
        score = dict(docs.select("doc_id", module.scorer(docs, model)("text")).collect())
        assert score[1] == score[2] and all(0 <= s <= 1 for s in score.values())
        assert not docs.where("doc_id > 3").select(module.scorer(docs, model)("text")).collect()
    assert dict(docs.select("doc_id", bpe.token_counter(docs)("text")).collect()) == {1: 0, 2: 0, 3: 2}


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_samples_need_no_python_workers(spark, monkeypatch, kind):
    docs = spark.range(200).select(F.col("id").cast(kind).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(100).select(F.col("id").cast(kind).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))

    def refused(*_):
        raise AssertionError("rows are sent through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    texts = labelled.samples(docs, labels, "quality", {1: 10, 0: 1000})
    assert len(texts[1]) == 10 and 20 < len(texts[0]) <= 50 and not set(texts[1]) & set(texts[0])
    assert 50 < len(labelled.unlabelled(docs, labels, 1000)) < 100
    assert labelled._texts(docs, []) == []
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 0)
    assert labelled.unlabelled(docs, labels, 5) == []
