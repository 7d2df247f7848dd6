"""What executors hold: heap that no stage needs any more goes back to the system."""

import gc

import corpus_pipeline
import pytest
from palimpsest.llm import minhash, shared


def garbage(spark):
    """A weak reference to an object of the JVM that nothing else holds: a collection clears it."""
    held = spark._jvm.java.util.ArrayList()
    weak = spark._jvm.java.lang.ref.WeakReference(held)
    del held
    gc.collect()
    return weak


def test_cut_gives_the_heap_back(spark, monkeypatch):
    monkeypatch.setattr(shared, "RELEASE_EVERY", 0.0)
    weak = garbage(spark)
    out = shared.cut(spark.range(10), "ten")
    assert weak.get() is None
    assert sorted(r.id for r in out.collect()) == list(range(10))


def test_cut_gives_the_heap_back_now_and_then(spark, monkeypatch):
    shared.release_heaps(spark)
    monkeypatch.setattr(shared, "RELEASE_EVERY", 1e6)
    at = shared._released[spark.sparkContext.applicationId]
    shared.cut(spark.range(10), "ten")
    assert shared._released[spark.sparkContext.applicationId] == at


@pytest.mark.parametrize("name", ["mix_sources", "packing"])
def test_stages_without_a_cut_begin_with_the_heap_given_back(spark, name):
    docs = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    shared.release_heaps(spark)
    at = shared._released[spark.sparkContext.applicationId]
    dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert shared._released[spark.sparkContext.applicationId] > at


def test_near_dedup_gives_the_heap_back_between_its_tables(spark, monkeypatch):
    monkeypatch.setattr(shared, "RELEASE_EVERY", 0.0)
    shared.release_heaps(spark)
    at = shared._released[spark.sparkContext.applicationId]
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_dedup(docs).collect()) == [(1, 1, 2, True), (2, 1, 2, False)]
    assert shared._released[spark.sparkContext.applicationId] > at
