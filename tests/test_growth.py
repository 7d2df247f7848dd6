"""What moves between tasks: no bytes of blocks but once, and every table once."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blocks, maintenance, writes
from palimpsest.plans.queries import QUERIES
from palimpsest.plans.store import Store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def separately(refs, objects, stored, candidates):
    status = {r.status: r["count"] for r in maintenance.candidate_report(candidates, objects, refs).groupBy("status").count().collect()}
    return {
        "missing_object": maintenance.missing_objects(refs, objects).count(), "refcount": maintenance.refcount_drift(refs, objects, stored).count(),
        "length": maintenance.length_conflicts(refs, objects).count(), "orphan": maintenance.orphans(refs, objects, stored).count(),
        "stale_candidate": status.get("stale", 0), "dangling_candidate": status.get("dangling", 0),
    }


@pytest.mark.parametrize("n", [0, 12])
def test_verify_counts_as_its_parts_do_in_one_pass(spark, n):
    rng = random.Random(n)
    some = lambda *of: rng.choice((None, *of))
    tables = (
        spark.createDataFrame([(some(*range(9)), 0, some(5, 5, 6)) for _ in range(2 * n)], "object_id long, begin long, stop long"),
        spark.createDataFrame([(some(*range(9)), some("a", "a", "b"), some(5, 5, 6)) for _ in range(n)], "object_id long, digest string, raw_len int"),
        spark.createDataFrame([(some(*range(9)), some(1, 2, 3)) for _ in range(n)], "object_id long, refs long"),
        spark.createDataFrame([(some("a", "a", "b"), some(5, 5, 6), some(*range(9))) for _ in range(n)], "digest string, raw_len int, object_id long"),
    )
    report = maintenance.verify(*tables)
    assert {r.problem: r.n for r in report.collect()} == separately(*tables)
    assert plan(report).count("LogicalRDD") + plan(report).count("LocalRelation") == 4


def test_verify_reads_documents_for_references_and_counts_alone(spark, sf_dir):
    assert plan(QUERIES["kv_verify"](spark, sf_dir)).count("- Relation [") == 2


def test_objects_are_numbered_without_their_bytes(spark, sf_dir):
    optimized = plan(QUERIES["kv_counter_check"](spark, sf_dir))
    assert "InMemoryRelation" in optimized and "block#" not in optimized.split("InMemoryRelation")[1].splitlines()[0]
    assert "Window" not in optimized


def test_blocks_to_encode_are_not_numbered(spark, sf_dir):
    optimized = plan(QUERIES["kv_codec_choice"](spark, sf_dir))
    assert "InMemoryRelation" not in optimized and "Join" not in optimized and optimized.count("Aggregate") == 2


@pytest.mark.parametrize("digits", [64, 1])
def test_equal_digests_do_not_make_blocks_equal(spark, monkeypatch, digits):
    monkeypatch.setattr(blocks, "digest", lambda block: F.substring(F.sha2(block, 256), 1, digits))
    values = spark.createDataFrame([(f"{k:03d}", bytes([k % 40, 1]) * 5 + b"same") for k in range(60)], "key string, value binary")
    cut = blocks.split(values, 10)
    assert blocks.collide(cut) == (digits == 1)
    refs, objects = blocks.dedupe(cut)
    assert blocks.reassemble(refs, objects).select("key", "value").exceptAll(values).isEmpty() and refs.count() == 120
    assert sorted(r.object_id for r in objects.collect()) == list(range(1, 42))
    more = blocks.split(values.where("key < '005'").unionByName(spark.createDataFrame([("x", b"new")], "key string, value binary")), 10)
    again, new = blocks.dedupe(more, objects, 41)
    assert [(r.object_id, bytes(r.block)) for r in new.collect()] == [(42, b"new")]
    assert sorted(r.object_id for r in again.collect()) == [1, 2, 2, 2, 2, 2, 3, 4, 5, 6, 42]


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_unconditional_operations_fold_as_columns(spark, monkeypatch, batch):
    rng = random.Random(batch)
    keys = ["a", "b", "c", "d", None]
    rows = [(k, rng.choice(keys), rng.choice(("put", "delete")), "absent" if k % 23 == 9 else rng.choice(("any", None)), str(k)) for k in range(200)]
    state = {"a": 7, "c": 9}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        ops = spark.createDataFrame(rows, "ord long, key string, op string, expect string, value string")
        got = {r.ord: (r.key, r.op, r.value, r.status, r.actual, r.touched) for r in writes.fold(ops, spark.createDataFrame(list(state.items()), "key string, revision long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    live, by = dict.fromkeys(state, True), {}
    for k, key, op, expect, value in rows:
        there = live.get(key, False)
        seen = (state.get(key), by.get(key)) if there else (None, None)
        status = "conflict" if expect == "absent" and there else "noop" if op == "delete" and not there else "ok"
        if status == "ok":
            live[key], by[key] = op == "put", k
        assert got[k] == (key, op, value, status, *seen)


def test_a_batch_is_folded_once(spark):
    passes = spark.sparkContext.accumulator(0)
    fold = writes.fold

    def counted(ops, state):
        out = fold(ops, state)

        def run(batches):
            for one in batches:
                passes.add(len(one))
                yield one

        return out.mapInArrow(run, out.schema)

    ops = spark.range(50).select(F.col("id").alias("ord"), (F.col("id") % 7).cast("string").alias("key"), F.lit("put").alias("op"))
    held = []
    writes.fold = counted
    try:
        out = writes.write_batch_each(ops, spark.createDataFrame([], "key string, revision long"), held=held)
        assert sorted(r.revision for r in out.collect()) == list(range(1, 51)) and passes.value == 50
    finally:
        writes.fold = fold
        for rows in held:
            rows.unpersist()


def test_values_without_blocks_need_no_joins(spark, tmp_path):
    one = Store(spark, str(tmp_path / "store"))
    one.put(b"k", b"v")
    assert "Join" not in plan(one.revisions()) and [bytes(r.value) for r in one.revisions().collect()] == [b"v"]
