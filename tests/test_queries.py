"""Every registered query of the store against its SQL."""

import pytest

from palimpsest.functions import generators
from palimpsest.plans import store
from palimpsest.plans.queries import ORACLE_SQL, QUERIES

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_greedy_batches(spark, sf_dir):
    got = {(r.queue, r.ord): r.batch for r in QUERIES["kv_greedy_batches"](spark, sf_dir).collect()}
    rows = sorted((r.conv_id, r.turn, len((r.text or "").encode())) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    queue, batch, ops, size, open_ = None, 0, 0, 0, False
    for c, t, n in rows:
        if c != queue:
            queue, batch, ops, size, open_ = c, 0, 0, 0, True
        elif not open_ or ops + 1 > 3 or size + n > 2000:
            batch, ops, size, open_ = batch + 1, 0, 0, True
        ops, size = ops + 1, size + n
        open_ = t != 4
        assert got[c, t] == batch


def test_cas_chain_over_all_mutations(spark, sf_dir):
    got = {r.ord: (r.key, r.status) for r in QUERIES["kv_cas_chain_whole"](spark, sf_dir).collect()}
    held, before, want = {}, {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").collect()):
        i, u = r
        ok = u not in before or i % 7 == 0 or (i % 5 != 0 and held[u] == before[u])
        want[i] = (f"user/{u:08d}", "ok" if ok else "conflict")
        before[u] = i
        if ok:
            held[u] = i
    assert got == want
    assert len(want) > 2 * len(before) and {s for _, s in want.values()} == {"ok", "conflict"}


def test_valid_prefix_grows_with_the_log(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert QUERIES["kv_wal_valid_prefix_half"](spark, sf_dir).count() == n // 2 - 1 > 49


def test_queries_call_the_operators_they_stand_for(spark, sf_dir, monkeypatch):
    broken = generators.Generator("arith_u64", 1, 1, generators.BUILTIN[0].length, lambda p, offset, n: bytes(n))
    monkeypatch.setattr(generators, "BUILTIN", (broken, *generators.BUILTIN[1:]))
    assert {r.value for r in QUERIES["kv_generate_arith"](spark, sf_dir).collect()} == {0}
    monkeypatch.setattr(store, "source_ids", lambda rows: rows.limit(0))
    assert QUERIES["kv_import_sources"](spark, sf_dir).count() == 0


def test_codecs_over_documents(spark, sf_dir):
    done = QUERIES["kv_codec_roundtrip"](spark, sf_dir).collect()
    assert done and all(r.units == r.exact and r.problems == 0 for r in done)
    chosen = {r.dataset: r.codec for r in QUERIES["kv_dataset_codecs"](spark, sf_dir).collect()}
    assert chosen["repetitive"] == "repeat" and chosen["sequences"] == "arith" and chosen["entropy"] == chosen["compressed"] == chosen["duplicates"] == "raw"
    assert all(r.range_ok for r in QUERIES["kv_generated"](spark, sf_dir).collect())
