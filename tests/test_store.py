"""The store against a dictionary, and its commits, streams and repairs."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.errors import IntegrityError, InvalidArgument, LimitExceeded, RevisionConflict
from palimpsest.functions import generators
from palimpsest.functions.keys import excluded, included
from palimpsest.operators import maintenance, writes
from palimpsest.operators.chat import Chat
from palimpsest.plans.store import Store
from palimpsest.streaming.ingest import commit_stream, recent_pages

SMALL = Config(block_size=512, inline_max=64, keep_history=True)
POOL = [b"a", b"a/0", b"a/1", b"ab", b"b/0", b"\0", b"\0\1", b"\xff", b"k \0 k"]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


@pytest.mark.parametrize("history", [True, False])
def test_batches_against_a_dictionary(spark, path, history):
    rng = random.Random(11)
    store = Store(spark, path, Config(block_size=512, inline_max=64, keep_history=history))
    model, revision = {}, 0
    for _ in range(5):
        ops, want = [], []
        for _ in range(12):
            key = rng.choice(POOL)
            live = key in model
            if rng.random() < 0.3:
                ops.append(("delete", key))
                want.append("ok" if live else "noop")
                if live:
                    revision += history
                    del model[key]
                continue
            value = rng.choice([b"", b"v" * rng.randrange(70), bytes(rng.randrange(256) for _ in range(rng.choice([65, 512, 513, 1500])))])
            expect = rng.choice([None, None, ("absent", None), ("revision", rng.randint(1, revision + 1))])
            met = expect is None or (expect[0] == "absent" and not live) or (expect[0] == "revision" and live and model[key][0] == expect[1] and model[key][2] < len(want) - 99)
            if expect and expect[0] == "revision":
                old = live and model[key][2] == -1
                met = old and model[key][0] == expect[1]
            ops.append(("put", key, value, expect))
            want.append("ok" if met else "conflict")
            if met:
                revision += 1
                model[key] = (revision, value, 0)
        assert store.write_batch_each(ops) == want
        model = {k: (r, v, -1) for k, (r, v, _) in model.items()}
        got = {bytes(r.key): (r.revision, bytes(r.value)) for r in store.scan().collect()}
        assert got == {k: v[:2] for k, v in model.items()}
    for start, end in ((b"a", b"b"), (b"a/0", b"ab")):
        got = [bytes(r.key) for r in store.scan(included(start), excluded(end), reverse=True, limit=2, with_values=False).collect()]
        assert got == sorted((k for k in model if start <= k < end), reverse=True)[:2]
    for k in POOL:
        assert store.get(k) == (model[k][1] if k in model else None)
        assert store.head(k) == ((model[k][0], len(model[k][1])) if k in model else None)
    assert maintenance.is_ok(store.verify())
    store.gc()
    store.compact()
    assert {bytes(r.key): bytes(r.value) for r in store.scan().collect()} == {k: v[1] for k, v in model.items()}


def test_single_operations_history_and_ranges(spark, path):
    store = Store(spark, path, SMALL)
    big = bytes(range(256)) * 8
    first = store.put(b"k", big)
    second = store.put(b"k", b"small", "revision", first)
    with pytest.raises(RevisionConflict):
        store.put(b"k", b"x", "absent")
    with pytest.raises(RevisionConflict):
        store.write_batch([("put", b"new", b"1"), ("put", b"k", b"2", ("revision", first))])
    assert store.get(b"new") is None and store.get(b"k") == b"small" and store.get_at(b"k", first) == big and store.get_at(b"k", 99) is None
    assert store.delete(b"k") and not store.delete(b"k") and store.get(b"k") is None
    assert [(r.revision, r.kind, r.is_current) for r in store.history(b"k").collect()] == [(first, "chunks", False), (second, "inline", False), (second + 1, "tombstone", True)]
    assert store.prune_history(1, b"k") == 1 and store.get_at(b"k", first) is None
    third = store.put(b"k", big[:2000])
    assert third == second + 2
    for a, n in ((0, 10), (500, 30), (511, 2), (1990, 100), (2000, 5), (0, 0)):
        assert store.get_range(b"k", a, n) == big[:2000][a : a + n]
    with pytest.raises(InvalidArgument):
        store.get_range(b"k", 2001, 1)
    with pytest.raises(InvalidArgument):
        store.put(b"", b"x")
    with pytest.raises(LimitExceeded):
        store.put(b"o" * 4097, b"x")
    assert store.write_batch([("put", b"z", b"1"), ("delete", b"z"), ("delete", b"none")]) == [third + 1, third + 1, None]
    params = generators.repeat_params(5000, b"motif ")
    made = store.put_generated(b"g", 3, 1, params)
    assert store.get(b"g") == (b"motif " * 900)[:5000] and store.get_range(b"g", 7, 6) == (b"motif " * 3)[7:13] and store.head(b"g") == (made, 5000)
    assert Store(spark, path, Config()).config.block_size == 512


def test_one_of_two_writers_wins(spark, path):
    store = Store(spark, path, SMALL)
    won = []

    def write(n):
        try:
            won.append(Store(spark, path).put(b"only", b"%d" % n, "absent"))
        except RevisionConflict:
            pass

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and store.head(b"only")[0] == 1


def test_shared_blocks_lost_blocks_and_garbage(spark, path):
    store = Store(spark, path, SMALL)
    same = bytes(512) + b"tail" * 30
    store.write_batch([("put", b"a", same), ("put", b"b", same), ("put", b"c", same + b"!")])
    store.put(b"d", same)
    assert store.table("objects").count() == 3
    base = store._commit()
    assert store._rewrite({"objects": store.table("objects").where("raw_len <> 512")}, base)
    with pytest.raises(Exception, match="IntegrityError"):
        store.get(b"a")
    assert not maintenance.is_ok(store.verify())
    with pytest.raises(IntegrityError):
        maintenance.collect_garbage(store.refs(), store.table("objects"), store.table("objects"), undecodable=1)


def test_sources_and_imports(spark, path, tmp_path):
    store = Store(spark, path, SMALL)
    raw = bytes(range(256)) * 5 + b"\r\n\xff\xfe"
    (tmp_path / "f.bin").write_bytes(raw)
    first = store._commit()["id"]
    store.import_file(b"in/f.bin", str(tmp_path / "f.bin"))
    assert store._commit()["id"] == first + 1 and store.get(b"in/f.bin") == raw
    one = store.sources().collect()
    assert len(one) == 1 and one[0].bytes == len(raw) and store.register_source("file", one[0].location) == one[0].source_id
    assert store.register_source("url", "x") == one[0].source_id + 1
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "f.bin").write_bytes(b"other" * 50)
    with pytest.raises(RevisionConflict):
        store.import_file(b"in/f.bin", str(tmp_path / "g" / "f.bin"), "absent")
    before = {t: sorted(p.name for p in (tmp_path / "store" / t).iterdir()) for t in ("log", "objects", "sources")}
    with pytest.raises(Exception, match="No such file|FileNotFound|does not exist"):
        store.import_file(b"lost", str(tmp_path / "none"))
    publish, store._publish = store._publish, lambda *_: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError):
        store.import_file(b"lost", str(tmp_path / "g" / "f.bin"))
    store._publish = publish
    assert before == {t: sorted(p.name for p in (tmp_path / "store" / t).iterdir()) for t in before}  # nothing of it is left
    store.import_files({b"g/f.bin": str(tmp_path / "g" / "f.bin")})
    assert store.get(b"g/f.bin") == b"other" * 50 and store.get(b"in/f.bin") == raw and maintenance.is_ok(store.verify(deep=True))


def test_without_history_replaced_and_deleted_values_are_gone(spark, path):
    store = Store(spark, path, Config(block_size=512, inline_max=64))
    first = store.put(b"k", bytes(range(256)) * 4)
    store.put(b"k", b"v2")
    assert store.get_at(b"k", first) is None and store.get_at(b"k", first + 1) == b"v2"
    assert store.gc() == 1 and store.table("objects").count() == 0
    store.put(b"d", bytes(range(256)) * 4)
    assert store.delete(b"d") and store.get_at(b"d", first + 2) is None and store.history(b"d").count() == 0 and store.gc() == 1
    assert store.stats().first().records == 1
    kept = Store(spark, path, Config(keep_history=True))
    kept.put(b"k", b"v3")
    assert kept.get_at(b"k", first + 1) == b"v2" and kept.get_at(b"k", first) is None
    store.compact()
    assert kept.get_at(b"k", first + 1) == b"v2"
    store.delete(b"k")
    for _ in range(2):
        assert store.get(b"k") is None and [(r.revision, r.is_current) for r in store.history(b"k").collect()] == [(first + 1, False)]
        store.compact()
    report = store.vacuum(0)
    assert report["files"] > 5 and report["after"] < report["before"] and len(store._ids()) == 1 and store.get_at(b"k", first + 1) == b"v2"
    assert store.prune_history(0) == 1 and store.history(b"k").count() == 0


def test_generated_records_in_scans_and_verification(spark, path):
    store = Store(spark, path, Config(block_size=512, inline_max=64))
    one = store.put_generated(b"g", 3, 1, generators.repeat_params(10, b"ab"), "absent")
    with pytest.raises(RevisionConflict):
        store.put_generated(b"g", 3, 1, generators.repeat_params(10, b"cd"), "absent")
    store.put_generated(b"h", 1, 1, generators.arith_params(1, 2, 3), "any")
    store.put_generated(b"g", 3, 1, generators.repeat_params(6, b"xyz"), "revision", one)
    store.put(b"p", b"plain")
    assert [(bytes(r.key), bytes(r.value)) for r in store.scan().collect()] == [(b"g", b"xyzxyz"), (b"h", b"".join(n.to_bytes(8, "little") for n in (1, 3, 5))), (b"p", b"plain")]
    assert maintenance.is_ok(store.verify(deep=True))
    assert store._rewrite({"log": store.table("log").withColumn("value", F.when(F.col("key") == F.lit(b"h"), F.lit(bytes(32))).otherwise(F.col("value")))}, store._commit())
    assert maintenance.is_ok(store.verify()) and not maintenance.is_ok(store.verify(deep=True))


def test_prepared_operations(spark, path):
    store = Store(spark, path, SMALL)
    big = bytes(range(256)) * 5
    ready = store.prepare([("put", b"a", big), ("put", b"", b"x"), ("put", b"a", b"y", ("absent", None)), ("delete", b"none")])
    assert store.get(b"a") is None
    assert store.write_prepared_each(ready) == {0: "ok", 1: "invalid", 2: "conflict", 3: "noop"} and store.get(b"a") == big
    with pytest.raises(InvalidArgument):
        Store(spark, path + "-other", SMALL).write_prepared_each(ready)


def test_sharded_store(spark, path):
    from palimpsest.errors import Unsupported
    from palimpsest.operators.routing import CustomRouter, Router
    from palimpsest.plans.sharded import ShardedStore

    store = ShardedStore(spark, path, 3, Router(2, "/"), SMALL)
    keys = [b"ch/%d/%d" % (c, m) for c in range(4) for m in range(2)]
    assert len(store.write_batch([("put", k, k * 20) for k in keys])) == 8 and len({store.router.shard_of_key(k, 3) for k in keys}) > 1
    assert store.write_batch_each([("put", keys[0], b"x", ("absent", None)), ("delete", keys[7])]) == ["conflict", "ok"]
    assert store.get(keys[3]) == keys[3] * 20 and store.get(keys[7]) is None and store.head(keys[0])[1] == len(keys[0]) * 20
    assert [bytes(r.key) for r in store.scan().collect()] == keys[:7]
    assert [bytes(r.key) for r in store.scan(reverse=True, limit=3).collect()] == keys[6:3:-1]
    assert len(store.route(included(b"ch/1/"), excluded(b"ch/10"))) == 1 and [bytes(r.key) for r in store.scan_prefix(b"ch/1/").collect()] == keys[2:4]
    assert {r.shard: r.records for r in store.stats().collect()}[None] == 7 and maintenance.is_ok(store.verify())
    for shards, router in ((4, Router(2, "/")), (3, Router(2)), (3, CustomRouter("length", len))):
        with pytest.raises(Unsupported):
            ShardedStore(spark, path, shards, router)


def test_chat(spark, path):
    chat = Chat(Store(spark, path, SMALL))
    ids = [chat.send(7, b"m%d" % k, 1500000000000) for k in range(3)]
    chat.send(8, b"other", 1500000000000)
    assert chat.latest(7, 2) == [(ids[2], b"m2"), (ids[1], b"m1")] and chat.latest(7, 0) == []
    assert chat.before(7, ids[2], 5) == [(ids[1], b"m1"), (ids[0], b"m0")]
    assert chat.edit(7, ids[0], b"new") and chat.get(7, ids[0]) == b"new" and not chat.edit(7, 5, b"x")
    assert chat.delete(7, ids[0]) and len(chat.latest(7, 9)) == 2


def test_streams_commit_once_and_keep_pages(spark, path, sf_dir, tmp_path):
    from palimpsest.operators.log import current
    from palimpsest.sources import fixtures

    ops = fixtures.mutations(spark, sf_dir).select("ord", F.encode("key", "UTF-8").alias("key"), "op", F.encode("value", "UTF-8").alias("value"))
    for k in range(3):
        ops.where(F.floor(F.col("ord") / 400) == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    store = Store(spark, path, SMALL)
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    commit_stream(stream, store, str(tmp_path / "check")).awaitTermination(120)
    want = {r.key: r.value for r in current(fixtures.event_log(spark, sf_dir)).collect()}
    assert {bytes(r.key).decode(): bytes(r.value).decode() for r in store.scan().collect()} == want
    assert store.write(ops.limit(1).withColumn("expect", F.lit("any")).withColumn("expect_revision", F.lit(None).cast("long")), atomic=False, tag="ingest:0") is None

    rows = fixtures.messages(spark, sf_dir).select("channel", "id", F.encode("payload", "UTF-8").alias("payload"))
    rows.where("id < 2").coalesce(1).write.parquet(str(tmp_path / "chat"))
    rows.where("id >= 2").coalesce(1).write.parquet(str(tmp_path / "chat"), mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chat"))
    q = recent_pages(stream, 2).writeStream.format("memory").queryName("pages").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("pages").collect():
        got.setdefault(r.channel, set()).add(r.id)
    last = {}
    for r in rows.select("channel", "id").collect():
        last.setdefault(r.channel, []).append(r.id)
    assert all(set(sorted(v)[-2:]) <= got[c] for c, v in last.items())


def test_numbering_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("o")).repartition(7)
    got = sorted((r.o, r.n) for r in writes.numbered(rows, "o", "n", 10).collect())
    assert [n for _, n in got] == list(range(11, 1011))
    assert writes.numbered(rows.limit(0), "o", "n").count() == 0


def test_codecs_dictionaries_and_deep_verification(spark, path):
    from palimpsest.errors import Unsupported
    from palimpsest.plans.training import AutoDictionary

    store = Store(spark, path, Config(block_size=1024, inline_max=64))
    values = [b'{"id":%06d,"name":"somebody","text":"%s"}' % (i, b"common words of all " * (2 + i % 5)) for i in range(400)]
    store.write_batch([("put", b"v%04d" % i, v) for i, v in enumerate(values[:40])])
    trained = store.train("zstd_dict", uses=100_000)
    assert trained.status in ("installed", "failed", "rejected")
    auto = AutoDictionary(store, target=200)
    for v in values:
        auto.observe(v)
    assert auto.status in ("installed", "superseded", "rejected", "failed")
    store.write_batch([("put", b"w%04d" % i, v) for i, v in enumerate(values[40:80])])
    used = {r.codec: r for r in store.usage().collect()}
    assert set(used) - {"raw"} and sum(r.body_bytes for r in used.values()) < sum(r.raw_bytes for r in used.values())
    assert {bytes(r.key): bytes(r.value) for r in store.scan().collect()} == {(b"v%04d" if i < 40 else b"w%04d") % (i if i < 40 else i - 40): v for i, v in enumerate(values[:80])}
    assert maintenance.is_ok(store.verify(deep=True))
    base = store._commit()
    store._rewrite({"objects": store.table("objects").withColumn("body", F.when(F.col("object_id") == 1, F.lit(b"bad")).otherwise(F.col("body")))}, base)
    assert not maintenance.is_ok(store.verify(deep=True))
    with pytest.raises(Exception, match="IntegrityError"):
        store.get(b"v0000")
    pure = Store(spark, path + "-pure", Config(mode="pure", block_size=512, inline_max=64))
    pure.write_batch([("put", b"a", bytes(1024)), ("put", b"b", bytes(1024))])
    assert pure.table("objects").count() == 4 and pure.get(b"b") == bytes(1024)
    with pytest.raises(Unsupported):
        pure.train("template")


def test_group_commit_and_shared_reads(spark, path):
    from palimpsest.plans.committer import Coalescer, GroupCommitter, RecentCache

    store = Store(spark, path, SMALL)
    committer = GroupCommitter(store, interval=5.0)
    done = [committer.submit([("put", b"k%d" % n, b"v%d" % n)]) for n in range(6)] + [committer.submit([("put", b"k0", b"x", ("absent", None)), ("delete", b"none")])]
    assert [d.result() for d in done] == [["ok"]] * 6 + [["conflict", "noop"]]
    committer.flush()
    committer.close()
    late = GroupCommitter(store, interval=1.0)
    late.synced = time.monotonic() + 1000  # the first commit isn't durable at once
    assert late.put(b"late", b"x") == "ok" and not store._commit()["durable"]
    late.synced = 0
    with late.lock:
        late.lock.notify_all()
    for _ in range(100):
        if store._commit()["durable"]:
            break
        time.sleep(0.2)
    assert store._commit()["durable"] and store.delete(b"late")  # nobody wrote or flushed
    late.close()
    assert committer.stats.ops == 8 and committer.stats.batches < 8 and committer.stats.syncs >= 1 and store._commit()["durable"]
    reads = Coalescer(store)
    got = []
    threads = [threading.Thread(target=lambda: got.append(reads.get(b"k3"))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [b"v3"] * 3 and reads.shared >= 1 and [k for k, _ in reads.scan_prefix(b"k", 2)] == [b"k0", b"k1"]
    cache = RecentCache(page=2, max_bytes=10)
    token = cache.begin(1)
    assert cache.install(1, [(5, b"e"), (4, b"d")], token) and cache.latest(1, 1) == [(5, b"e")]
    cache.write(1, 6, b"f")
    assert cache.latest(1, 2) == [(6, b"f"), (5, b"e")] and cache.latest(1, 3) is None
    assert not cache.install(1, [], token)
    cache.write(1, 6, None)
    assert cache.latest(1, 1) is None


def test_command_line(spark, path, capsys):
    from palimpsest import cli

    store = Store(spark, path, SMALL)
    run = lambda *a: cli.run(store, cli.parser().parse_args([path, *a]))
    assert run("put", "k/1", "one") == 0 and run("get", "k/1") == 0 and run("get", "no") == 1 and run("scan", "k/") == 0 and run("verify") == 0 and run("stats") == 0
    assert "one" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args([path, "nothing"])
