"""The registered queries: each operator over the driver's tables, and DuckDB SQL that says the same.

Keys and values leave as text, lengths or hex, so that both engines agree on types.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import generators, hashing, keys
from ..functions.codecs import Selector
from ..functions.keys import excluded, included
from ..operators import blocks, chat, commits, log, maintenance, routing, scans, writes
from ..sources import datasets, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- the mutation log of events ---------------------------------------------------------------
OPS = """WITH ops AS (
  SELECT event_id AS ord, 'user/' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, props AS value FROM events),
marked AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY ord) AS before FROM ops),
log AS (
  SELECT row_number() OVER (ORDER BY ord) AS revision, key, ord,
    CASE WHEN op = 'delete' THEN 'tombstone' ELSE 'inline' END AS kind, CASE WHEN op = 'put' THEN value END AS value
  FROM marked WHERE op = 'put' OR before = 'put'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS rn FROM log),
cur AS (SELECT * FROM ranked WHERE rn = 1 AND kind <> 'tombstone')
"""


@query(OPS + "SELECT key, revision, kind, value, ord FROM log")
def kv_effective_log(spark, sf_dir):
    return fixtures.event_log(spark, sf_dir)


@query(OPS + "SELECT key, revision, value FROM cur")
def kv_current_state(spark, sf_dir):
    return log.current(fixtures.event_log(spark, sf_dir)).select("key", "revision", "value")


@query(OPS + "SELECT key, revision, value FROM cur WHERE key = 'user/00000007'")
def kv_get(spark, sf_dir):
    return log.get(fixtures.event_log(spark, sf_dir), "user/00000007")


ASKED = "(VALUES (0, 'user/00000003'), (1, 'user/99999999'), (2, 'user/00000001'), (3, 'user/00000003')) AS k(pos, key)"


@query(OPS + f"SELECT CAST(pos AS BIGINT) AS pos, key, coalesce(revision, 0) AS revision, value FROM {ASKED} LEFT JOIN cur USING (key)")
def kv_get_many(spark, sf_dir):
    asked = [(0, "user/00000003"), (1, "user/99999999"), (2, "user/00000001"), (3, "user/00000003")]
    rows = log.get_many(fixtures.event_log(spark, sf_dir), spark.createDataFrame(asked, "pos long, key string"))
    return rows.withColumn("revision", F.coalesce("revision", F.lit(0)))


@query(OPS + "SELECT key, revision, CAST(octet_length(encode(value)) AS BIGINT) AS logical_len FROM cur WHERE key = 'user/00000002'")
def kv_head(spark, sf_dir):
    return log.head(fixtures.event_log(spark, sf_dir), "user/00000002")


@query(OPS + "SELECT key, revision, CAST(octet_length(encode(value)) AS BIGINT) AS logical_len FROM cur")
def kv_head_all(spark, sf_dir):
    state = log.current(fixtures.event_log(spark, sf_dir))
    return state.select("key", "revision", log.logical_len(state))


@query(OPS + "SELECT l.key, l.revision, l.value FROM log l JOIN (SELECT key, min(revision) AS revision FROM log GROUP BY key) f USING (key, revision) WHERE l.kind <> 'tombstone' AND l.key = 'user/00000005'")
def kv_get_at_revision(spark, sf_dir):
    rows = fixtures.event_log(spark, sf_dir).persist()
    first = rows.where("key = 'user/00000005'").agg(F.min("revision")).first()[0] or 0
    return log.get_at(rows, "user/00000005", first)


@query(OPS + "SELECT key, max(revision) AS revision, arg_max(value, revision) AS value FROM log WHERE revision <= 500 GROUP BY key HAVING arg_max(kind, revision) <> 'tombstone'")
def kv_as_of(spark, sf_dir):
    return log.as_of(fixtures.event_log(spark, sf_dir), 500).select("key", "revision", "value")


@query(OPS + "SELECT key, revision, kind, rn = 1 AS is_current FROM ranked")
def kv_history(spark, sf_dir):
    return log.history(fixtures.event_log(spark, sf_dir)).select("key", "revision", "kind", "is_current")


@query(OPS + "SELECT key, revision FROM ranked WHERE rn = 1 AND kind = 'tombstone'")
def kv_tombstones(spark, sf_dir):
    return log.newest(fixtures.event_log(spark, sf_dir)).where("kind = 'tombstone'").select("key", "revision")


@query(OPS + "SELECT key, revision FROM ranked WHERE rn <= 3")
def kv_prune_history_keep2(spark, sf_dir):
    return log.prune_history(fixtures.event_log(spark, sf_dir), 2)[0].select("key", "revision")


@query(OPS + "SELECT count(*) AS removed FROM ranked WHERE rn > 3")
def kv_prune_history_removed(spark, sf_dir):
    return log.prune_history(fixtures.event_log(spark, sf_dir), 2)[1].agg(F.count("*").alias("removed"))


@query(OPS + "SELECT ord, key, ord = min(ord) OVER (PARTITION BY key) AS ok FROM ops")
def kv_put_if_absent(spark, sf_dir):
    return writes.put_if_absent(fixtures.mutations(spark, sf_dir)).select("ord", "key", "ok")


@query(OPS + "SELECT ord, key, op, CASE WHEN op = 'delete' AND before IS DISTINCT FROM 'put' THEN 'noop' ELSE 'ok' END AS status FROM marked")
def kv_batch_outcomes(spark, sf_dir):
    ops = fixtures.mutations(spark, sf_dir)
    state = spark.createDataFrame([], "key string, revision long")
    return writes.fold(ops, state).select("ord", "key", "op", "status")


@query(OPS + """, first AS (SELECT key, min(ord) AS ord FROM ops GROUP BY key)
SELECT o.ord, o.key, CASE WHEN o.ord = f.ord THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN o.ord = f.ord THEN dense_rank() OVER (ORDER BY CASE WHEN o.ord = f.ord THEN o.ord END NULLS LAST) ELSE 0 END AS revision
FROM ops o JOIN first f USING (key)""")
def kv_write_batch_each_absent(spark, sf_dir):
    """Puts that all expect an absent key: the first of each key gets the next dense revision, the others conflict."""
    ops = fixtures.mutations(spark, sf_dir).withColumn("op", F.lit("put")).withColumn("expect", F.lit("absent"))
    out = writes.write_batch_each(ops, spark.createDataFrame([], "key string, revision long"))
    return out.select("ord", "key", "status", F.coalesce("revision", F.lit(0)).alias("revision"))


@query(OPS + "SELECT ord, key, 'conflict' AS status FROM ops")
def kv_cas_on_missing(spark, sf_dir):
    """Puts that expect a revision no key holds: all conflict."""
    ops = fixtures.mutations(spark, sf_dir).withColumn("op", F.lit("put")).withColumn("expect", F.lit("revision")).withColumn("expect_revision", F.lit(1).cast("long"))
    return writes.fold(ops, spark.createDataFrame([], "key string, revision long")).select("ord", "key", "status")


@query(OPS + """SELECT o.ord, o.key, CASE WHEN o.ord % 5 = 0 AND o.prev IS NOT NULL THEN 'conflict' ELSE 'ok' END AS status
FROM (SELECT ord, key, row_number() OVER (PARTITION BY key ORDER BY ord) AS n, lag(ord) OVER (PARTITION BY key ORDER BY ord) AS prev FROM ops) o WHERE n <= 2""")
def kv_cas_chain(spark, sf_dir):
    """The first two puts of a key: the second expects the first, or (every fifth) a revision that isn't there."""
    by = Window.partitionBy("key").orderBy("ord")
    ops = fixtures.mutations(spark, sf_dir).withColumn("n", F.row_number().over(by)).withColumn("before", F.lag("ord").over(by)).where("n <= 2")
    wrong = F.col("ord") % 5 == 0
    ops = ops.select("ord", "key", F.lit("put").alias("op"), "value", F.when(F.col("n") == 1, "absent").otherwise("revision").alias("expect"), F.lit(-1).cast("long").alias("expect_revision"), F.when(~wrong, F.col("before")).alias("expect_ord"))
    return writes.fold(ops, spark.createDataFrame([], "key string, revision long")).select("ord", "key", "status")


@query()
def kv_cas_chain_whole(spark, sf_dir):
    """All mutations of a key as puts: the first expects an absent key, each other one the put before it, every fifth a revision that isn't there.

    A put after one that conflicted conflicts, too, until every seventh, which expects nothing, starts the chain anew.
    """
    by = Window.partitionBy("key").orderBy("ord")
    ops = fixtures.mutations(spark, sf_dir).withColumn("before", F.lag("ord").over(by))
    expect = F.when(F.col("before").isNull(), "absent").when(F.col("ord") % 7 == 0, "any").otherwise("revision")
    ops = ops.select("ord", "key", F.lit("put").alias("op"), "value", expect.alias("expect"), F.lit(-1).cast("long").alias("expect_revision"), F.when(F.col("ord") % 5 != 0, F.col("before")).alias("expect_ord"))
    return writes.fold(ops, spark.createDataFrame([], "key string, revision long")).select("ord", "key", "status")


@query(OPS + "SELECT m.ord, m.key, (SELECT max(l.revision) FROM log l WHERE l.key = m.key AND l.ord < m.ord) AS deleted_revision FROM marked m WHERE m.op = 'delete' AND m.before = 'put'")
def kv_delete_result(spark, sf_dir):
    """What each delete that had an effect deleted: the revision given to the operation that it touched."""
    out = writes.write_batch_each(fixtures.mutations(spark, sf_dir), spark.createDataFrame([], "key string, revision long"))
    given = out.select(F.col("ord").alias("touched"), F.col("revision").alias("deleted_revision"))
    return out.where("op = 'delete' and status = 'ok'").select("ord", "key", "touched").join(given, "touched").drop("touched")


@query(OPS + "SELECT key, arg_max(value, ord) AS value FROM ops GROUP BY key")
def kv_put_many(spark, sf_dir):
    return writes.put_many(fixtures.mutations(spark, sf_dir).withColumnRenamed("ord", "pos"))


@query(OPS + """SELECT ord, CASE WHEN length(key) = 0 THEN 'empty key' WHEN op = 'put' AND length(key) > 12 THEN 'key too long' WHEN op = 'put' AND length(value) > 7 THEN 'value too long' END AS error
FROM (SELECT ord, op, value, CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 13 = 0 THEN key || '/x' ELSE key END[1:14] AS key FROM (SELECT ord, op, value, replace(key, 'user/0', 'u/') AS key FROM ops))""")
def kv_validation(spark, sf_dir):
    from types import SimpleNamespace

    ops = fixtures.mutations(spark, sf_dir).withColumn("key", F.replace("key", F.lit("user/0"), F.lit("u/")))
    ops = ops.withColumn("key", F.substring(F.when(F.col("ord") % 11 == 0, "").when(F.col("ord") % 13 == 0, F.concat("key", F.lit("/x"))).otherwise(F.col("key")), 1, 14))
    limits = SimpleNamespace(max_key=12, max_value=7)
    return ops.select("ord", writes.validation_error(F.col("key"), F.col("value"), F.col("op"), limits).alias("error"))


# --- ordered scans ------------------------------------------------------------------------------
DOCS = "WITH docs AS (SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, doc_id + 1 AS revision, coalesce(text, '') AS text, encode(coalesce(text, '')) AS value FROM documents)\n"
MSGS = "WITH msgs AS (SELECT 'ch/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/msg/' || lpad(CAST(turn AS VARCHAR), 20, '0') AS key, conv_id AS channel, turn AS id, coalesce(text, '') AS payload FROM conversations)\n"
HEAD = "key, revision, CAST(octet_length(value) AS BIGINT) AS logical_len"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", "revision", "logical_len", F.md5("value").alias("value_md5"))


@query(DOCS + f"SELECT {HEAD}, md5(value) AS value_md5 FROM docs WHERE key >= 'doc/00000000001' AND key < 'doc/00000000002'")
def kv_scan_prefix(spark, sf_dir):
    return shown(scans.scan_prefix(fixtures.documents(spark, sf_dir), "doc/00000000001"))


@query(DOCS + f"SELECT {HEAD}, md5(value) AS value_md5 FROM docs WHERE key > 'doc/000000000010' AND key <= 'doc/000000000100'")
def kv_scan_range_excl_incl(spark, sf_dir):
    return shown(scans.scan(fixtures.documents(spark, sf_dir), excluded("doc/000000000010"), included("doc/000000000100")))


@query(DOCS + f"SELECT {HEAD}, md5(value) AS value_md5 FROM docs ORDER BY key DESC LIMIT 25")
def kv_scan_reverse_limit(spark, sf_dir):
    return shown(scans.scan(fixtures.documents(spark, sf_dir), reverse=True, limit=25))


@query(DOCS + f"SELECT {HEAD} FROM docs")
def kv_scan_keys_only(spark, sf_dir):
    return scans.scan(fixtures.documents(spark, sf_dir), with_values=False)


@query(DOCS + "SELECT key FROM docs WHERE key >= 'doc/000000000100' AND key < 'doc/000000000150'")
def kv_keys(spark, sf_dir):
    return scans.keys(fixtures.documents(spark, sf_dir), included("doc/000000000100"), excluded("doc/000000000150"))


@query(DOCS + "SELECT key FROM docs WHERE false")
def kv_scan_inverted_range(spark, sf_dir):
    return scans.keys(fixtures.documents(spark, sf_dir), included("doc/9"), included("doc/0"))


@query(DOCS + """, sized AS (SELECT key, revision, octet_length(value) AS logical_len, row_number() OVER (ORDER BY key) AS n,
  sum(octet_length(encode(key)) + octet_length(value)) OVER (ORDER BY key) AS total FROM docs WHERE key >= 'doc/000000000007'),
first AS (SELECT * FROM sized WHERE n <= 51)
SELECT key, revision, CAST(logical_len AS BIGINT) AS logical_len, (SELECT max(NOT (n = 1 OR (n <= 50 AND total <= 100000))) FROM first) AS more FROM first WHERE n = 1 OR (n <= 50 AND total <= 100000)""")
def kv_scan_page(spark, sf_dir):
    return scans.page(fixtures.documents(spark, sf_dir), included("doc/000000000007"), limit=50, max_bytes=100_000).drop("value")


@query(MSGS + "SELECT key, CAST((row_number() OVER (PARTITION BY channel ORDER BY key) - 1) // 3 AS BIGINT) AS page FROM msgs")
def kv_scan_pages(spark, sf_dir):
    return scans.page_numbers(fixtures.messages(spark, sf_dir), "channel", 3).select("key", *long("page"))


@query(MSGS + "SELECT key, CAST(id % 2 AS INT) AS run FROM msgs ORDER BY key, run LIMIT 100")
def kv_merge_runs(spark, sf_dir):
    rows = fixtures.messages(spark, sf_dir)
    return scans.merge_runs([rows.where("id % 2 = 0").select("key"), rows.where("id % 2 = 1").select("key")], 100)


@query(MSGS + "SELECT channel, id, md5(payload) AS payload_md5, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM msgs) WHERE rn <= 3")
def kv_chat_latest_n(spark, sf_dir):
    return chat.page(fixtures.messages(spark, sf_dir), 3).select("channel", "id", F.md5("payload").alias("payload_md5"), *long("rank"))


@query(MSGS + "SELECT channel, id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM msgs WHERE id < 4) WHERE rn <= 2")
def kv_chat_before(spark, sf_dir):
    return chat.page(fixtures.messages(spark, sf_dir), 2, before=4).select("channel", "id", *long("rank"))


@query(DOCS + "SELECT key, hex(value[101:300]) AS part FROM docs WHERE octet_length(value) >= 100")
def kv_byte_range(spark, sf_dir):
    rows = fixtures.documents(spark, sf_dir).where("octet_length(value) >= 100")
    return rows.select("key", F.hex(log.byte_range(F.col("value"), 100, 200)).alias("part"))


# --- blocks -------------------------------------------------------------------------------------
BLOCKS = DOCS.rstrip() + """, cut AS (
  SELECT key, value, unnest(range(0, CAST(ceil(octet_length(value) / 512.0) AS BIGINT))) AS ord FROM docs WHERE octet_length(value) > 0),
blocks AS (
  SELECT key, ord, ord * 512 AS begin, least(ord * 512 + 512, octet_length(value)) AS stop, value[ord * 512 + 1:ord * 512 + 512] AS block FROM cut),
named AS (SELECT *, sha256(block) AS digest, octet_length(block) AS raw_len FROM blocks),
firsts AS (SELECT digest, raw_len, block, min((key, ord)) AS first FROM named GROUP BY ALL),
objects AS (SELECT row_number() OVER (ORDER BY first) AS object_id, digest, raw_len, block FROM firsts),
refs AS (SELECT key, ord, begin, stop, object_id FROM named JOIN objects USING (digest, raw_len, block))
"""


@query(BLOCKS + "SELECT key, CAST(ord AS BIGINT) AS ord, CAST(begin AS BIGINT) AS begin, CAST(stop AS BIGINT) AS stop, digest FROM named")
def kv_blocks(spark, sf_dir):
    cut = blocks.split(fixtures.documents(spark, sf_dir), fixtures.BLOCK)
    return cut.select("key", *long("ord", "begin", "stop"), blocks.digest(F.col("block")).alias("digest"))


@query(BLOCKS + "SELECT key, CAST(ord AS BIGINT) AS ord, object_id FROM refs")
def kv_block_dedupe(spark, sf_dir):
    return fixtures.block_store(spark, sf_dir)[0].select("key", *long("ord"), "object_id")


@query(BLOCKS + "SELECT object_id, digest, CAST(raw_len AS BIGINT) AS raw_len FROM objects")
def kv_objects(spark, sf_dir):
    return fixtures.block_store(spark, sf_dir, attach=False)[1].select("object_id", "digest", *long("raw_len"))


@query(BLOCKS + "SELECT object_id, count(*) AS refs FROM refs GROUP BY object_id")
def kv_refcounts(spark, sf_dir):
    return blocks.refcounts(fixtures.block_store(spark, sf_dir)[0])


@query(BLOCKS + "SELECT digest, CAST(raw_len AS BIGINT) AS raw_len, count(*) AS ids FROM objects GROUP BY digest, raw_len")
def kv_candidates(spark, sf_dir):
    return blocks.candidates(fixtures.block_store(spark, sf_dir, attach=False)[1]).select("digest", *long("raw_len"), F.size("ids").cast("long").alias("ids"))


@query(BLOCKS + "SELECT count(*) AS blocks, CAST(sum(stop - begin) AS BIGINT) AS logical_bytes, (SELECT CAST(sum(raw_len) AS BIGINT) FROM objects) AS stored_bytes FROM refs")
def kv_dedupe_savings(spark, sf_dir):
    refs, objects = fixtures.block_store(spark, sf_dir, attach=False)
    one = refs.agg(F.count("*").alias("blocks"), F.sum(F.col("stop") - F.col("begin")).alias("logical_bytes"))
    total = objects.agg(F.sum("raw_len")).first()[0] or 0
    return one.withColumn("stored_bytes", F.lit(total).cast("long"))


@query(BLOCKS + "SELECT key, CAST(min(ord) AS BIGINT) AS first, CAST(max(ord) AS BIGINT) AS last FROM refs WHERE stop > 700 AND begin < 1700 GROUP BY key")
def kv_block_locate(spark, sf_dir):
    return blocks.locate(fixtures.block_store(spark, sf_dir)[0], 700, 1000).select("key", *long("first", "last"))


@query(BLOCKS + "SELECT key, CAST(ord AS BIGINT) AS ord, CAST(begin AS BIGINT) AS begin FROM refs")
def kv_chunk_starts(spark, sf_dir):
    return blocks.chunk_starts(fixtures.block_store(spark, sf_dir)[0].drop("begin")).select("key", *long("ord", "begin"))


@query(DOCS + "SELECT key, md5(value[701:1700]) AS part_md5 FROM docs WHERE octet_length(value) > 700")
def kv_block_range(spark, sf_dir):
    refs, objects = fixtures.block_store(spark, sf_dir)
    return blocks.reassemble(refs, objects, 700, 1000).select("key", F.md5("value").alias("part_md5"))


@query(DOCS + "SELECT key, md5(value) AS value_md5, true AS complete FROM docs WHERE octet_length(value) > 0")
def kv_reassemble(spark, sf_dir):
    refs, objects = fixtures.block_store(spark, sf_dir)
    return blocks.reassemble(refs, objects).select("key", F.md5("value").alias("value_md5"), "complete")


@query(DOCS + "SELECT CASE WHEN octet_length(value) <= 16384 THEN 'inline' ELSE 'chunks' END AS kind, count(*) AS n, CAST(sum(octet_length(value)) AS BIGINT) AS bytes FROM docs GROUP BY 1")
def kv_inline_vs_chunked(spark, sf_dir):
    from ..config import Config

    n = F.octet_length("value")
    kind = F.when(blocks.is_inline(n, Config()), "inline").otherwise("chunks").alias("kind")
    return fixtures.documents(spark, sf_dir).groupBy(kind).agg(F.count("*").alias("n"), F.sum(n).alias("bytes"))


@query(BLOCKS + """, first AS (SELECT key, object_id, stop - begin AS n, row_number() OVER (PARTITION BY key, object_id ORDER BY ord) = 1 AS counted FROM refs)
SELECT key, count(*) AS units, CAST(count(*) FILTER (WHERE counted) AS BIGINT) AS objects, CAST(coalesce(sum(n) FILTER (WHERE counted), 0) AS BIGINT) AS bodies,
  CAST(sum(n) AS BIGINT) AS logical_len, CAST(count(*) FILTER (WHERE counted) * 64 AS BIGINT) AS headers, CAST(coalesce(sum(n) FILTER (WHERE counted), 0) + count(*) FILTER (WHERE counted) * 64 AS BIGINT) AS stored
FROM first GROUP BY key""")
def kv_inspect_space(spark, sf_dir):
    """What each key's units take when all are stored raw."""
    refs, objects = fixtures.block_store(spark, sf_dir, attach=False)
    raw = objects.select("object_id", F.lit("raw").alias("codec"), "raw_len", F.col("raw_len").alias("body_len"), F.lit(0).cast("long").alias("aux_id"))
    space = blocks.record_space(blocks.inspect(refs, raw, blocks.refcounts(refs)))
    return space.select("key", *long("units", "objects", "bodies", "logical_len", "headers", "stored"))


# --- maintenance --------------------------------------------------------------------------------
DAMAGED = BLOCKS.rstrip() + """,
have AS (SELECT object_id, digest, raw_len FROM objects WHERE object_id % 97 <> 0 UNION ALL SELECT 1000000000 + i, sha256(CAST(i AS VARCHAR)), 1 FROM range(1, 6) t(i)),
counts AS (SELECT object_id, count(*) + CASE WHEN object_id % 89 = 0 THEN 1 ELSE 0 END AS refs FROM refs GROUP BY object_id),
cands AS (SELECT object_id, CASE WHEN object_id % 83 = 0 THEN 'other' ELSE digest END AS digest, raw_len FROM objects UNION ALL SELECT 2000000000 + i, 'gone', 7 FROM range(1, 4) t(i)),
status AS (
  SELECT c.object_id, CASE WHEN h.object_id IS NULL AND r.object_id IS NULL THEN 'stale' WHEN h.object_id IS NULL OR c.digest <> h.digest OR c.raw_len <> h.raw_len THEN 'dangling' ELSE 'live' END AS status
  FROM cands c LEFT JOIN have h USING (object_id) LEFT JOIN (SELECT DISTINCT object_id FROM refs) r USING (object_id))
"""


@query(DAMAGED + "SELECT object_id, count(*) AS references FROM refs WHERE object_id NOT IN (SELECT object_id FROM have) GROUP BY object_id".replace("references", '"references"'))
def kv_missing_objects(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.missing_objects(d["refs"], d["objects"])


@query(DAMAGED + "SELECT object_id, 'unreferenced' AS reason FROM have WHERE object_id NOT IN (SELECT object_id FROM refs) UNION ALL SELECT object_id, 'no_object' FROM counts WHERE object_id NOT IN (SELECT object_id FROM have)")
def kv_orphans(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.orphans(d["refs"], d["objects"], d["counts"])


@query(DAMAGED + "SELECT object_id, expected, c.refs AS stored FROM (SELECT object_id, count(*) AS expected FROM refs GROUP BY object_id) JOIN counts c USING (object_id) WHERE expected <> c.refs AND object_id IN (SELECT object_id FROM have)")
def kv_refcount_drift(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.refcount_drift(d["refs"], d["objects"], d["counts"])


@query(DAMAGED + "SELECT status, count(*) AS n FROM status GROUP BY status")
def kv_candidate_status(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.candidate_report(d["candidates"], d["objects"], d["refs"]).groupBy("status").agg(F.count("*").alias("n"))


@query(DAMAGED + "SELECT object_id FROM status WHERE status = 'stale'")
def kv_stale_candidates(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.candidate_report(d["candidates"], d["objects"], d["refs"]).where("status = 'stale'").select("object_id")


@query(DAMAGED + "SELECT object_id, CAST(raw_len AS BIGINT) AS raw_len FROM have WHERE object_id IN (SELECT object_id FROM refs)")
def kv_gc_keep_set(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.collect_garbage(d["refs"], d["objects"], d["candidates"])["objects"].select("object_id", *long("raw_len"))


@query(DAMAGED + """SELECT 'missing_object' AS problem, count(DISTINCT object_id) AS n, true AS fatal FROM refs WHERE object_id NOT IN (SELECT object_id FROM have)
UNION ALL SELECT 'refcount', count(*), true FROM (SELECT object_id, count(*) AS e FROM refs GROUP BY object_id) JOIN counts c USING (object_id) WHERE e <> c.refs AND object_id IN (SELECT object_id FROM have)
UNION ALL SELECT 'length', 0, true
UNION ALL SELECT 'orphan', (SELECT count(*) FROM have WHERE object_id NOT IN (SELECT object_id FROM refs)) + (SELECT count(*) FROM counts WHERE object_id NOT IN (SELECT object_id FROM have)), false
UNION ALL SELECT 'stale_candidate', count(*), false FROM status WHERE status = 'stale'
UNION ALL SELECT 'dangling_candidate', count(*), true FROM status WHERE status = 'dangling'""")
def kv_verify(spark, sf_dir):
    d = fixtures.damaged(spark, sf_dir)
    return maintenance.verify(d["refs"], d["objects"], d["counts"], d["candidates"])


@query(BLOCKS + """, own AS (SELECT object_id, raw_len + CASE WHEN object_id % 101 = 0 THEN 1 ELSE 0 END AS raw_len FROM objects)
SELECT object_id, CAST(min(stop - begin) AS BIGINT) AS least, CAST(max(stop - begin) AS BIGINT) AS most, CAST(any_value(raw_len) AS BIGINT) AS raw_len
FROM refs JOIN own USING (object_id) GROUP BY object_id HAVING min(stop - begin) <> max(stop - begin) OR min(stop - begin) <> any_value(raw_len)""")
def kv_length_conflicts(spark, sf_dir):
    """Objects whose own length (planted: one more where the id % 101 is 0) is not the one that references say."""
    refs, objects = fixtures.block_store(spark, sf_dir, attach=False)
    objects = objects.withColumn("raw_len", F.col("raw_len") + (F.col("object_id") % 101 == 0).cast("int"))
    return maintenance.length_conflicts(refs, objects).select("object_id", *long("least", "most", "raw_len"))


@query("""SELECT DISTINCT page_id % 9 AS param_id, CASE WHEN page_id % 2 = 0 THEN 'template' ELSE 'zstd_dict' END AS kind FROM pages
WHERE page_id % 9 > 0 AND NOT (page_id % 9 <= 4 AND page_id % 2 = 1)""")
def kv_missing_params(spark, sf_dir):
    """Parameters that units need, where dictionaries 1 to 4 are all there is."""
    page = F.col("page_id")
    units = fixtures.table(spark, sf_dir, "pages").select((page % 9).alias("aux_id"), F.when(page % 2 == 0, "template").otherwise("zstd_dict").alias("codec"))
    there = spark.range(1, 5).select(F.col("id").alias("param_id"), F.lit("zstd_dict").alias("kind"))
    return maintenance.missing_params(units, there)


@query("SELECT DISTINCT page_id AS source_id FROM pages WHERE page_id % 5 = 0")
def kv_dangling_sources(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"))
    return maintenance.dangling_sources(rows, rows.where("source_id % 5 <> 0"))


@query(OPS + """SELECT count(*) FILTER (WHERE kind <> 'tombstone') AS records, count(*) FILTER (WHERE kind = 'tombstone') AS tombstones,
  CAST(coalesce(sum(octet_length(encode(value))), 0) AS BIGINT) AS logical_bytes FROM ranked WHERE rn = 1""")
def kv_stats(spark, sf_dir):
    rows = log.newest(fixtures.event_log(spark, sf_dir)).withColumn("logical_len", F.octet_length("value").cast("long"))
    return maintenance.stats(rows)


@query(DOCS + """SELECT CASE WHEN octet_length(value) <= 16384 THEN 'inline' ELSE 'chunks' END AS codec, count(*) AS units, CAST(sum(octet_length(value)) AS BIGINT) AS raw_bytes,
  CAST(sum(octet_length(value)) AS BIGINT) AS body_bytes, CAST(sum(octet_length(value) + 64) AS BIGINT) AS envelope_bytes FROM docs GROUP BY 1""")
def kv_usage(spark, sf_dir):
    """Usage of raw units, by whether they are inline."""
    n = F.octet_length("value")
    return maintenance.usage_by_codec(fixtures.documents(spark, sf_dir).select(F.when(n <= 16384, "inline").otherwise("chunks").alias("codec"), n.alias("raw_len"), n.alias("body_len")))


@query("""WITH d AS (SELECT octet_length(encode('doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'))) + octet_length(encode(coalesce(text, ''))) AS n FROM documents),
m AS (SELECT octet_length(encode('ch/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/msg/' || lpad(CAST(turn AS VARCHAR), 20, '0'))) + octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
b AS (SELECT 'documents' AS t, n FROM d UNION ALL SELECT 'messages', n FROM m)
SELECT coalesce(t, 'total') AS table_name, count(*) AS entries, CAST(sum(n) AS BIGINT) AS payload FROM b GROUP BY ROLLUP (t)""")
def kv_table_totals(spark, sf_dir):
    return maintenance.table_totals({"documents": (fixtures.documents(spark, sf_dir), "key", "value"), "messages": (fixtures.messages(spark, sf_dir), "key", "payload")})


@query(BLOCKS + "SELECT 'object' AS space, CAST(100 AS BIGINT) AS next_id, max(object_id) AS largest, 100 > max(object_id) AS ok FROM objects")
def kv_counter_check(spark, sf_dir):
    return maintenance.counter_check({"object": 100}, {"object": (fixtures.block_store(spark, sf_dir, attach=False)[1], "object_id")})


# --- codecs, generators, numbers ---------------------------------------------------------------
@query("""WITH c AS (SELECT lang, list_extract(b, i) AS byte FROM (SELECT lang, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ',') AS b FROM documents), LATERAL (SELECT unnest(range(1, len(b))) AS i)),
n AS (SELECT lang, byte, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT lang, n, sum(n) OVER (PARTITION BY lang) AS t FROM n) GROUP BY lang""")
def kv_entropy(spark, sf_dir):
    """Order-0 entropy of the bytes of each language, in bits."""
    rows = fixtures.table(spark, sf_dir, "documents").select("lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("value"))
    return maintenance.byte_entropy(rows, "lang", "value").select("lang", F.round("entropy", 6).alias("entropy"))


@query("SELECT i, 1000 + 7 * i AS value FROM range(0, 5000) t(i)")
def kv_generate_arith(spark, sf_dir):
    """The values of the arithmetic generator, decoded from its bytes."""
    made = generators.Registry().get(1).whole(generators.arith_params(1000, 7, 5000))
    return spark.createDataFrame(list(enumerate(memoryview(made).cast("Q").tolist())), "i long, value long")


SNOW = "WITH s AS (SELECT event_id, (1420070400000 + event_id * 977 - 1420070400000) * 4194304 + (event_id % 32) * 131072 + (event_id % 7) * 4096 + event_id % 4096 AS id FROM events)\n"


@query(SNOW + "SELECT event_id, id FROM s")
def kv_snowflake_encode(spark, sf_dir):
    e = F.col("event_id")
    made = keys.snowflake(F.lit(keys.EPOCH_MS) + e * 977, e % 32, e % 7, e % 4096)
    return fixtures.table(spark, sf_dir, "events").select("event_id", made.alias("id"))


@query(SNOW + "SELECT event_id, (id >> 22) + 1420070400000 AS unix_ms, (id >> 17) & 31 AS worker, (id >> 12) & 31 AS process, id & 4095 AS increment FROM s")
def kv_snowflake_parts(spark, sf_dir):
    rows = kv_snowflake_encode(spark, sf_dir)
    return rows.select("event_id", *[c.alias(n) for n, c in keys.snowflake_parts(F.col("id")).items()])


@query("SELECT conv_id, turn, lpad(hex(conv_id), 16, '0') || lpad(hex(turn), 16, '0') AS key FROM conversations")
def kv_message_keys(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "conversations").select("conv_id", "turn", keys.message_key(F.col("conv_id"), F.col("turn")).alias("k"))
    channel, message = keys.parse_message_key(F.col("k"))
    return rows.where((channel == F.col("conv_id")) & (message == F.col("turn"))).select("conv_id", "turn", F.hex("k").alias("key"))


FNV = """, h AS (
  SELECT key, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), [CAST(ascii(c) AS UHUGEINT) FOR c IN string_split(route, '')]), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM routed),
m1 AS (SELECT key, (xor(h, h >> 33) * 18397679294719823053) % 18446744073709551616 AS h FROM h),
m2 AS (SELECT key, (xor(h, h >> 33) * 14181476777654086739) % 18446744073709551616 AS h FROM m1),
hashed AS (SELECT key, xor(h, h >> 33) AS h FROM m2)
"""


@query(MSGS.rstrip() + ", routed AS (SELECT key, key[1:11] AS route FROM msgs)" + FNV + "SELECT key, lower(lpad(hex(CAST(h AS UBIGINT)), 16, '0')) AS hash, CAST((h * 16) >> 64 AS INT) AS shard FROM hashed")
def kv_shard_of(spark, sf_dir):
    """The shard of each message by the first 11 bytes of its key."""
    router = routing.Router(11)
    return fixtures.messages(spark, sf_dir).select("key", hashing.hash_hex(router.hash(F.col("key"))).alias("hash"), router.shard(F.col("key"), 16).alias("shard"))


@query(MSGS.rstrip() + ", routed AS (SELECT key, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS route FROM msgs)" + FNV + """, s AS (SELECT CAST((h * 8) >> 64 AS INT) AS shard, octet_length(encode(key)) + octet_length(encode(payload)) AS n FROM hashed JOIN msgs USING (key))
SELECT coalesce(shard, -1) AS shard, count(*) AS records, CAST(sum(n) AS BIGINT) AS payload FROM s GROUP BY ROLLUP (shard)""")
def kv_shard_balance(spark, sf_dir):
    """Records and bytes per shard, routed by the key up to its second slash, and in all (-1)."""
    rows = fixtures.messages(spark, sf_dir).select("key", F.col("payload").alias("value"))
    sums = routing.shard_stats(routing.sharded(rows, routing.Router(2, "/"), 8))
    return sums.select(F.coalesce("shard", F.lit(-1)).alias("shard"), "records", *long("payload"))


@query(MSGS + "SELECT key, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS route FROM msgs")
def kv_until_separator(spark, sf_dir):
    return fixtures.messages(spark, sf_dir).select("key", keys.until_separator(F.col("key"), "/", 2).alias("route"))


@query(MSGS + "SELECT key FROM msgs WHERE key >= 'ch/00000007/' AND key < 'ch/000000070'")
def kv_routed_scan(spark, sf_dir):
    """A prefix scan that its router proves to need one shard: the literal shard prunes the others."""
    router, shards = routing.Router(2, "/"), 8
    rows = routing.sharded(fixtures.messages(spark, sf_dir), router, shards)
    shard = router.shard_of_prefix(b"ch/00000007/", shards)
    return rows.where(F.col("shard") == shard).where(keys.within(F.col("key"), *keys.prefix_bounds("ch/00000007/"))).select("key")


# --- logs and batches ---------------------------------------------------------------------------
WAL = """WITH wal AS (SELECT event_id + 1 AS lsn, 'records' AS table_name, 'user/' || user_id AS key, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS op, props AS value FROM events)
"""


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "events")
    return rows.select((F.col("event_id") + 1).alias("lsn"), F.lit("records").alias("table_name"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"), F.col("props").alias("value"))


@query(WAL + "SELECT table_name, key, value, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM wal WHERE lsn > 300) WHERE rn = 1 AND op = 'put'")
def kv_wal_replay(spark, sf_dir):
    return commits.replay(wal(spark, sf_dir), 300)


@query(WAL + "SELECT lsn FROM (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS before FROM wal WHERE lsn % 101 <> 50) WHERE before + 1 <> lsn")
def kv_wal_gap(spark, sf_dir):
    return commits.gaps(wal(spark, sf_dir).where("lsn % 101 <> 50"))


@query(WAL + "SELECT lsn, op FROM wal WHERE lsn < 50")
def kv_wal_valid_prefix(spark, sf_dir):
    return commits.valid_prefix(wal(spark, sf_dir).where("lsn % 101 <> 50")).select("lsn", "op")


@query(WAL.rstrip() + ", middle AS (SELECT max(lsn) // 2 AS gap FROM wal) SELECT lsn, op FROM wal WHERE lsn < (SELECT gap FROM middle)")
def kv_wal_valid_prefix_half(spark, sf_dir):
    """The records before a gap in the middle of the log, so that the prefix grows with it."""
    rows = wal(spark, sf_dir)
    gap = (rows.agg(F.max("lsn")).first()[0] or 0) // 2
    return commits.valid_prefix(rows.where(F.col("lsn") != gap)).select("lsn", "op")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 256 AS BIGINT) AS batch FROM events")
def kv_batch_cuts(spark, sf_dir):
    return commits.equal_batches(fixtures.table(spark, sf_dir, "events").select("event_id"), "event_id", 256).select("event_id", *long("batch"))


@query("WITH b AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 256 AS batch FROM events), n AS (SELECT count(*) AS n FROM b GROUP BY batch) SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS ops, avg(n) AS mean_ops, max(n) AS max_ops FROM n")
def kv_commit_stats(spark, sf_dir):
    return commits.commit_stats(kv_batch_cuts(spark, sf_dir))


GREEDY = """WITH RECURSIVE q AS (
  SELECT conv_id AS queue, turn AS ord, 1 AS ops, CAST(octet_length(encode(coalesce(text, ''))) AS INT) AS bytes, 'plain' AS kind, turn = 4 AS flush,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (
  SELECT *, CAST(0 AS BIGINT) AS batch, 1 AS held, bytes AS size FROM q WHERE n = 1
  UNION ALL
  SELECT q.*, CASE WHEN g.flush OR g.held + 1 > 3 OR g.size + q.bytes > 2000 THEN g.batch + 1 ELSE g.batch END,
    CASE WHEN g.flush OR g.held + 1 > 3 OR g.size + q.bytes > 2000 THEN 1 ELSE g.held + 1 END,
    CASE WHEN g.flush OR g.held + 1 > 3 OR g.size + q.bytes > 2000 THEN q.bytes ELSE g.size + q.bytes END
  FROM g JOIN q ON q.queue = g.queue AND q.n = g.n + 1)
SELECT queue, ord, ops, bytes, kind, flush, batch FROM g"""


@query(GREEDY)
def kv_greedy_batches(spark, sf_dir):
    """Messages as requests of their channel's queue, at most 3 operations or 2000 bytes each batch."""
    rows = fixtures.messages(spark, sf_dir).select(F.col("channel").alias("queue"), F.col("id").alias("ord"), F.lit(1).alias("ops"), F.octet_length("payload").alias("bytes"), F.lit("plain").alias("kind"), (F.col("id") == 4).alias("flush"))
    return commits.greedy_batches(rows, 3, 2000)


# --- what SQL can't express: tested against plain versions ---------------------------------------
@query()
def kv_codec_choice(spark, sf_dir):
    """The codec of each block of the documents, and what it saves."""
    return maintenance.usage_by_codec(blocks.encode_units(blocks.distinct(fixtures.document_blocks(spark, sf_dir)), Selector()))


@query()
def kv_codec_roundtrip(spark, sf_dir):
    """Every block decoded again and held against its digest."""
    units = blocks.encode_units(blocks.distinct(fixtures.document_blocks(spark, sf_dir)), Selector())
    done = blocks.decode_units(units)
    return done.groupBy("codec").agg(F.count("*").alias("units"), F.count_if(F.col("data") == F.col("block")).alias("exact"), F.count("problem").alias("problems"))


@query(BLOCKS + "SELECT count(*) AS units, count(*) AS exact, CAST(0 AS BIGINT) AS problems FROM objects")
def kv_codec_exact(spark, sf_dir):
    """All blocks of the documents encoded, decoded and held against their bytes and digests."""
    units = blocks.encode_units(blocks.distinct(fixtures.document_blocks(spark, sf_dir)), Selector())
    return blocks.decode_units(units).agg(F.count("*").alias("units"), F.count_if(F.col("data") == F.col("block")).alias("exact"), F.count("problem").alias("problems"))


@query()
def kv_dataset_codecs(spark, sf_dir):
    """Which codecs the six datasets get, 200 records of 1 KiB each."""
    out = None
    for kind in datasets.KINDS:
        units = datasets.records(spark, kind, 200, 1024).select(F.lit(kind).alias("dataset"), F.octet_length("value").alias("raw_len"), F.col("value").alias("block"))
        one = blocks.encode_units(units, Selector()).groupBy("dataset", "codec").agg(F.count("*").alias("units"), F.sum("body_len").alias("body_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def kv_generated(spark, sf_dir):
    """Digests of generated values and of ranges of them."""
    registry, rows = generators.Registry(), []
    for id_, params in ((1, generators.arith_params(5, 3, 1000)), (2, generators.xof_params(bytes(range(32)), 5000)), (3, generators.repeat_params(10_000, b"motif "))):
        made = registry.get(id_)
        whole = made.whole(params)
        rows.append((id_, made.name, len(whole), hashing.blake3(whole).hex(), made.range(params, 1234, 99) == whole[1234:1333]))
    return spark.createDataFrame(rows, "id int, name string, length long, digest string, range_ok boolean")


@query("SELECT url AS location, min(page_id) AS source_id FROM pages GROUP BY url")
def kv_import_sources(spark, sf_dir):
    """One source per location: the lowest id that it was registered with."""
    from .store import source_ids

    rows = fixtures.table(spark, sf_dir, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("location"), F.col("page_id").alias("source_id"))
    return source_ids(rows).select("location", "source_id")


@query(OPS + "SELECT key, value FROM cur")
def kv_stream_current_state(spark, sf_dir):
    """The events as a stream of files into a store, then its current state."""
    from .store import Store
    from ..streaming.ingest import commit_stream

    fixtures.table(spark, sf_dir, "events")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    key = F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    ops = rows.select(F.col("event_id").alias("ord"), F.encode(key, "UTF-8").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.encode("props", "UTF-8").alias("value"))
    place = scratch(spark)
    store = Store(spark, f"{place}/store")
    commit_stream(ops, store, f"{place}/checkpoint").awaitTermination()
    return store.scan().select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.mutations(spark, sf_dir)
    expect = [F.lit("any").alias("expect"), F.lit(None).cast("long").alias("expect_revision")]
    return rows.select("ord", "op", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), *expect)


@query(OPS + """, puts AS (SELECT *, row_number() OVER (ORDER BY ord) AS number FROM ops WHERE op = 'put'),
last AS (SELECT key, max(ord) AS ord FROM ops GROUP BY key)
SELECT true AS history, key, revision, value FROM log WHERE kind = 'inline'
UNION ALL SELECT false, key, number, value FROM puts JOIN last USING (key, ord)""")
def kv_store_get_at(spark, sf_dir):
    """All that get_at can give after the events are written, with history and without."""
    from .store import Store

    out = []
    for history in (True, False):
        store = Store(spark, f"{scratch(spark)}/store", Config(keep_history=history))
        store.write(_event_ops(spark, sf_dir)).unpersist()
        out.append(store.revisions().select(F.lit(history).alias("history"), F.decode("key", "UTF-8").alias("key"), "revision", F.decode("value", "UTF-8").alias("value")))
    return out[0].unionByName(out[1])


@query("""WITH b AS (SELECT item_id, encode(coalesce(text, '')) AS v, encode(reverse(coalesce(text, ''))) AS w FROM benchmark),
vals AS (
  SELECT v, item_id % 3 <> 0 AND item_id % 5 <> 0 AS lives FROM b
  UNION ALL SELECT w, item_id % 5 <> 0 FROM b WHERE item_id % 3 = 0),
cut AS (SELECT hex(v)[i * 1024 + 1:i * 1024 + 1024] AS block, lives FROM (SELECT v, lives, unnest(range(0, CAST(ceil(octet_length(v) / 512.0) AS BIGINT))) AS i FROM vals WHERE octet_length(v) > 64)),
objects AS (SELECT block, bool_or(lives) AS lives FROM cut GROUP BY block)
SELECT false AS history, count(*) FILTER (WHERE NOT lives) AS dropped, count(*) FILTER (WHERE lives) AS kept FROM objects
UNION ALL SELECT true, 0, count(*) FROM objects""")
def kv_store_gc(spark, sf_dir):
    """Objects that garbage collection drops and keeps after every third benchmark text was replaced and every fifth key deleted."""
    from .store import Store

    rows, out = fixtures.table(spark, sf_dir, "benchmark"), []
    text, key, i = F.coalesce("text", F.lit("")), F.encode(F.concat(F.lit("item/"), F.col("item_id").cast("string")), "UTF-8"), F.col("item_id")
    expect = [F.lit("any").alias("expect"), F.lit(None).cast("long").alias("expect_revision")]
    put = lambda value, ord_: [ord_.cast("long").alias("ord"), F.lit("put").alias("op"), key.alias("key"), F.encode(value, "UTF-8").alias("value"), *expect]
    first = rows.select(*put(text, i))
    gone = rows.where(i % 5 == 0).select((2 * i + 1).cast("long").alias("ord"), F.lit("delete").alias("op"), key.alias("key"), F.lit(None).cast("binary").alias("value"), *expect)
    second = rows.where(i % 3 == 0).select(*put(F.reverse(text), 2 * i)).unionByName(gone)
    for history in (False, True):
        store = Store(spark, f"{scratch(spark)}/store", Config(block_size=512, inline_max=64, keep_history=history))
        store.write(first).unpersist()
        store.write(second).unpersist()
        dropped = store.gc()
        out.append(store.table("objects").agg(F.count("*").alias("kept")).select(F.lit(history).alias("history"), F.lit(dropped).cast("long").alias("dropped"), "kept"))
    return out[0].unionByName(out[1])


@query("""WITH n AS (SELECT count(*) AS n FROM nation)
SELECT 'nation/' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS key, upper(hex(encode(n_name))) AS value FROM nation
UNION ALL SELECT 'repeat', substr(repeat('6D6F74696620', CAST(n * 100 AS BIGINT)), 1, CAST(2 * 101 * n AS BIGINT)) FROM n
UNION ALL SELECT 'steps', (SELECT string_agg(lpad(hex(5 + 3 * i), 2, '0') || '00000000000000', '' ORDER BY i) FROM range(0, 80) t(i))""")
def kv_store_scan_generated(spark, sf_dir):
    """A scan over plain and generated records: the names of the nations, a motif and numbers in steps."""
    from .store import Store

    rows = fixtures.table(spark, sf_dir, "nation")
    store = Store(spark, f"{scratch(spark)}/store")
    n = rows.count()
    key = F.concat(F.lit("nation/"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    store.write(rows.select(F.col("n_nationkey").cast("long").alias("ord"), F.lit("put").alias("op"), F.encode(key, "UTF-8").alias("key"), F.encode("n_name", "UTF-8").alias("value"), F.lit("any").alias("expect"), F.lit(None).cast("long").alias("expect_revision"))).unpersist()
    store.put_generated(b"repeat", 3, 1, generators.repeat_params(101 * n, b"motif "), "absent")
    store.put_generated(b"steps", 1, 1, generators.arith_params(5, 3, 80))
    return store.scan().select(F.decode("key", "UTF-8").alias("key"), F.hex("value").alias("value"))


@query("""WITH t AS (SELECT string_agg(text, chr(10) ORDER BY item_id) AS v FROM benchmark),
b AS (SELECT unnest(range(0, CAST(ceil(octet_length(encode(v)) / 512.0) AS BIGINT))) AS i, hex(encode(v)) AS h FROM t)
SELECT 'in/benchmark' AS key, octet_length(encode(v)) AS logical_len, sha256(v) AS digest, (SELECT count(DISTINCT h[i * 1024 + 1:i * 1024 + 1024]) FROM b) AS objects, CAST(1 AS BIGINT) AS commits FROM t""")
def kv_import_file(spark, sf_dir):
    """A file of all benchmark texts, imported by ranges into one commit, and read back."""
    from .store import Store

    place = scratch(spark)
    lines = fixtures.table(spark, sf_dir, "benchmark").where("text is not null").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n").alias("v"))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/benchmark.txt")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(lines.first().v.encode()))  # a small, fixed table
    out.close()
    store = Store(spark, f"{place}/store", Config(block_size=512, inline_max=64))
    before = store._commit()["id"]
    store.import_file(b"in/benchmark", f"{place}/benchmark.txt", "absent")
    done, objects = store._commit()["id"] - before, store.table("objects").count()
    rows = store.scan()
    return rows.select(F.decode("key", "UTF-8").alias("key"), "logical_len", F.sha2("value", 256).alias("digest"), F.lit(objects).cast("long").alias("objects"), F.lit(done).cast("long").alias("commits"))


def _sharded(spark: SparkSession, sf_dir: str):
    from .sharded import ShardedStore

    store = ShardedStore(spark, f"{scratch(spark)}/sharded", 3, routing.Router(2, "/"))
    rows = writes.numbered(fixtures.messages(spark, sf_dir).select("key", "payload"), "key", "ord")
    store.write(rows.select("ord", F.lit("put").alias("op"), F.encode("key", "UTF-8").alias("key"), F.encode("payload", "UTF-8").alias("value"), F.lit("any").alias("expect"), F.lit(None).cast("long").alias("expect_revision")))
    return store


@query(MSGS + """SELECT 'all' AS scan, key, payload FROM msgs
UNION ALL SELECT 'prefix', key, payload FROM msgs WHERE key >= 'ch/00000007/' AND key < 'ch/000000070'""")
def kv_sharded_scan(spark, sf_dir):
    """A scan of all shards merged, and one of a prefix that its router keeps to a single shard."""
    store = _sharded(spark, sf_dir)
    row = lambda name, rows: rows.select(F.lit(name).alias("scan"), F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("payload"))
    return row("all", store.scan()).unionByName(row("prefix", store.scan_prefix(b"ch/00000007/")))


@query(MSGS.rstrip() + ", routed AS (SELECT key, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS route FROM msgs)" + FNV + """, s AS (SELECT CAST((h * 3) >> 64 AS INT) AS shard, octet_length(encode(payload)) AS n FROM hashed JOIN msgs USING (key))
SELECT coalesce(shard, -1) AS shard, count(*) AS records, CAST(0 AS BIGINT) AS tombstones, CAST(sum(n) AS BIGINT) AS logical_bytes FROM s GROUP BY ROLLUP (shard)""")
def kv_sharded_batch(spark, sf_dir):
    """What a batch of all messages leaves in each shard, and in all (-1)."""
    sums = _sharded(spark, sf_dir).stats()
    return sums.select(F.coalesce("shard", F.lit(-1)).alias("shard"), *long("records", "tombstones", "logical_bytes"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a temporary one in local mode without spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="palimpsest-")
