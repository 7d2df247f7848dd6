"""Writes: expectations, batches and dense revisions.

Operations are rows (ord, key, op, value, expect, expect_revision): op is put or delete; expect is any,
absent or revision. ``expect_ord`` may name an earlier operation of the batch in place of a revision.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config


def validation_error(key: Column, value: Column, op: Column, config: Config) -> Column:
    """Why an operation is invalid, or null."""
    return (
        F.when(F.octet_length(key) == 0, F.lit("empty key"))
        .when((op == "put") & (F.octet_length(key) > config.max_key), F.lit("key too long"))
        .when((op == "put") & (F.octet_length(value) > config.max_value), F.lit("value too long"))
    )


#: Cached rows that a task reads, about.
TASK_ROWS = 100_000


def together(cached: DataFrame, n: int) -> DataFrame:
    """``n`` cached rows with small parts read together: or each would write a file for every part of the next shuffle."""
    return cached.coalesce(max(cached.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS))


def numbered(rows: DataFrame, order: str, name: str, base: int = 0, held: list[DataFrame] | None = None) -> DataFrame:
    """``rows`` numbered base + 1, base + 2, ... in the order of a unique column, without a single-partition window.

    Rows are dealt out by range, sorted and numbered within their partition where they are; the partitions'
    sizes (one number each) give the offsets, as a table of one row a partition. The dealt rows stay cached,
    so that they are dealt out once; ``held`` gets them, for the caller to release.
    """
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)  # the partition, and the rows before in it
    dealt = dealt.persist()
    if held is not None:
        held.append(dealt)
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy(part.alias("_part")).count().collect()}
    offsets, at = [], base
    for n in sorted(sizes):
        offsets.append((n, at))
        at += sizes[n]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("long"))
    first = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _at long"))  # a row a partition
    return together(dealt, at - base).withColumn("_part", part).join(first, "_part").withColumn(name, F.col("_at") + within + 1).drop("_part", "_at", "_place")


def effective(ops: DataFrame, keep_history: bool = True) -> DataFrame:
    """Unconditional puts and deletes with ``effective``: a delete of a missing key does nothing and takes no revision."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("ord"))
    live = F.coalesce(before == "put", F.lit(False))
    takes = (F.col("op") == "put") | (live if keep_history else F.lit(False))
    return ops.withColumn("was_live", live).withColumn("effective", takes)


def effective_log(ops: DataFrame, base: int = 0) -> DataFrame:
    """The log of unconditional operations: effective ones, with dense revisions in their order."""
    done = effective(ops).where("effective").drop("effective", "was_live")
    kind = F.when(F.col("op") == "delete", F.lit("tombstone")).otherwise(F.lit("inline"))
    log = numbered(done, "ord", "revision", base)
    return log.select("key", "revision", kind.alias("kind"), F.when(F.col("op") == "put", F.col("value")).alias("value"), "ord")


def unconditional(batch: pa.RecordBatch) -> bool:
    """Whether a batch of ``fold`` has no expectations, so that only the row before decides on a row."""
    if any(batch.column(c).null_count for c in ("ord", "key", "op")):
        return False
    return pc.all(pc.equal(pc.fill_null(batch.column("expect"), "any"), "any")).as_py()


def fold_unconditional(batch: pa.RecordBatch, key, live: bool, by: int | None) -> tuple[list[pa.Array], bool]:
    """``fold`` over whole columns: (outcome columns, live after them); ``key``, ``live`` and ``by`` are those of the row before."""
    keys, ords, op, held = (batch.column(c) for c in ("key", "ord", "op", "held"))
    n = len(batch)
    same = pa.concat_arrays([pa.array([keys[0].as_py() == key]), pc.equal(keys.slice(1), keys.slice(0, n - 1))])
    puts = pc.equal(op, "put")
    before = pc.if_else(same, pa.concat_arrays([pa.array([live]), puts.slice(0, n - 1)]), pc.is_valid(held))
    writer = pa.concat_arrays([pa.array([by], pa.int64()), ords.slice(0, n - 1)])
    none = pa.scalar(None, pa.int64())
    status = pc.if_else(pc.and_(pc.equal(op, "delete"), pc.invert(before)), "noop", "ok")
    columns = [ords, keys, op, batch.column("value"), status, pc.if_else(before, held, none), pc.if_else(pc.and_(before, same), writer, none)]
    return columns, puts[-1].as_py()


OUTCOME = "ord long, key {key}, op string, value {value}, status string, actual long, touched long"


def fold(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Each operation against what its key holds after the operations before it: ``status`` ok, noop or conflict.

    ``state`` has (key, revision) of live keys. Keys are dealt out and sorted, and a task streams them with
    one key's state at a time, so that a key with any number of operations needs no more memory. ``actual``
    is the committed revision that the key held, and ``touched`` the operation of the batch that wrote it.
    """
    types = dict(ops.dtypes)
    held = state.select("key", F.col("revision").alias("held"))
    more = {"expect": F.lit("any"), "expect_revision": F.lit(None).cast("long"), "expect_ord": F.lit(None).cast("long"), "value": F.lit(None).cast("binary")}
    rows = ops.select("ord", "key", "op", *[F.col(c) if c in ops.columns else d.alias(c) for c, d in more.items()])
    rows = rows.join(held, "key", "left").repartition("key").sortWithinPartitions("key", "ord")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(OUTCOME.format(key=types["key"], value=types.get("value", "binary")))
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, revision, by = None, False, None, None
        for batch in batches:
            if len(batch) and unconditional(batch):
                columns, live = fold_unconditional(batch, key, live, by)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                key, revision, by = (batch.column(c)[-1].as_py() for c in ("key", "held", "ord"))
                continue
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, revision, by = r["key"], r["held"], None
                    live = revision is not None
                seen = (revision, by) if live else (None, None)
                expect = r["expect"] or "any"
                met = expect == "any" or (expect == "absent" and not live)
                if expect == "revision" and live:
                    met = r["expect_ord"] == by if r["expect_ord"] is not None else by is None and r["expect_revision"] == revision
                status = "conflict" if not met else "noop" if r["op"] == "delete" and not live else "ok"
                if status == "ok":
                    live, by = r["op"] == "put", r["ord"]
                out.append((r["ord"], r["key"], r["op"], r["value"], status, *seen))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select("ord", "key", "op", "value", "expect", "expect_revision", "expect_ord", "held").mapInArrow(run, kind)


def write_batch_each(ops: DataFrame, state: DataFrame, base: int = 0, keep_history: bool = True, held: list[DataFrame] | None = None) -> DataFrame:
    """Outcomes in which operations that conflict are skipped; effective ones get the revisions after ``base``.

    The fold's rows stay cached, so that they are folded once and not for each pass of the numbering.
    """
    out = fold(ops, state).persist()
    if held is not None:
        held.append(out)
    out = together(out, out.count())
    takes = (F.col("status") == "ok") & (F.lit(True) if keep_history else F.col("op") == "put")
    given = numbered(out.where(takes).select(F.col("ord").alias("_ord")), "_ord", "revision", base, held)
    return out.join(given, F.col("ord") == F.col("_ord"), "left").drop("_ord")


def put_if_absent(ops: DataFrame) -> DataFrame:
    """Puts that expect nothing under their key: the first of each key succeeds."""
    first = F.min("ord").over(Window.partitionBy("key"))
    return ops.withColumn("ok", F.col("ord") == first)


def put_many(entries: DataFrame) -> DataFrame:
    """One row per key: the last of (pos, key, value) wins."""
    return entries.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def ops_from(spark: SparkSession, ops: list[tuple]) -> DataFrame:
    """Operations (op, key, value, expect, expect_revision) given on the driver, in order."""
    schema = "ord long, op string, key binary, value binary, expect string, expect_revision long"
    return spark.createDataFrame([(k, *o) for k, o in enumerate(ops)], schema)
