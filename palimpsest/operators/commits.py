"""Commit batches and the write-ahead log, as windows over their records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .writes import numbered

#: Bounds of one commit, as fixed values.
MAX_OPS, MAX_BYTES = 4096, 16 << 20


def equal_batches(ops: DataFrame, order: str, max_ops: int = MAX_OPS) -> DataFrame:
    """``batch`` of single operations of any size: every ``max_ops`` in their order."""
    return numbered(ops, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / max_ops)).drop("_n")


def greedy_batches(requests: DataFrame, max_ops: int = MAX_OPS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``batch`` of requests (queue, ord, ops, bytes, kind, flush), cut first in, first out within each queue.

    A request joins while both bounds hold and its kind is the batch's; one beyond a bound is alone; a flush
    ends its batch. Queues are sorted and streamed, with one batch's sums as the only state.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = requests.select("queue", "ord", "ops", "bytes", "kind", "flush").repartition("queue").sortWithinPartitions("queue", "ord")
    kind = StructType([*rows.schema, *StructType.fromDDL("batch long")])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, first, number, ops, size, of = None, True, 0, 0, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first or r["queue"] != queue:
                    queue, first, number, ops, size, of = r["queue"], False, 0, 0, 0, None
                elif of is None or of != r["kind"] or ops + r["ops"] > max_ops or size + r["bytes"] > max_bytes:
                    number, ops, size = number + 1, 0, 0
                ops, size, of = ops + r["ops"], size + r["bytes"], None if r["flush"] else r["kind"]
                out.append(number)
            if out:
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, schema)), pa.array(out, pa.int64())], schema=schema)

    return rows.mapInArrow(run, kind)


def commit_stats(batched: DataFrame) -> DataFrame:
    """Batches, operations, and their mean and largest size."""
    sizes = batched.groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("batches"), F.sum("n").alias("ops"), F.avg("n").alias("mean_ops"), F.max("n").alias("max_ops"))


def replay(log: DataFrame, after: int) -> DataFrame:
    """The state of each (table_name, key) once records with lsn > ``after`` are applied in order: the last one wins, removes drop."""
    last = log.where(F.col("lsn") > after).groupBy("table_name", "key").agg(F.max_by(F.struct("op", "value", "lsn"), "lsn").alias("r"))
    return last.where("r.op = 'put'").select("table_name", "key", "r.value", "r.lsn")


def gaps(log: DataFrame) -> DataFrame:
    """Records whose number does not follow the one before: the chain ends at the first.

    A record follows if lsn - 1 is there, so that an equi-join finds gaps without a single-partition window.
    """
    have = log.select((F.col("lsn") + 1).alias("lsn")).distinct()
    first = log.agg(F.min("lsn").alias("first"))
    return log.select("lsn").distinct().join(have, "lsn", "left_anti").join(F.broadcast(first), F.col("lsn") > F.col("first")).select("lsn")


def valid_prefix(log: DataFrame) -> DataFrame:
    """The records before the first gap."""
    cut = gaps(log).agg(F.min("lsn").alias("bad")).first().bad
    return log if cut is None else log.where(F.col("lsn") < cut)


def chain_end(records: DataFrame) -> DataFrame:
    """Why each record (lsn, length, stored_length, checksum, stored_checksum, previous lsn) would end the chain, or null."""
    why = (
        F.when(F.col("length").isNull(), "no_record")
        .when((F.col("length") <= 0) | (F.col("length") != F.col("stored_length")), "bad_length")
        .when(F.col("checksum") != F.col("stored_checksum"), "bad_checksum")
        .when(F.col("lsn") != F.lag("lsn").over(Window.partitionBy("segment").orderBy("place")) + 1, "lsn_gap")
    )
    return records.withColumn("end_reason", why)
