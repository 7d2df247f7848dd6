"""Reads over the append-only revision log: current state, history, exact revisions and byte ranges.

A log is rows (key, revision, kind, value, ...); ``kind`` is put, inline, chunks, generated or tombstone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument

TOMBSTONE = "tombstone"


def newest(log: DataFrame) -> DataFrame:
    """The newest revision of each key, tombstones included: one hash aggregate with map-side combining."""
    rest = [c for c in log.columns if c != "key"]
    best = log.groupBy("key").agg(F.max_by(F.struct(*rest), "revision").alias("r"))
    return best.select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def current(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("kind") != TOMBSTONE)


def _one(log: DataFrame, key: bytes | str) -> DataFrame:
    """The newest row of one key: the key is filtered at the scan, then a top-1."""
    row = log.where(F.col("key") == F.lit(key)).orderBy(F.desc("revision")).limit(1)
    return row.where(F.col("kind") != TOMBSTONE)


def get(log: DataFrame, key: bytes | str) -> DataFrame:
    """(key, revision, value); no row for a missing or deleted key."""
    return _one(log, key).select("key", "revision", "value")


def head(log: DataFrame, key: bytes | str) -> DataFrame:
    """(key, revision, logical_len) without touching the value where the log has its length."""
    return _one(log, key).select("key", "revision", logical_len(log))


def logical_len(log: DataFrame) -> Column:
    return (F.col("logical_len") if "logical_len" in log.columns else F.octet_length("value")).cast("long").alias("logical_len")


def get_many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(pos, key, revision, value) for each row (pos, key), repeated and missing keys included.

    The log is first cut down to the keys asked for, then aggregated, so that values of other keys never move.
    """
    asked = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(current(asked).select("key", "revision", "value"), "key", "left").select("pos", "key", "revision", "value")


def get_at(log: DataFrame, key: bytes | str, revision: int) -> DataFrame:
    """The value that the key had at exactly this revision."""
    found = log.where((F.col("key") == F.lit(key)) & (F.col("revision") == revision) & (F.col("kind") != TOMBSTONE))
    return found.select("key", "revision", "value")


def as_of(log: DataFrame, revision: int) -> DataFrame:
    """The state after this revision: what a snapshot taken then reads."""
    return current(log.where(F.col("revision") <= revision))


def byte_range(value: Column, offset: int, length: int) -> Column:
    """Bytes [offset, offset + length) clipped to the value; an offset beyond the end raises an error when run."""
    if offset < 0 or length < 0:
        raise InvalidArgument("offset and length: 0 or more")
    part = F.substring(value, offset + 1, length)
    return F.when(F.octet_length(value) < offset, F.raise_error(F.lit("offset beyond the value")).cast("binary")).otherwise(part)


def history(log: DataFrame, key: bytes | str | None = None) -> DataFrame:
    """All retained revisions, oldest first, with ``is_current`` on the newest; of one key, or of all."""
    rows = log if key is None else log.where(F.col("key") == F.lit(key))
    newest_ = F.max("revision").over(Window.partitionBy("key"))
    return rows.withColumn("is_current", F.col("revision") == newest_)


def prune_history(log: DataFrame, keep_last: int, key: bytes | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): of each key the newest ``keep_last`` replaced revisions stay; the current one doesn't count."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("revision")))
    ranked = log.withColumn("_rank", rank)
    gone = F.col("_rank") > keep_last + 1
    if key is not None:
        gone = gone & (F.col("key") == F.lit(key))
    return ranked.where(~gone).drop("_rank"), ranked.where(gone).drop("_rank")
