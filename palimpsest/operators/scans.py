"""Ordered scans of the current state: bounds, prefixes, direction, limits, pages and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import UNBOUNDED, Bound, prefix_bounds, within
from .log import logical_len

#: A page holds at most so many bytes and items; its first item may be larger. Fixed values.
PAGE_BYTES, PAGE_ITEMS = 16 << 20, 65536


def scan(state: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, reverse: bool = False, limit: int = 0, with_values: bool = True) -> DataFrame:
    """Rows of ``state`` in key order. Bounds are pushed to the scan; ``limit`` 0 means all; without values they are never read."""
    columns = ["key", "revision", logical_len(state)]
    rows = state.where(within(F.col("key"), start, end)).select(*columns, *(["value"] if with_values else []))
    rows = rows.orderBy(F.desc("key") if reverse else F.asc("key"))
    return rows.limit(limit) if limit else rows


def scan_prefix(state: DataFrame, prefix: bytes | str, reverse: bool = False, limit: int = 0, with_values: bool = True) -> DataFrame:
    return scan(state, *prefix_bounds(prefix), reverse, limit, with_values)


def keys(state: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, reverse: bool = False, limit: int = 0) -> DataFrame:
    return scan(state, start, end, reverse, limit, with_values=False).select("key")


def page(state: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, limit: int = PAGE_ITEMS, max_bytes: int = PAGE_BYTES, with_values: bool = True) -> DataFrame:
    """One page with ``more``: rows until ``limit`` or ``max_bytes`` is reached. The next page starts after its last key.

    The rows are bounded by ``limit`` + 1 before the running sum, so that the window never sees the whole table.
    """
    limit = min(limit, PAGE_ITEMS)
    rows = scan(state, start, end, limit=limit + 1, with_values=with_values)
    size = F.octet_length(F.col("key")) + (F.octet_length("value") if with_values else F.lit(0))
    by = Window.orderBy("key")
    rows = rows.withColumn("_bytes", F.sum(size).over(by)).withColumn("_n", F.row_number().over(by))
    fits = (F.col("_n") == 1) | ((F.col("_n") <= limit) & (F.col("_bytes") <= max_bytes))
    rows = rows.withColumn("_fits", fits).withColumn("more", F.max(~fits).over(Window.partitionBy()))
    return rows.where("_fits").drop("_bytes", "_n", "_fits")


def page_numbers(state: DataFrame, group: str, items: int) -> DataFrame:
    """``page`` of each row when every group is cut into pages of ``items`` rows in key order."""
    return state.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("key")) - 1) / items))


def latest(state: DataFrame, group: str, order: str, n: int, before: Column | None = None) -> DataFrame:
    """The newest ``n`` rows of each group, newest first, with ``rank``; only n rows per group and task are shuffled."""
    rows = state if before is None else state.where(before)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("rank") <= n)


def merge_runs(runs: list[DataFrame], limit: int = 0, reverse: bool = False) -> DataFrame:
    """Sorted runs as one; equal keys in the order of their runs, as column ``run``."""
    all_ = reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(k)) for k, r in enumerate(runs)])
    rows = all_.orderBy(F.desc("key") if reverse else F.asc("key"), "run")
    return rows.limit(limit) if limit else rows
