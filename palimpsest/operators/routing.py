"""Shards: where a key belongs, which shards a scan needs, and totals per shard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, Unsupported
from ..functions.hashing import fmix64, shard_index, shard_of_hash, stable_hash, stable_hash_of
from ..functions.keys import Bound, first_bytes, shared_prefix, until_separator, until_separator_bytes


@dataclass(frozen=True)
class Router:
    """By the first ``count`` bytes, or with ``separator`` up to its ``count``-th occurrence."""

    count: int
    separator: str | None = None

    def __post_init__(self) -> None:
        if self.count < 1 or (self.separator is not None and len(self.separator.encode()) != 1):
            raise InvalidArgument("router")

    def describe(self) -> str:
        return f"first_bytes:{self.count}" if self.separator is None else f"until:{ord(self.separator)}:{self.count}"

    def routing(self, key: Column) -> Column:
        return first_bytes(key, self.count) if self.separator is None else until_separator(key, self.separator, self.count)

    def hash(self, key: Column) -> Column:
        return stable_hash(self.routing(key).cast("binary"))

    def shard(self, key: Column, shards: int) -> Column:
        """The shard of each key, within the JVM."""
        h = F.transform(F.array(self.hash(key)), lambda x: shard_index(x, shards))
        return F.get(h, F.lit(0))

    def route_of(self, key: bytes) -> bytes:
        return key[: self.count] if self.separator is None else until_separator_bytes(key, ord(self.separator), self.count)[0]

    def decided(self, prefix: bytes) -> bool:
        """Whether all keys that begin with ``prefix`` have one route."""
        return len(prefix) >= self.count if self.separator is None else prefix.count(self.separator.encode()) >= self.count

    def shard_of_key(self, key: bytes, shards: int) -> int:
        return shard_of_hash(stable_hash_of(self.route_of(key)), shards)

    def shard_of_prefix(self, prefix: bytes, shards: int) -> int | None:
        return self.shard_of_key(prefix, shards) if self.decided(prefix) else None

    def shard_of_range(self, start: Bound, end: Bound, shards: int) -> int | None:
        """The one shard that holds the range, where what all its keys begin with decides it; else None (all shards)."""
        return self.shard_of_prefix(shared_prefix(start, end), shards)


@dataclass(frozen=True)
class CustomRouter:
    """A named function on driver-side keys; ranges never name a shard."""

    name: str
    route: Callable[[bytes], int]

    def describe(self) -> str:
        return f"custom:{self.name}"

    def shard(self, key: Column, shards: int) -> Column:
        """The shard of each key, in Arrow batches: the function is Python."""
        route = self.route

        @F.pandas_udf("int")
        def of(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: shard_of_hash(fmix64(route(bytes(k))), shards)).astype("int32")

        return of(key)

    def shard_of_key(self, key: bytes, shards: int) -> int:
        return shard_of_hash(fmix64(self.route(key)), shards)

    def shard_of_range(self, start: Bound, end: Bound, shards: int) -> int | None:
        return None


def sharded(rows: DataFrame, router: Router, shards: int) -> DataFrame:
    """``rows`` with ``shard``: write with partitionBy("shard"), so that a literal shard prunes folders."""
    return rows.withColumn("shard", router.shard(F.col("key"), shards))


def shard_stats(rows: DataFrame) -> DataFrame:
    """Keys and bytes per shard and in all (``shard`` null)."""
    size = F.octet_length("key") + F.octet_length("value")
    return rows.rollup("shard").agg(F.count("*").alias("records"), F.sum(size).alias("payload"))


def check_layout(stored: dict, router: Router, shards: int) -> None:
    if stored != {"version": 1, "shards": shards, "router": router.describe()}:
        raise Unsupported(f"sharded as {stored}")
