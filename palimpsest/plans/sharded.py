"""A store in shards: one folder of its own each, and a layout that is checked whenever it is opened."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InvalidArgument
from ..functions.keys import UNBOUNDED, Bound, prefix_bounds
from ..operators import routing, scans
from .store import Store


class ShardedStore:
    """Keys are routed by their bytes. Each shard has its own commits and revisions, and a batch is atomic within a shard."""

    def __init__(self, spark: SparkSession, path: str, shards: int, router: routing.Router | routing.CustomRouter, config: Config | None = None) -> None:
        if shards < 1:
            raise InvalidArgument("shards: 1 or more")
        self.spark, self.path, self.shards, self.router = spark, path.rstrip("/"), shards, router
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/shards.json")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            out = fs.create(at, False)
            out.write(bytearray(json.dumps({"version": 1, "shards": shards, "router": router.describe()}).encode()))
            out.close()
        stream = fs.open(at)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        routing.check_layout(json.loads(text), router, shards)
        self.stores = [Store(spark, f"{self.path}/shard-{k:05d}", config) for k in range(shards)]

    def of(self, key: bytes) -> Store:
        return self.stores[self.router.shard_of_key(key, self.shards)]

    # --- one key -----------------------------------------------------------------------------
    def get(self, key: bytes) -> bytes | None:
        return self.of(key).get(key)

    def get_range(self, key: bytes, offset: int, length: int) -> bytes | None:
        return self.of(key).get_range(key, offset, length)

    def get_at(self, key: bytes, revision: int) -> bytes | None:
        return self.of(key).get_at(key, revision)

    def head(self, key: bytes) -> tuple[int, int] | None:
        return self.of(key).head(key)

    def history(self, key: bytes) -> DataFrame:
        return self.of(key).history(key)

    def put(self, key: bytes, value: bytes, expect: str = "any", revision: int | None = None) -> int:
        return self.of(key).put(key, value, expect, revision)

    def delete(self, key: bytes, expect: str = "any", revision: int | None = None) -> bool:
        return self.of(key).delete(key, expect, revision)

    # --- batches -----------------------------------------------------------------------------
    def _split(self, ops: Iterable[tuple]) -> dict[int, list[tuple[int, tuple]]]:
        out: dict[int, list[tuple[int, tuple]]] = {}
        for n, op in enumerate(ops):
            out.setdefault(self.router.shard_of_key(op[1], self.shards), []).append((n, op))
        return out

    def write_batch(self, ops: Iterable[tuple]) -> list[int | None]:
        """Results in the order given; a shard whose expectations fail writes nothing and raises after the shards before it."""
        done = {}
        for shard, own in sorted(self._split(ops).items()):
            done |= zip([n for n, _ in own], self.stores[shard].write_batch([op for _, op in own]))
        return [done[n] for n in range(len(done))]

    def write_batch_each(self, ops: Iterable[tuple]) -> list[str]:
        done = {}
        for shard, own in sorted(self._split(ops).items()):
            done |= zip([n for n, _ in own], self.stores[shard].write_batch_each([op for _, op in own]))
        return [done[n] for n in range(len(done))]

    def write(self, ops: DataFrame, atomic: bool = False, tag: str | None = None) -> None:
        """A table of operations, dealt out by the router within the JVM; one commit a shard."""
        routed = ops.withColumn("shard", self.router.shard(F.col("key"), self.shards)).persist()
        try:
            for shard, store in enumerate(self.stores):
                if (done := store.write(routed.where(F.col("shard") == shard).drop("shard"), atomic, tag=tag)) is not None:
                    done.unpersist()
        finally:
            routed.unpersist()

    # --- scans and totals --------------------------------------------------------------------
    def route(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> list[Store]:
        """The stores that may hold keys of the range: one, or all."""
        one = self.router.shard_of_range(start, end, self.shards)
        return self.stores if one is None else [self.stores[one]]

    def scan(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, reverse: bool = False, limit: int = 0, with_values: bool = True) -> DataFrame:
        """Rows of all shards that the range needs, merged in key order; each shard gives at most ``limit``."""
        runs = [s.scan(start, end, reverse, limit, with_values) for s in self.route(start, end)]
        return runs[0] if len(runs) == 1 else scans.merge_runs(runs, limit, reverse).drop("run")

    def scan_prefix(self, prefix: bytes, reverse: bool = False, limit: int = 0, with_values: bool = True) -> DataFrame:
        one = self.router.shard_of_prefix(prefix, self.shards) if isinstance(self.router, routing.Router) else None
        bounds = prefix_bounds(prefix)
        return self.scan(*bounds, reverse, limit, with_values) if one is None else self.stores[one].scan(*bounds, reverse, limit, with_values)

    def stats(self) -> DataFrame:
        """records, tombstones and logical bytes of each shard, and of all (``shard`` null)."""
        each = reduce(DataFrame.unionByName, [s.stats().withColumn("shard", F.lit(k)) for k, s in enumerate(self.stores)])
        return each.rollup("shard").agg(*[F.sum(c).alias(c) for c in ("records", "tombstones", "logical_bytes")])

    def verify(self, deep: bool = False) -> DataFrame:
        each = reduce(DataFrame.unionByName, [s.verify(deep) for s in self.stores])
        return each.groupBy("problem").agg(F.sum("n").alias("n"), F.max("fatal").alias("fatal"))
