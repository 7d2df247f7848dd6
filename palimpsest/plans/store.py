"""A store on Parquet: one folder of commits, each naming the data files that a snapshot reads.

A commit writes its files first and is published by creating ``_commits/<id>.json`` exclusively: of two
writers one loses, reads the new state and evaluates its expectations again. Readers resolve one commit
and read its files alone, so that all tables come from one moment. ``place`` (commit, operation) orders
the log; revisions number effective operations. Removed keys (deletes without history) are rows of kind
``removed``, which nothing but the order sees. A row says by ``keeps`` whether the one that it replaces stays
as history; what doesn't is no longer read, counted or kept alive, and compaction drops it.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InvalidArgument, LimitExceeded, MissingDependency, RevisionConflict, StoreError, Unsupported
from ..functions.codecs import Selector
from ..functions.generators import MAX_PARAMS, Registry
from ..functions.hashing import blake3
from ..functions.keys import UNBOUNDED, Bound, prefix_bounds, within
from ..operators import blocks, maintenance, scans, writes
from ..sources.files import file_digest, file_size, read_ranges
from .training import Training, train

LOG = (
    "key binary, revision long, kind string, logical_len long, value binary, chunks array<struct<ord: int, begin: bigint, stop: bigint, object_id: bigint>>, "
    "source_id long, generator_id int, generator_version int, params binary, keeps boolean, place long"
)
OBJECTS = "object_id long, digest string, raw_len int, codec string, aux_id long, body binary, body_len int, blake3 binary"
PARAMS = "param_id long, kind string, version int, bytes binary"
SOURCES = "source_id long, kind string, location string, adapter_version int, revision long, bytes long, digest string, unix_ms long"
TABLES = {"log": LOG, "objects": OBJECTS, "sources": SOURCES, "params": PARAMS}
RETRIES = 16


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path, self.registry = spark, path.rstrip("/"), Registry()
        self.activity: Counter[str] = Counter()  # of this handle: gets, bytes, commits, puts, deletes, objects
        uri = urlparse(self.path)
        self._local = uri.path if uri.scheme in ("", "file") else None
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        config = config or Config()
        if not self._ids():
            meta = {"version": 1, "mode": config.mode, "block_size": config.block_size, "inline_max": config.inline_max, "next_revision": 1, "next_object": 1, "next_source": 1, "next_param": 1, "active": {}, "streams": {}, "generated": False, "uuid": uuid.uuid4().hex}
            self._publish(0, {"meta": meta, "tables": {t: [] for t in TABLES}, "durable": True})
        meta = self._commit()["meta"]
        if meta["version"] != 1:
            raise StoreError(f"format version {meta['version']}")
        # what a store was made with holds, whatever is asked for later
        self.config = Config(**{**config.__dict__, "mode": meta["mode"], "block_size": meta["block_size"], "inline_max": meta["inline_max"]})

    # --- commits -----------------------------------------------------------------------------
    def _p(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _ids(self) -> list[int]:
        folder = self._p(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _commit(self, id_: int | None = None) -> dict:
        id_ = self._ids()[-1] if id_ is None else id_
        stream = self._fs.open(self._p(f"{self.path}/_commits/{id_:020d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"id": id_}

    def _publish(self, id_: int, commit: dict) -> bool:
        """Create the commit if no other writer has; the file appears with all its content."""
        name, temp = f"{self.path}/_commits/{id_:020d}.json", f"{self.path}/_commits/.{uuid.uuid4().hex}"
        out = self._fs.create(self._p(temp), False)
        out.write(bytearray(json.dumps({k: v for k, v in commit.items() if k != "id"}).encode()))
        out.close()
        try:
            if self._local:
                folder = f"{self._local}/_commits"
                os.link(f"{folder}/{os.path.basename(temp)}", f"{folder}/{os.path.basename(name)}")
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._p(temp), self._p(name), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001  py4j wraps the Java exception
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(self._p(temp), False)

    def table(self, name: str, commit: dict | None = None) -> DataFrame:
        files = (commit or self._commit())["tables"][name]
        if not files:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in files])

    def _write(self, name: str, rows: DataFrame) -> str:
        file = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{file}")
        return file

    def log(self, commit: dict | None = None) -> DataFrame:
        """The log for reads: newest by place; ``removed`` rows count as tombstones."""
        rows = self.table("log", commit)
        return rows.withColumn("kind", F.when(F.col("kind") == "removed", "tombstone").otherwise(F.col("kind")))

    def state(self, commit: dict | None = None) -> DataFrame:
        rest = [c for c in self.log(commit).columns if c != "key"]
        best = self.log(commit).groupBy("key").agg(F.max_by(F.struct(*rest), "place").alias("r"))
        return best.select("key", *[F.col(f"r.{c}").alias(c) for c in rest]).where("kind <> 'tombstone'")

    def retained(self, commit: dict | None = None) -> DataFrame:
        """Current and replaced revisions that can be read, with ``is_current``."""
        after = Window.partitionBy("key").orderBy("place")
        rows = self.table("log", commit).withColumn("_kept", F.lead("keeps").over(after)).withColumn("is_current", F.lead("place").over(after).isNull())
        return rows.where(F.coalesce("_kept", F.lit(True)) & (F.col("kind") != "removed")).drop("_kept")

    def _alive(self, commit: dict) -> DataFrame:
        """The rows that a rewritten log needs, with ``is_current``: retained ones, and what hides them if their key is removed."""
        after = Window.partitionBy("key").orderBy("place")
        rows = self.table("log", commit).withColumn("_kept", F.coalesce(F.lead("keeps").over(after), F.lit(True))).withColumn("is_current", F.lead("place").over(after).isNull())
        rows = rows.withColumn("_reads", F.col("_kept") & (F.col("kind") != "removed"))
        rows = rows.withColumn("_some", F.max("_reads").over(Window.partitionBy("key")))
        return rows.where(F.col("_reads") | (F.col("is_current") & F.col("_some"))).drop("_kept", "_reads", "_some").withColumn("keeps", F.lit(True))

    # --- writes ------------------------------------------------------------------------------
    def write(
        self, ops: DataFrame, atomic: bool = True, source_id: int | None = None, durable: bool = True, tag: str | None = None, units: DataFrame | None = None
    ) -> DataFrame | None:
        """Apply operations (ord, key, op, value, expect, expect_revision) in order, in one commit.

        Returns their outcomes with revisions, cached until the caller releases them. ``atomic``: a conflict
        raises and nothing is written; else it is skipped. ``tag`` is "stream:number": a number that is not
        beyond the stream's last one (a replayed micro-batch) does nothing: None. ``units`` are encoded
        before (``prepare``).
        """
        ops = ops.persist()
        try:
            return self._commit_ops(ops, atomic, source_id, durable, tag, units)
        finally:
            ops.unpersist()

    def _commit_ops(self, ops: DataFrame, atomic: bool, source_id: int | None, durable: bool, tag: str | None, units: DataFrame | None) -> DataFrame | None:
        stream = None
        if tag:
            name, _, number = tag.rpartition(":")
            if not number.isdigit():
                raise InvalidArgument("tag: stream:number")
            stream = (name, int(number))
        wrong = ops.select("ord", writes.validation_error(F.col("key"), F.col("value"), F.col("op"), self.config).alias("error")).where("error is not null")
        if atomic and (bad := wrong.first()):
            raise (LimitExceeded if "long" in bad.error else InvalidArgument)(bad.error)
        ops_ = ops if atomic else ops.join(wrong.select("ord"), "ord", "left_anti")
        for _ in range(RETRIES):
            base = self._commit()
            if stream and base["meta"]["streams"].get(stream[0], -1) >= stream[1]:
                return None
            outcome = self._apply(ops_, base, atomic, source_id, durable, stream, units)
            if outcome is not None:
                return outcome
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def _apply(
        self, ops: DataFrame, base: dict, atomic: bool, source_id: int | None, durable: bool, stream: tuple[str, int] | None, units: DataFrame | None
    ) -> DataFrame | None:
        held: list[DataFrame] = []
        try:
            return self._applied(ops, base, atomic, source_id, durable, stream, units, held)
        finally:
            for rows in held:
                rows.unpersist()

    def _applied(self, ops, base, atomic, source_id, durable, stream, prepared, held: list[DataFrame]) -> DataFrame | None:
        meta = json.loads(json.dumps(base["meta"]))
        if stream:
            meta["streams"][stream[0]] = stream[1]
        # of the log only the keys of the batch, and of those no values
        heads = self.table("log", base).select("key", "kind", "revision", "place").join(ops.select("key").distinct(), "key", "left_semi")
        heads = heads.groupBy("key").agg(F.max_by(F.struct("kind", "revision"), "place").alias("r"))
        state = heads.where(~F.col("r.kind").isin("tombstone", "removed")).select("key", F.col("r.revision").alias("revision"))
        out = writes.write_batch_each(ops, state, meta["next_revision"] - 1, self.config.keep_history, held).persist()
        n = out.count()  # all of it is cached before what it was made from is released
        if atomic and (bad := out.where("status = 'conflict'").orderBy("ord").first()):
            held.append(out)
            raise RevisionConflict(bytes(bad.key), "its expectation", bad.actual)
        done = writes.together(out, n).where("status = 'ok'")
        if done.isEmpty() and not stream:
            return out
        puts = done.where("op = 'put'").withColumn("key_", F.struct("key", "ord"))
        inline = blocks.is_inline(F.octet_length("value"), self.config)
        small, large = puts.where(inline), puts.where(~inline)
        place = F.lit((base["id"] + 1) << 32) + F.col("ord")
        none = lambda kind: F.lit(None).cast(kind)
        length = F.octet_length("value").cast("long")
        chunks_type = "array<struct<ord: int, begin: bigint, stop: bigint, object_id: bigint>>"

        def row(kind: str, value, chunks, size):
            return ["key", "revision", F.lit(kind).alias("kind"), size.alias("logical_len"), value.alias("value"), chunks.alias("chunks"), F.lit(source_id).cast("long").alias("source_id"),
                    none("int").alias("generator_id"), none("int").alias("generator_version"), none("binary").alias("params"), F.lit(self.config.keep_history).alias("keeps"), place.alias("place")]

        rows = small.select(*row("inline", F.col("value"), none(chunks_type), length))
        dead = done.where("op = 'delete'")
        dead = dead.select(*row("tombstone" if self.config.keep_history else "removed", none("binary"), none(chunks_type), F.lit(0).cast("long")))
        rows = rows.unionByName(dead)
        new = {t: list(base["tables"][t]) for t in TABLES}
        if not large.isEmpty():
            cut = blocks.split(large.select(F.col("key_").alias("key"), "value"), self.config.block_size)
            old = None
            if self.config.shares and base["tables"]["objects"]:  # stored blocks of a new block's digest and length, decoded to compare their bytes
                new_ = cut.select(blocks.digest(F.col("block")).alias("digest"), F.octet_length("block").alias("raw_len")).distinct()
                old = self.blocks(self.table("objects", base).join(new_, ["digest", "raw_len"], "left_semi"), base)
            refs, objects = blocks.dedupe(cut, old, meta["next_object"] - 1, self.config.shares, held)
            objects = objects.select("object_id", "digest", "raw_len", "block")
            if prepared is not None:
                units = objects.join(prepared, ["digest", "raw_len", "block"])
            else:
                units = blocks.encode_units(objects, self.selector(base))
            file = self._write("objects", units.select("object_id", "digest", "raw_len", "codec", "aux_id", "body", "body_len", "blake3"))
            new["objects"].append(file)
            top = self.spark.read.parquet(f"{self.path}/{file}").agg(F.max("object_id")).first()[0]
            meta["next_object"] = max(meta["next_object"], (top or 0) + 1)
            lists = refs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "begin", "stop", "object_id"))).alias("list"))
            named = large.join(lists.withColumnRenamed("key", "key_"), "key_")
            rows = rows.unionByName(named.select(*row("chunks", none("binary"), F.col("list"), length)))
        file = self._write("log", rows)
        new["log"].append(file)
        top = self.spark.read.parquet(f"{self.path}/{file}").agg(F.max("revision")).first()[0]
        meta["next_revision"] = max(meta["next_revision"], (top or 0) + 1)
        if self._publish(base["id"] + 1, {"meta": meta, "tables": new, "durable": durable}):
            self.activity.update({"commits": 1, "objects": meta["next_object"] - base["meta"]["next_object"]})
            return out
        held.append(out)
        return None

    def _ops(self, ops: Iterable[tuple]) -> DataFrame:
        full = [(o[0], o[1], o[2] if len(o) > 2 else None, *(o[3] if len(o) > 3 and o[3] else ("any", None))) for o in ops]
        return writes.ops_from(self.spark, full)

    def write_batch(self, ops: Iterable[tuple]) -> list[int | None]:
        """Operations ("put", key, value, (expect, revision)) or ("delete", key, None, ...), all or none; a delete gives the deleted revision."""
        rows = self._outcomes(self.write(self._ops(ops)))
        given = {r.ord: r.revision for r in rows}
        return [r.revision if r.op == "put" else (given[r.touched] if r.touched is not None else r.actual) for r in rows]

    def _outcomes(self, out: DataFrame) -> list:
        """Outcomes of operations that came from the driver."""
        rows = out.select("ord", "op", "status", "actual", "touched", "revision").orderBy("ord").collect()
        out.unpersist()
        self.activity.update(f"{r.op}s" for r in rows if r.status == "ok")
        return rows

    def write_batch_each(self, ops: Iterable[tuple], durable: bool = True) -> list[str]:
        """As write_batch, but operations that fail are skipped: each one's status."""
        ops = list(ops)
        got = {r.ord: r.status for r in self._outcomes(self.write(self._ops(ops), atomic=False, durable=durable))}
        return [got.get(k, "invalid") for k in range(len(ops))]

    def put(self, key: bytes, value: bytes, expect: str = "any", revision: int | None = None) -> int:
        return self.write_batch([("put", key, value, (expect, revision))])[0]

    def delete(self, key: bytes, expect: str = "any", revision: int | None = None) -> bool:
        if not key:
            raise InvalidArgument("empty key")
        return self._outcomes(self.write(self._ops([("delete", key, None, (expect, revision))])))[0].status == "ok"

    def prepare(self, ops: Iterable[tuple] | DataFrame) -> Prepared:
        """Operations checked and their blocks encoded now, to be applied later by this store alone."""
        rows = ops if isinstance(ops, DataFrame) else self._ops(ops)
        base, file = self._commit(), f"prepared/{uuid.uuid4().hex}"
        wrong = writes.validation_error(F.col("key"), F.col("value"), F.col("op"), self.config)
        rows.withColumn("error", wrong).write.parquet(f"{self.path}/{file}/ops")
        rows = self.spark.read.parquet(f"{self.path}/{file}/ops")
        large = rows.where("error is null and op = 'put'").where(~blocks.is_inline(F.octet_length("value"), self.config))
        cut = blocks.split(large.select(F.col("ord").alias("key"), "value"), self.config.block_size).withColumn("digest", blocks.digest(F.col("block"))).withColumn("raw_len", F.octet_length("block"))
        each = cut.groupBy("digest", "raw_len", "block").agg(F.collect_set("key").alias("ords"))
        blocks.encode_units(each, self.selector(base)).write.parquet(f"{self.path}/{file}/units")
        return Prepared(base["meta"]["uuid"], file)

    def write_prepared_each(self, prepared: Prepared) -> dict[int, str]:
        """The status of each prepared operation, by ord: invalid ones, and ones whose dictionary is gone, are skipped."""
        base = self._commit()
        if prepared.store != base["meta"]["uuid"]:
            raise InvalidArgument("prepared by another store")
        rows, units = (self.spark.read.parquet(f"{self.path}/{prepared.file}/{name}") for name in ("ops", "units"))
        known = self.table("params", base).select(F.col("param_id").alias("aux_id"))
        lost = units.where("aux_id <> 0").join(known, "aux_id", "left_anti").select(F.explode("ords").alias("ord")).distinct()
        bad = rows.where("error is not null").select("ord", F.lit("invalid").alias("status")).unionByName(lost.withColumn("status", F.lit(MissingDependency.__name__)))
        out = self.write(rows.drop("error").join(bad, "ord", "left_anti"), atomic=False, units=units.drop("ords"))
        return {r.ord: r.status for r in [*bad.collect(), *self._outcomes(out)]}

    def put_generated(self, key: bytes, generator: int, version: int, params: bytes, expect: str = "any", revision: int | None = None) -> int:
        """Only the parameters and the digest of what they generate are stored."""
        if bad := self._ops([("put", key, b"")]).select(writes.validation_error(F.col("key"), F.col("value"), F.col("op"), self.config)).first()[0]:
            raise (LimitExceeded if "long" in bad else InvalidArgument)(bad)
        if len(params) > MAX_PARAMS:
            raise LimitExceeded("parameters")
        made = self.registry.get(generator, version)
        length = made.length(params)
        if length > self.config.max_value:
            raise LimitExceeded("value too long")
        digest = blake3(made.whole(params))
        for _ in range(RETRIES):
            base = self._commit()
            row = self._row(key, base).select("revision").first()
            actual = row and row.revision
            if (expect == "absent" and actual is not None) or (expect == "revision" and (actual is None or actual != revision)):
                raise RevisionConflict(key, "its expectation", actual)
            meta = {**base["meta"], "generated": True}
            given, meta["next_revision"] = meta["next_revision"], meta["next_revision"] + 1
            row = (key, given, "generated", length, digest, None, None, generator, version, params, self.config.keep_history, (base["id"] + 1) << 32)
            new = {t: list(f) for t, f in base["tables"].items()}
            new["log"].append(self._write("log", self.spark.createDataFrame([row], LOG)))
            if self._publish(base["id"] + 1, {"meta": meta, "tables": new, "durable": True}):
                return given
        raise RevisionConflict(key, "the newest commit", base["id"])

    def sync(self) -> int:
        """Publish that everything so far is durable; the newest commit's id."""
        for _ in range(RETRIES):
            base = self._commit()
            if base["durable"] or self._publish(base["id"] + 1, {**base, "durable": True}):
                return self._ids()[-1]
        raise RevisionConflict(b"", "the newest commit", base["id"])

    # --- units -------------------------------------------------------------------------------
    def params(self, commit: dict | None = None) -> dict[int, bytes]:
        """The dictionaries and templates there are: a few, of bounded size."""
        return {r.param_id: bytes(r.bytes) for r in self.table("params", commit).collect()}

    def selector(self, commit: dict | None = None) -> Selector:
        commit = commit or self._commit()
        active = commit["meta"]["active"]
        known = self.params(commit) if active else {}
        pick = lambda kind: (active[kind], known[active[kind]]) if kind in active else None
        return Selector(self.config.policy, self.config.mode, pick("zstd_dict"), pick("template"))

    def blocks(self, objects: DataFrame, commit: dict | None = None) -> DataFrame:
        """(object_id, digest, raw_len, block): decoded units; one that can't be decoded raises."""
        done = blocks.decode_units(objects, self.params(commit), self.config.verify_on_read)
        block = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("IntegrityError: "), "problem")).cast("binary")).otherwise(F.col("data"))
        return done.select("object_id", "digest", "raw_len", block.alias("block"))

    def install_param(self, kind: str, raw: bytes) -> int:
        """A dictionary (zstd_dict) or template that new units use from now on; it is never changed."""
        if self.config.mode == "pure":
            raise Unsupported("pure mode has no parameters")
        for _ in range(RETRIES):
            base = self._commit()
            meta = json.loads(json.dumps(base["meta"]))
            id_, meta["next_param"] = meta["next_param"], meta["next_param"] + 1
            meta["active"][kind] = id_
            new = {t: list(f) for t, f in base["tables"].items()}
            new["params"].append(self._write("params", self.spark.createDataFrame([(id_, kind, 1, raw)], PARAMS)))
            if self._publish(base["id"] + 1, {**base, "meta": meta, "tables": new}):
                return id_
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def train(self, kind: str, samples: int = 2000, size: int = 64 * 1024, uses: int = 10_000, prefix: bytes = b"") -> Training:
        """Train on at most ``samples`` current values under a prefix, and install what is expected to save bytes.

        The samples are the keys with the smallest hashes, so that they come from all over the prefix, each of at
        most ``size`` bytes: the driver holds samples * size bytes at most.
        """
        commit = self._commit()
        rows = self.state(commit).where(within(F.col("key"), *prefix_bounds(prefix))).where(F.col("logical_len").between(1, size))
        asked = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(samples)
        found = self.values(self.state(commit).join(asked, "key", "left_semi"), commit).orderBy("key")
        return train(self, kind, [bytes(r.value) for r in found.select("value").collect()], size, uses)

    # --- reads -------------------------------------------------------------------------------
    def values(self, rows: DataFrame, commit: dict | None = None) -> DataFrame:
        """(key, revision, logical_len, value) of log rows; generated ones are made and held against their length and digest."""
        commit = commit or self._commit()
        out = self._stored(rows.where("kind <> 'generated'"), commit)
        if not commit["meta"].get("generated", True):
            return out
        made = rows.where("kind = 'generated'").select("key", "revision", "logical_len", "value", "generator_id", "generator_version", "params")
        return out.unionByName(made.mapInArrow(_generate(self.registry), "key binary, revision long, logical_len long, value binary"))

    def _stored(self, rows: DataFrame, commit: dict) -> DataFrame:
        if not commit["tables"]["objects"]:  # no block to read: every value stands in its row
            lost = F.raise_error(F.lit("IntegrityError: a block is missing")).cast("binary")
            return rows.select("key", "revision", "logical_len", F.when(F.col("kind") == "chunks", lost).otherwise(F.col("value")).alias("value"))
        refs = rows.where("kind = 'chunks'").select(F.struct("key", "revision").alias("key"), F.explode("chunks").alias("c")).select("key", "c.*")
        needed = self.table("objects", commit).join(refs.select("object_id").distinct(), "object_id", "left_semi")
        whole = blocks.reassemble(refs, self.blocks(needed, commit))
        joined = rows.join(whole.select(F.col("key").alias("_key"), F.col("value").alias("_value"), "complete"), F.struct("key", "revision") == F.col("_key"), "left")
        broken = (F.col("kind") == "chunks") & ~F.coalesce("complete", F.lit(False))
        value = F.when(broken, F.raise_error(F.lit("IntegrityError: a block is missing")).cast("binary")).when(F.col("kind") == "chunks", F.col("_value")).otherwise(F.col("value"))
        return joined.select("key", "revision", "logical_len", value.alias("value"))

    def _row(self, key: bytes, commit: dict | None = None) -> DataFrame:
        return self.log(commit).where(F.col("key") == F.lit(key)).orderBy(F.desc("place")).limit(1).where("kind <> 'tombstone'")

    def _value(self, rows: DataFrame) -> bytes | None:
        row = rows.first()
        if row is None:
            return None
        return bytes(self.values(rows).first().value)

    def get(self, key: bytes) -> bytes | None:
        out = self._value(self._row(key))
        self.activity.update({"gets": 1, "bytes": len(out or b"")})
        return out

    def get_range(self, key: bytes, offset: int, length: int) -> bytes | None:
        """Bytes [offset, offset + length), clipped at the end; only the blocks that it touches are read."""
        row = self._row(key).first()
        if row is None:
            return None
        if offset > row.logical_len or offset < 0 or length < 0:
            raise InvalidArgument("offset beyond the value")
        length = min(length, row.logical_len - offset)
        if row.kind == "generated":
            return self.registry.get(row.generator_id, row.generator_version).range(bytes(row.params), offset, length)
        if row.kind == "inline" or not length:
            return bytes(row.value or b"")[offset : offset + length]
        refs = self._row(key).select("key", F.explode("chunks").alias("c")).select("key", "c.*")
        hit = refs.where((F.col("stop") > offset) & (F.col("begin") < offset + length))
        needed = self.table("objects").join(hit.select("object_id"), "object_id", "left_semi")
        return bytes(blocks.reassemble(hit, self.blocks(needed), offset, length).first().value)

    def head(self, key: bytes) -> tuple[int, int] | None:
        row = self._row(key).select("revision", "logical_len").first()
        return None if row is None else (row.revision, row.logical_len)

    def revisions(self) -> DataFrame:
        """(key, revision, logical_len, value) of all that ``get_at`` can give."""
        commit = self._commit()
        return self.values(self.retained(commit).where("kind <> 'tombstone'").drop("is_current"), commit)

    def get_at(self, key: bytes, revision: int) -> bytes | None:
        """The value that the key has or, where history is kept, had at exactly this revision."""
        rows = self.retained().where(F.col("key") == F.lit(key))
        return self._value(rows.where((F.col("revision") == revision) & (F.col("kind") != "tombstone")).limit(1))

    def scan(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, reverse: bool = False, limit: int = 0, with_values: bool = True) -> DataFrame:
        commit = self._commit()
        if not with_values:
            return scans.scan(self.state(commit), start, end, reverse, limit, False)
        picked = scans.scan(self.state(commit).drop("value"), start, end, reverse, limit, False).select("key")
        rows = self.values(self.state(commit).join(picked, "key", "left_semi"), commit)
        return rows.orderBy(F.desc("key") if reverse else F.asc("key"))

    def history(self, key: bytes) -> DataFrame:
        rows = self.retained().where(F.col("key") == F.lit(key))
        return rows.select("key", "revision", "kind", "logical_len", "is_current").orderBy("revision")

    # --- maintenance -------------------------------------------------------------------------
    def _rewrite(self, tables: dict[str, DataFrame], base: dict) -> bool:
        new = {t: list(f) for t, f in base["tables"].items()}
        for name, rows in tables.items():
            new[name] = [self._write(name, rows)]
        return self._publish(base["id"] + 1, {**base, "tables": new})

    def prune_history(self, keep_last: int, key: bytes | None = None) -> int:
        """Of each key (or one) the newest ``keep_last`` replaced revisions stay; how many went."""
        for _ in range(RETRIES):
            base = self._commit()
            rank = F.row_number().over(Window.partitionBy("key", "is_current").orderBy(F.desc("place")))
            rows = self._alive(base).withColumn("_rank", rank)
            gone = ~F.col("is_current") & (F.col("_rank") > keep_last)
            if key is not None:
                gone = gone & (F.col("key") == F.lit(key))
            n = rows.where(gone).count()
            if not n or self._rewrite({"log": rows.where(~gone).drop("_rank", "is_current")}, base):
                return n
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def refs(self, commit: dict | None = None) -> DataFrame:
        rows = self.retained(commit).where("kind = 'chunks'")
        return rows.select(F.struct("key", "revision").alias("key"), F.explode("chunks").alias("c")).select("key", "c.*")

    def stats(self) -> DataFrame:
        newest = self.table("log").groupBy("key").agg(F.max_by(F.struct("kind", "logical_len"), "place").alias("r")).select("r.*")
        return maintenance.stats(newest.where("kind <> 'removed'"))

    def usage(self) -> DataFrame:
        """Units and bytes per codec, inline values as raw."""
        inline = self.state().where("kind = 'inline'").select(F.lit("raw").alias("codec"), F.col("logical_len").cast("int").alias("raw_len"), F.col("logical_len").cast("int").alias("body_len"))
        return maintenance.usage_by_codec(self.table("objects").select("codec", "raw_len", "body_len").unionByName(inline))

    def inspect(self, key: bytes) -> DataFrame:
        """One row per unit of the key's value: codec, sizes, references, and whether its bytes count here."""
        commit = self._commit()
        refs = self._row(key, commit).select("key", F.explode("chunks").alias("c")).select("key", "c.*")
        return blocks.inspect(refs, self.table("objects", commit), blocks.refcounts(self.refs(commit)))

    def verify(self, deep: bool = False) -> DataFrame:
        """(problem, n, fatal) of one commit; ``deep`` decodes every unit and makes every generated value."""
        commit = self._commit()
        objects, refs, rows, meta = self.table("objects", commit), self.refs(commit), self.retained(commit), commit["meta"]
        made = rows.where("kind = 'generated'")
        known = self.spark.createDataFrame([(i, v) for i, v, _ in self.registry.list()], "generator_id int, generator_version int")
        counters = {"revision": (rows, "revision"), "object": (objects, "object_id"), "source": (self.table("sources", commit), "source_id"), "param": (self.table("params", commit), "param_id")}
        more = {
            "dangling_source": maintenance.dangling_sources(rows, self.table("sources", commit)),
            "unknown_generator": made.join(known, ["generator_id", "generator_version"], "left_anti"),
            "missing_param": maintenance.missing_params(objects, self.table("params", commit)),
            "counter": maintenance.counter_check({k: meta[f"next_{k}"] for k in counters}, counters).where("not ok"),
        }
        if deep:
            checked = made.join(known, ["generator_id", "generator_version"], "left_semi").select("key", "revision", "logical_len", "value", "generator_id", "generator_version", "params")
            kind = "key binary, revision long, logical_len long, value binary"
            more["generated"] = checked.mapInArrow(_generate(self.registry, report=True), kind).where("value is null")
        return maintenance.verify(refs, objects, blocks.refcounts(refs), objects.select("digest", "raw_len", "object_id"), objects if deep else None, self.params(commit), more)

    def gc(self) -> int:
        """Drop objects that no retained revision names, and parameters that no object and no new unit needs; how many objects."""
        for _ in range(RETRIES):
            base = self._commit()
            objects, params = self.table("objects", base), self.table("params", base)
            keep = maintenance.collect_garbage(self.refs(base), objects, objects.select("digest", "raw_len", "object_id"))["objects"]
            n = objects.count() - keep.count()
            tables = {"objects": keep} if n else {}
            if base["tables"]["params"]:
                active = self.spark.createDataFrame([(i,) for i in base["meta"]["active"].values()], "param_id long")
                needed = params.join(keep.select(F.col("aux_id").alias("param_id")).unionByName(active).distinct(), "param_id", "left_semi")
                if params.count() > needed.count():
                    tables["params"] = needed
            if not tables or self._rewrite(tables, base):
                return n
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def compact(self) -> None:
        """Rewrite the log, sorted by key, and without the revisions that nobody can read."""
        for _ in range(RETRIES):
            base = self._commit()
            if self._rewrite({"log": maintenance.compacted(self._alive(base).drop("is_current"))}, base):
                return
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def vacuum(self, older_than: float = 86_400.0) -> dict[str, int]:
        """Delete files that the newest commit doesn't name and that are older than so many seconds, and older commits.

        Younger files may be of a writer or an import that has not published yet. Readers of older commits
        lose them. Returns files deleted, and bytes before and after.
        """
        base = self._commit()
        named = {f for files in base["tables"].values() for f in files}
        limit, files, before, gone = (time.time() - older_than) * 1000, 0, 0, 0
        for folder in (*TABLES, "prepared"):
            if not self._fs.exists(self._p(f"{self.path}/{folder}")):
                continue
            for s in self._fs.listStatus(self._p(f"{self.path}/{folder}")):
                size = self._fs.getContentSummary(s.getPath()).getLength()
                before += size
                if f"{folder}/{s.getPath().getName()}" not in named and s.getModificationTime() <= limit:
                    files, gone = files + 1, gone + size
                    self._fs.delete(s.getPath(), True)
        for id_ in self._ids()[:-1]:
            if id_ < base["id"]:
                self._fs.delete(self._p(f"{self.path}/_commits/{id_:020d}.json"), False)
        return {"files": files, "before": before, "after": before - gone}

    def register_source(self, kind: str, location: str) -> int:
        """The id of (kind, location), registered now if it is new."""
        for _ in range(RETRIES):
            base = self._commit()
            known = source_ids(self.table("sources", base).where((F.col("kind") == kind) & (F.col("location") == location))).first()
            known = known and known.source_id
            if known is not None:
                return known
            meta = dict(base["meta"])
            id_, meta["next_source"] = meta["next_source"], meta["next_source"] + 1
            new = {t: list(f) for t, f in base["tables"].items()}
            new["sources"].append(self._write("sources", self.spark.createDataFrame([(id_, kind, location, 1, None, None, None, None)], SOURCES)))
            if self._publish(base["id"] + 1, {**base, "meta": meta, "tables": new}):
                return id_
        raise RevisionConflict(b"", "the newest commit", base["id"])

    def sources(self) -> DataFrame:
        rows = self.table("sources")
        return log_sources(rows).orderBy("source_id")

    def import_files(self, files: dict[bytes, str]) -> dict[bytes, int]:
        """Each file byte for byte under the key given for it; revisions."""
        return {key: self.import_file(key, path) for key, path in files.items()}

    def import_file(self, key: bytes, path: str, expect: str = "any", revision: int | None = None) -> int:
        """A file byte for byte under ``key``, with its source and last import, in one commit; the new revision.

        Tasks read ranges of it, so that its size is bounded by ``max_value`` and no memory. Blocks are staged as
        files that no commit names; a failure deletes them, and nothing is seen of the import.
        """
        size = file_size(self.spark, path)
        if bad := self._ops([("put", key, b"")]).select(writes.validation_error(F.col("key"), F.col("value"), F.col("op"), self.config)).first()[0]:
            raise (LimitExceeded if "long" in bad else InvalidArgument)(bad)
        if size > self.config.max_value:
            raise LimitExceeded("value too long")
        digest = file_digest(self.spark, path)
        for _ in range(RETRIES):
            base, staged, held = self._commit(), [], []
            try:
                if (done := self._import(key, path, size, digest, expect, revision, base, staged, held)) is not None:
                    return done
                self._abandon(staged)  # another writer was first
            except BaseException:
                self._abandon(staged)
                raise
            finally:
                for rows in held:
                    rows.unpersist()
        raise RevisionConflict(key, "the newest commit", base["id"])

    def _abandon(self, staged: list[str]) -> None:
        for file in staged:
            self._fs.delete(self._p(f"{self.path}/{file}"), True)

    def _import(self, key: bytes, path: str, size: int, digest: str, expect: str, revision: int | None, base: dict, staged: list[str], held: list[DataFrame]) -> int | None:
        row = self._row(key, base).select("revision").first()
        actual = row and row.revision
        if (expect == "absent" and actual is not None) or (expect == "revision" and (actual is None or actual != revision)):
            raise RevisionConflict(key, "its expectation", actual)
        meta, new = json.loads(json.dumps(base["meta"])), {t: list(f) for t, f in base["tables"].items()}

        def stage(table: str, rows: DataFrame) -> str:
            staged.append(self._write(table, rows))
            new[table].append(staged[-1])
            return f"{self.path}/{staged[-1]}"

        known = source_ids(self.table("sources", base).where((F.col("kind") == "file") & (F.col("location") == path))).first()
        source = known.source_id if known else meta["next_source"]
        meta["next_source"] += known is None
        given, meta["next_revision"] = meta["next_revision"], meta["next_revision"] + 1
        inline = size <= self.config.inline_max or not size
        value = read_ranges(self.spark, path, size, max(size, 1)).select("block").first().block if inline and size else (b"" if inline else None)
        lists = self.spark.createDataFrame([(None,)], "chunks array<struct<ord: int, begin: bigint, stop: bigint, object_id: bigint>>")
        if not inline:
            cut = read_ranges(self.spark, path, size, self.config.block_size).select(F.lit(key).alias("key"), "ord", "begin", "stop", "block")
            old = None
            if self.config.shares and base["tables"]["objects"]:
                new_ = cut.select(blocks.digest(F.col("block")).alias("digest"), F.octet_length("block").alias("raw_len")).distinct()
                old = self.blocks(self.table("objects", base).join(new_, ["digest", "raw_len"], "left_semi"), base)
            refs, objects = blocks.dedupe(cut, old, meta["next_object"] - 1, self.config.shares, held)
            units = blocks.encode_units(objects.select("object_id", "digest", "raw_len", "block"), self.selector(base))
            file = stage("objects", units.select("object_id", "digest", "raw_len", "codec", "aux_id", "body", "body_len", "blake3"))
            top = self.spark.read.parquet(file).agg(F.max("object_id")).first()[0]
            meta["next_object"] = max(meta["next_object"], (top or 0) + 1)
            lists = refs.agg(F.array_sort(F.collect_list(F.struct("ord", "begin", "stop", "object_id"))).alias("chunks"))  # one row of 28 bytes a block
        kind, place = F.lit("inline" if inline else "chunks"), F.lit((base["id"] + 1) << 32)
        columns = {"key": F.lit(key), "revision": F.lit(given), "kind": kind, "logical_len": F.lit(size), "value": F.lit(value), "chunks": F.col("chunks"), "source_id": F.lit(source)}
        columns |= {"generator_id": F.lit(None), "generator_version": F.lit(None), "params": F.lit(None), "keeps": F.lit(self.config.keep_history), "place": place}
        types = {f.name: f.dataType for f in self.table("log", base).schema}
        stage("log", lists.select(*[c.cast(types[n]).alias(n) for n, c in columns.items()]))
        stage("sources", self.spark.createDataFrame([(source, "file", path, 1, given, size, digest, int(time.time() * 1000))], SOURCES))
        return given if self._publish(base["id"] + 1, {"meta": meta, "tables": new, "durable": True}) else None


@dataclass(frozen=True)
class Prepared:
    """Operations that a store has encoded: its identity and where they lie in it."""

    store: str
    file: str


def _generate(registry: Registry, report: bool = False):
    """Generated rows with what their generator makes; with ``report`` an empty value, or null where that isn't what was stored."""
    schema = pa.schema([("key", pa.binary()), ("revision", pa.int64()), ("logical_len", pa.int64()), ("value", pa.binary())])

    def made(r: dict) -> bytes | None:
        try:
            out = registry.get(r["generator_id"], r["generator_version"]).whole(r["params"])
            if len(out) != r["logical_len"] or blake3(out) != r["value"]:
                raise StoreError("generated value")
            return b"" if report else out
        except Exception:
            if report:
                return None
            raise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a value at a time: they may be long
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "revision": r["revision"], "logical_len": r["logical_len"], "value": made(r)}], schema=schema)

    return run


def source_ids(rows: DataFrame) -> DataFrame:
    """(kind, location, source_id): the lowest id that each source was registered with."""
    return rows.groupBy("kind", "location").agg(F.min("source_id").alias("source_id"))


def log_sources(rows: DataFrame) -> DataFrame:
    """The newest import of each source."""
    rest = [c for c in rows.columns if c != "source_id"]
    best = rows.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.coalesce("unix_ms", F.lit(0))).alias("r"))
    return best.select("source_id", *[F.col(f"r.{c}").alias(c) for c in rest])
