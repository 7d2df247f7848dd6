"""Statistics, verification and garbage collection, as aggregates and joins over the stored tables.

refs: (key, ord, object_id, begin, stop) of every retained manifest; objects: (object_id, digest, raw_len, ...);
stored counts: (object_id, refs); candidates: (digest, raw_len, object_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import IntegrityError
from .blocks import decode_units


def stats(state: DataFrame) -> DataFrame:
    """records, tombstones and logical bytes of (kind, logical_len), in one pass."""
    dead = F.col("kind") == "tombstone"
    return state.agg(
        F.count_if(~dead).alias("records"), F.count_if(dead).alias("tombstones"), F.coalesce(F.sum(F.when(~dead, F.col("logical_len"))), F.lit(0)).alias("logical_bytes")
    )


def usage_by_codec(units: DataFrame) -> DataFrame:
    """Units, raw, body and envelope bytes (64 of header each) per codec."""
    return units.groupBy("codec").agg(
        F.count("*").alias("units"), F.sum("raw_len").alias("raw_bytes"), F.sum("body_len").alias("body_bytes"), F.sum(F.col("body_len") + 64).alias("envelope_bytes")
    )


def byte_entropy(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Order-0 entropy of the bytes of each group, in bits a byte: 256 counts per group and batch leave a task, not a row per byte."""
    kind = rows.schema[by].dataType.simpleString()
    schema = pa.schema([(by, to_arrow_type(rows.schema[by].dataType)), ("byte", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            for k in range(len(groups.dictionary)):
                data = b"".join(v for v in batch.column(1).filter(pa.array(codes == k)).to_pylist() if v)
                n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array([k] * len(some), pa.int32())).cast(schema.field(0).type), pa.array(some.astype(np.int32)), pa.array(n[some])], schema=schema)

    counts = rows.select(by, F.col(value).cast("binary")).mapInArrow(run, f"{by} {kind}, byte int, n long").groupBy(by, "byte").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("p", F.col("n") / total).groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def table_totals(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Entries and payload per table of (rows, key column, value column), and in all as ``total``."""
    out = None
    for name, (rows, key, value) in tables.items():
        one = rows.select(F.lit(name).alias("table_name"), (F.octet_length(key) + F.octet_length(value)).cast("long").alias("size"))
        out = one if out is None else out.unionByName(one)
    sums = out.rollup("table_name").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("payload"))
    return sums.select(F.coalesce("table_name", F.lit("total")).alias("table_name"), "entries", "payload")


def expected_refs(refs: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """References per object from manifests and, one each, unfinished imports."""
    all_ = refs.select("object_id") if pending is None else refs.select("object_id").unionByName(pending.select("object_id"))
    return all_.groupBy("object_id").agg(F.count("*").alias("expected"))


def refcount_drift(refs: DataFrame, objects: DataFrame, stored: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Existing objects whose stored count differs from the references there are, or is missing."""
    both = expected_refs(refs, pending).join(stored.select("object_id", F.col("refs").alias("stored")), "object_id", "full_outer")
    both = both.select("object_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.where("expected <> stored").join(objects.select("object_id"), "object_id", "left_semi")


def missing_objects(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that manifests name and that are not stored, with how often they are named."""
    return refs.join(objects.select("object_id"), "object_id", "left_anti").groupBy("object_id").agg(F.count("*").alias("references"))


def orphans(refs: DataFrame, objects: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Objects that nothing names (``reason`` unreferenced), and counts without an object (no_object)."""
    named = refs.select("object_id").distinct()
    out = objects.select("object_id").join(named, "object_id", "left_anti").withColumn("reason", F.lit("unreferenced"))
    if stored is not None:
        out = out.unionByName(stored.select("object_id").join(objects.select("object_id"), "object_id", "left_anti").withColumn("reason", F.lit("no_object")))
    return out


def length_conflicts(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that chunks of different lengths name, or whose own length is another one."""
    used = refs.groupBy("object_id").agg(F.min(F.col("stop") - F.col("begin")).alias("least"), F.max(F.col("stop") - F.col("begin")).alias("most"))
    both = used.join(objects.select("object_id", "raw_len"), "object_id")
    return both.where("least <> most or least <> raw_len")


def candidate_report(candidates: DataFrame, objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Each candidate as live, stale (gone and unreferenced) or dangling (gone but referenced, id 0, or of other content)."""
    there = objects.select("object_id", F.col("digest").alias("own_digest"), F.col("raw_len").alias("own_len"))
    named = refs.select("object_id").distinct().withColumn("named", F.lit(True))
    rows = candidates.join(there, "object_id", "left").join(named, "object_id", "left")
    status = candidate_status(F.col("object_id"), F.col("named").isNotNull(), F.struct("digest", "raw_len"), F.struct(F.col("own_digest").alias("digest"), F.col("own_len").alias("raw_len")))
    return rows.select("object_id", "digest", "raw_len", status.alias("status"))


def candidate_status(object_id: Column, named: Column, says: Column, own: Column) -> Column:
    """The status of a candidate that says (digest, raw_len) of an object, beside the object's own, null if it is gone."""
    gone = own["raw_len"].isNull()
    return (
        F.when(object_id == 0, "dangling")
        .when(gone & ~named, "stale")
        .when(gone | (says["digest"] != own["digest"]) | (says["raw_len"] != own["raw_len"]), "dangling")
        .otherwise("live")
    )


def missing_params(units: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters that units need and that are missing or of the wrong kind."""
    kind = F.when(F.col("codec") == "template", "template").otherwise("zstd_dict")
    needed = units.where("aux_id <> 0").select(F.col("aux_id").alias("param_id"), kind.alias("kind")).distinct()
    return needed.join(params.select("param_id", "kind"), ["param_id", "kind"], "left_anti")


def bad_units(units: DataFrame, params: dict[int, bytes] | None = None) -> DataFrame:
    """Units that don't decode, or not to their digest."""
    return decode_units(units, params, verify=True).where(F.col("problem").isNotNull()).drop("data")


def counter_check(counters: dict[str, int], used: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per id space the largest id in use, and whether the counter is beyond it."""
    out = None
    for name, (rows, column) in used.items():
        one = rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("largest")).select(F.lit(name).alias("space"), F.lit(counters[name]).cast("long").alias("next_id"), "largest")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.col("next_id") > F.col("largest"))


def dangling_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    return records.where("source_id is not null").join(sources.select("source_id"), "source_id", "left_anti").select("source_id").distinct()


def reconciled(refs: DataFrame, objects: DataFrame, stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """What all tables say of each object, one row an id: references with least and most length, objects, counts and candidates as lists.

    Each table is read once, and rows without bytes are shuffled once. Null ids are nobody's: a row each table.
    """
    size, said = (F.col("stop") - F.col("begin")).cast("long"), F.struct("digest", F.col("raw_len").cast("long").alias("raw_len"))
    parts = {"ref": (refs, "size", size), "own": (objects, "object", said), "count": (stored, "count", F.struct(F.col("refs").cast("long").alias("refs"))), "says": (candidates, "candidate", said)}
    rows = None
    for tag, (table, name, value) in parts.items():
        one = table.select(F.col("object_id").cast("long").alias("object_id"), F.lit(tag).alias("tag"), value.alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy("object_id", F.when(F.col("object_id").isNull(), F.col("tag")).alias("of")).agg(
        F.count_if(F.col("tag") == "ref").alias("refs"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.collect_list("object").alias("objects"), F.collect_list(F.when(F.col("tag") == "count", F.col("count"))).alias("counts"), F.collect_list("candidate").alias("candidates"),
    )


def verify(
    refs: DataFrame, objects: DataFrame, stored: DataFrame, candidates: DataFrame, units: DataFrame | None = None, params: dict[int, bytes] | None = None,
    more: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """(problem, n, fatal): orphans and stale candidates are no errors; each row of ``more`` is one.

    The counts are those of ``missing_objects``, ``refcount_drift``, ``length_conflicts``, ``orphans`` and
    ``candidate_report``, from one pass over the tables.
    """
    rows = reconciled(refs, objects, stored, candidates)
    there, named, own, counts = F.size("objects") > 0, F.col("refs") > 0, F.col("objects"), F.col("counts")
    drift = F.when(F.size(counts) == 0, named.cast("int")).otherwise(F.size(F.filter(counts, lambda c: F.coalesce(c["refs"], F.lit(0)) != F.col("refs"))))
    off = F.size(F.filter(own, lambda o: (F.col("least") != F.col("most")) | (F.col("least") != o["raw_len"])))
    lost = F.array(F.struct(F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("raw_len")))
    status = F.flatten(F.transform("candidates", lambda c: F.transform(F.when(there, own).otherwise(lost), lambda o: candidate_status(F.col("object_id"), named, c, o))))
    found = {
        "missing_object": ((named & ~there).cast("int"), True),
        "refcount": (F.when(there, drift), True),
        "length": (F.when(named, off), True),
        "orphan": (F.when(named, 0).otherwise(F.size(own)) + F.when(there, 0).otherwise(F.size(counts)), False),
        "stale_candidate": (F.size(F.filter("status", lambda x: x == "stale")), False),
        "dangling_candidate": (F.size(F.filter("status", lambda x: x == "dangling")), True),
    }
    sums = rows.withColumn("status", status).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(name) for name, (n, _) in found.items()])
    each = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(name).alias("n"), F.lit(fatal).alias("fatal")) for name, (_, fatal) in found.items()])
    out = sums.select(F.explode(each).alias("r")).select("r.*")
    for name, table in {**(more or {}), **({} if units is None else {"unit": bad_units(units, params)})}.items():
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n", F.lit(True).alias("fatal")))
    return out


def is_ok(report: DataFrame) -> bool:
    return report.where("fatal and n > 0").isEmpty()


def collect_garbage(refs: DataFrame, objects: DataFrame, candidates: DataFrame, undecodable: int = 0) -> dict[str, DataFrame]:
    """What remains: objects that manifests name, counts anew, candidates of what remains. Refuses if a manifest can't be read."""
    if undecodable:
        raise IntegrityError("a manifest can't be decoded: nothing is collected")
    named = refs.select("object_id").distinct()
    keep = objects.join(named, "object_id", "left_semi")
    return {
        "objects": keep,
        "refcounts": expected_refs(refs).join(keep.select("object_id"), "object_id", "left_semi").withColumnRenamed("expected", "refs"),
        "candidates": candidates.join(keep.select("object_id", "digest", "raw_len"), ["object_id", "digest", "raw_len"], "left_semi"),
    }


def compacted(rows: DataFrame, by: str = "key") -> DataFrame:
    """Rows dealt out by ranges of the key and sorted: the layout that makes file statistics skip most files."""
    return rows.repartitionByRange(by).sortWithinPartitions(by)
