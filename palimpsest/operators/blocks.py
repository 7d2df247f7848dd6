"""The block layer: values cut into blocks, shared byte for byte, counted and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CODEC_IDS, Config
from ..functions.codecs import Selector, decode
from ..functions.hashing import blake3_many
from .writes import numbered


def is_inline(length: Column, config: Config) -> Column:
    """Values up to ``inline_max`` stay in their manifest and are never shared; so does the empty value."""
    return (length <= config.inline_max) | (length == 0)


def split(values: DataFrame, block_size: int) -> DataFrame:
    """(key, ord, begin, stop, block) of (key, value): blocks of ``block_size``, the last may be short; none of an empty value."""
    n = F.octet_length("value")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / block_size).cast("int") - 1))
    rows = values.where(n > 0).select("key", "value", F.explode(places).alias("ord"))
    begin = F.col("ord") * block_size
    return rows.select(
        "key", "ord", begin.cast("long").alias("begin"), F.least(begin + block_size, F.octet_length("value")).cast("long").alias("stop"),
        F.substring(F.col("value"), begin + 1, F.lit(block_size)).alias("block"),
    )


def digest(block: Column) -> Column:
    """The digest that names a block; equality is always decided by the bytes."""
    return F.sha2(block, 256)


def distinct(blocks: DataFrame) -> DataFrame:
    """(raw_len, block): every block once, without an id. Blocks are hashed in their task first, and cross the network once."""
    return blocks.select("block").distinct().select(F.octet_length("block").alias("raw_len"), "block")


def collide(blocks: DataFrame) -> bool:
    """Whether two different blocks have one digest and length: all bytes are compared, once."""
    named = distinct(blocks).groupBy(digest(F.col("block")).alias("digest"), "raw_len").count()
    return named.agg(F.count_if(F.col("count") > 1)).first()[0] > 0


def dedupe(
    blocks: DataFrame, objects: DataFrame | None = None, base: int = 0, share: bool = True, held: list[DataFrame] | None = None, attach: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(references, new objects): equal blocks share an object, equal in bytes, not in digest alone.

    Where no two blocks ``collide``, which is seen from their bytes, digest and length stand for them from then
    on: rows without bytes are grouped, numbered and joined, and bytes join new objects at the end, if asked for
    (``attach``). Else all is done by the bytes. Grouping is aggregated before the shuffle: however often a
    block occurs, a task sends it once. ``objects`` are those stored before; new ones get ids after ``base`` in
    the order of first occurrence (key, ord). Without ``share`` every block is an object of its own.
    """
    named = blocks.withColumn("digest", digest(F.col("block"))).withColumn("raw_len", F.octet_length("block"))
    by = ["digest", "raw_len", "block"]
    if not share:
        new = numbered(named.withColumn("first", F.struct("key", "ord")), "first", "object_id", base, held)
        return new.select("key", "ord", "begin", "stop", "object_id"), new.select("object_id", *(by if attach else by[:2]))
    alike = collide(blocks if objects is None else blocks.select("block").unionByName(objects.select("block")))
    by = by if alike else by[:2]
    groups = named.groupBy(*by).agg(F.min(F.struct("key", "ord")).alias("first"))
    if objects is not None:
        old = objects.select(*by, F.col("object_id").alias("old_id"))
        groups = groups.join(old, by, "left")
    else:
        groups = groups.withColumn("old_id", F.lit(None).cast("long"))
    fresh = numbered(groups.where("old_id is null").drop("old_id"), "first", "object_id", base, held).select("object_id", *by)
    known = groups.where("old_id is not null").select(*by, F.col("old_id").alias("object_id")).unionByName(fresh)
    refs = named.join(known, by).select("key", "ord", "begin", "stop", "object_id")
    if attach and not alike:
        fresh = fresh.join(named.groupBy(*by).agg(F.first("block").alias("block")), by)
    return refs, fresh.select("object_id", "digest", "raw_len", *(["block"] if attach else []))


def refcounts(refs: DataFrame) -> DataFrame:
    """One reference per occurrence of an object in a manifest."""
    return refs.groupBy("object_id").agg(F.count("*").alias("refs"))


def candidates(objects: DataFrame) -> DataFrame:
    """(digest, raw_len) -> ids: what a new block is compared with."""
    return objects.groupBy("digest", "raw_len").agg(F.sort_array(F.collect_set("object_id")).alias("ids"))


def locate(refs: DataFrame, offset: int, length: int) -> DataFrame:
    """First and last block of each key that a byte range touches; no row where it touches none."""
    hit = refs.where((F.col("stop") > offset) & (F.col("begin") < offset + length))
    return hit.groupBy("key").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))


def chunk_starts(refs: DataFrame) -> DataFrame:
    """``begin`` from the ends alone: where the block before ended, or 0."""
    return refs.withColumn("begin", F.lag("stop", 1, 0).over(Window.partitionBy("key").orderBy("ord")))


def reassemble(refs: DataFrame, objects: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """(key, value, complete) from references and objects (object_id, block); of a byte range only the blocks it touches.

    A value is one array of the JVM, and its digits another: half a GiB at most; longer ones are read by ranges.
    ``complete`` is false where an object is missing or has another length than its reference.
    """
    rows = refs
    if length is not None:
        rows = refs.where((F.col("stop") > offset) & (F.col("begin") < offset + length))
    joined = rows.join(objects.select("object_id", "block"), "object_id", "left")
    fits = F.coalesce(F.octet_length("block") == F.col("stop") - F.col("begin"), F.lit(False))
    part = F.col("block")
    if length is not None:
        low = F.greatest(F.lit(offset) - F.col("begin"), F.lit(0))
        high = F.least(F.col("stop"), F.lit(offset + length)) - F.col("begin")
        part = F.substring(part, (low + 1).cast("int"), (high - low).cast("int"))
    parts = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(part, F.lit(b"")).alias("part")))).alias("parts"), F.min(fits).alias("complete"))
    joined_ = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), ""))  # every byte is copied once, not once for each block after it
    return parts.select("key", joined_.alias("value"), "complete")


def encode_units(units: DataFrame, selector: Selector, column: str = "block") -> DataFrame:
    """``units`` with codec, aux_id, body, body_len and the BLAKE3 digest, chosen unit by unit, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType([*units.schema, *StructType.fromDDL("codec string, aux_id long, body binary, body_len int, blake3 binary")])
    schema, place, width = to_arrow_schema(kind), units.columns.index(column), len(units.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data = [x.as_py() or b"" for x in batch.column(place)]
            chosen = [selector.choose(d) for d in data]
            new = [[c[0] for c in chosen], [c[1] for c in chosen], [c[2] for c in chosen], [len(c[2]) for c in chosen], blake3_many(data)]
            columns = [*batch.columns, *(pa.array(x, f.type) for x, f in zip(new, list(schema)[width:]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return units.mapInArrow(run, kind)


def decode_units(units: DataFrame, params: dict[int, bytes] | None = None, verify: bool = True) -> DataFrame:
    """(columns but body) plus ``data`` and ``problem`` (null if the unit decodes and its digest holds)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in units.schema if f.name != "body"]
    kind = StructType([*kept, *StructType.fromDDL("data binary, problem string")])
    schema, known = to_arrow_schema(kind), params or {}

    def one(codec: str, body: bytes, raw_len: int, aux: int) -> tuple[bytes | None, str | None]:
        try:
            return decode(codec, body, raw_len, known.get(aux)), None
        except Exception as e:  # noqa: BLE001  a report names every failure
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            c = {n: batch.column(n).to_pylist() for n in ("codec", "body", "raw_len", "aux_id", "blake3")}
            done = [one(*x) for x in zip(c["codec"], c["body"], c["raw_len"], c["aux_id"])]
            if verify:
                digests = blake3_many([d or b"" for d, _ in done])
                done = [(None, "digest") if p is None and w is not None and w != g else (d, p) for (d, p), w, g in zip(done, c["blake3"], digests)]
            new = [pa.array([d for d, _ in done], pa.binary()), pa.array([p for _, p in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(schema.field(f.name).type) for f in kept), *new], schema=schema)

    return units.mapInArrow(run, kind)


def inspect(refs: DataFrame, objects: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per reference with its unit's codec and sizes, and ``counted``: an object's bytes count at its first reference alone."""
    joined = refs.join(objects.select("object_id", "codec", "raw_len", "body_len", "aux_id"), "object_id", "left").join(counts, "object_id", "left")
    first = F.row_number().over(Window.partitionBy("key", "object_id").orderBy("ord")) == 1
    return joined.withColumn("counted", first)


def record_space(inspected: DataFrame) -> DataFrame:
    """Per key: units, their headers (64 bytes each), bodies, and what is stored in all; each object once."""
    body = F.when(F.col("counted"), F.col("body_len")).otherwise(0)
    out = inspected.groupBy("key").agg(F.count("*").alias("units"), F.sum(F.col("counted").cast("long")).alias("objects"), F.sum(body).alias("bodies"), F.sum(F.col("stop") - F.col("begin")).alias("logical_len"))
    return out.withColumn("headers", F.col("objects") * 64).withColumn("stored", F.col("bodies") + F.col("objects") * 64)


def codec_label(codec_id: Column, version: Column) -> Column:
    """The codec's name, or Unknown(0x.. v..)."""
    out = F.concat(F.lit("Unknown(0x"), F.lpad(F.lower(F.hex(codec_id)), 2, "0"), F.lit(" v"), version.cast("string"), F.lit(")"))
    for name, known in CODEC_IDS.items():
        out = F.when((codec_id == known) & (version == 1), F.lit(name)).otherwise(out)
    return out
