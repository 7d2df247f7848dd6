"""What the operators share: the shared folder, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Seconds between two releases of the executors' heaps by ``cut``, and when each application's last one was.
RELEASE_EVERY = 8.0
_released: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a single-process session without the setting (tests) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage like ``checkpoint()``; the table has file statistics, so that joins on it
    choose their strategy by its real size.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    if time.monotonic() - _released.get(spark.sparkContext.applicationId, 0.0) >= RELEASE_EVERY:
        release_heaps(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables, once nothing that is still to be computed reads them."""
    for df in tables:
        if path := df.__dict__.get("_cut"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """From now on Arrow batches to Python hold at most ``mb`` MB, which bounds the memory of workers and executors alike."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def release_heaps(spark: SparkSession) -> None:
    """The executors' JVMs give the system the heap that they don't use.

    A heap that many stages have grown stays as large as the largest of them made it, and the Python workers of later ones
    come on top. A full collection shrinks it. There is a task for each core, so that every idle executor has one.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    _released[spark.sparkContext.applicationId] = time.monotonic()


def give_back() -> None:
    """Memory that this Python worker holds free goes back to the system: the worker lives on for the stages to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(name: str, *taken: str) -> str:
    """``name``, with underscores added until it is none of ``taken`` (in any case): an id column named like a column of the result."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a membership filter: it is broadcast as at most FILTER_BITS / 32768 rows of 4 KB, 8 MB in all.
FILTER_BITS = 1 << 26
_BITMAP = 32768


def _filtered(rows: DataFrame, key: Column, members: DataFrame, member: str, filter_bits: int) -> tuple[DataFrame, Column]:
    """Rows joined with a filter of the members, and whether the filter has the row's key."""
    if filter_bits & (filter_bits - 1) or filter_bits < _BITMAP:
        raise ValueError("filter_bits: a power of two from 32768 on")
    bit = lambda c: F.xxhash64(c).bitwiseAND(F.lit(filter_bits - 1))  # noqa: E731  never null: no filter on it is pushed below the key
    parts = lambda c: (F.shiftright(bit(c), 15), bit(c).bitwiseAND(F.lit(_BITMAP - 1)))
    bucket, place, bits = (fresh(rows, c) for c in ("filter_bucket", "filter_place", "filter_bits"))
    of = [c.alias(n) for c, n in zip(parts(F.col(member)), (bucket, place))]
    built = members.select(*of).groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(bits))
    own = parts(key)
    held = rows.withColumn(bucket, own[0]).withColumn(place, own[1]).join(F.broadcast(cut(built, "filter")), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return held, _has(byte, place)


def _has(byte: Column, place: str) -> Column:
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col(place) % 8 + 1).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def may_contain(rows: DataFrame, key: str, members: DataFrame, member: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be among ``members``: all that are, and others as the filter of a fixed size fills up."""
    held, has = _filtered(rows, F.col(key), members, member, filter_bits)
    return held.where(has).select(*rows.columns)


def cannot_contain(rows: DataFrame, key: str, members: DataFrame, member: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows that ``may_contain`` leaves out."""
    held, has = _filtered(rows, F.col(key), members, member, filter_bits)
    return held.where(~has).select(*rows.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the links ``(a, b)``: one row ``(node, root)`` per linked node, ``root`` the smallest of its component.

    Alternating large-star and small-star rounds: every round is two aggregations and two joins on
    rows of two ids, a component of diameter d needs about log d rounds, and no component is ever
    gathered. Links to itself, repeated links and empty input are allowed (no rows for them).
    """
    spark = edges.sparkSession
    star = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
