"""The driver's tables as key-value data: a mutation log, stores of documents and messages, and a damaged store."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, writes

BLOCK = 512


#: Python workers find the package here even where they start in another folder.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: an error deletes its user's key, anything else puts the properties."""
    op = F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put"))
    key = F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), key.alias("key"), op.alias("op"), F.col("props").alias("value"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.effective_log(mutations(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    rows = table(spark, sf_dir, "documents")
    return rows.select(key.alias("key"), (F.col("doc_id") + 1).alias("revision"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("ch/"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("/msg/"), F.lpad(F.col("turn").cast("string"), 20, "0"))
    return rows.select(key.alias("key"), F.col("conv_id").alias("channel"), F.col("turn").alias("id"), F.coalesce("text", F.lit("")).alias("payload"))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in blocks of 512 bytes."""
    return blocks.split(documents(spark, sf_dir), BLOCK)


def block_store(spark: SparkSession, sf_dir: str, attach: bool = True) -> tuple[DataFrame, DataFrame]:
    """(references, objects) of all documents in blocks of 512 bytes; objects without their bytes unless ``attach``."""
    return blocks.dedupe(document_blocks(spark, sf_dir), attach=attach)


def damaged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The block store with planted faults: lost objects (id % 97 = 0), counts off by one (id % 89 = 0), and objects that nothing names."""
    refs, objects = block_store(spark, sf_dir, attach=False)
    counts = blocks.refcounts(refs).withColumn("refs", F.col("refs") + (F.col("object_id") % 89 == 0).cast("long"))
    extra = spark.range(1, 6).select((F.col("id") + 1_000_000_000).alias("object_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(1).alias("raw_len"))
    have = objects.where("object_id % 97 <> 0").unionByName(extra)
    known = objects.select("object_id", F.when(F.col("object_id") % 83 == 0, F.lit("other")).otherwise(F.col("digest")).alias("digest"), "raw_len")
    stale = spark.range(1, 4).select((F.col("id") + 2_000_000_000).alias("object_id"), F.lit("gone").alias("digest"), F.lit(7).alias("raw_len"))
    return {"refs": refs, "objects": have, "counts": counts, "candidates": known.unionByName(stale)}
