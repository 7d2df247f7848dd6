"""Exact dedup over a log-structured merge index of digests.

* flush: every input split is a memtable; it is written as one run of (digest, id) rows sorted by
  digest, with min/max statistics on it.
* compact: runs are merged into one level that keeps the smallest id and the count of each digest.
* filter: digests that occur more than once set bits of a bitmap of a fixed size, the level's filter.
  Rows of the runs whose digest hits it give their ids to another such bitmap; texts whose id misses
  that are unique, are not normalised again and never leave their scan.
* verify: the remaining texts are grouped by their bytes, with map-side aggregation, so that a
  group of copies of any size shuffles one text per map task, and equal digests of different bytes
  are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FILTER_BITS, apart, cannot_contain, cut, fresh, may_contain, text_of

#: Runs of the ASCII white space that normalisation replaces by one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), WHITE, " ")


class DigestIndex:
    """Sorted runs of (digest, id, sha) and the level they compact to."""

    def __init__(self, spark: SparkSession, digest_bits: int = 256, filter_bits: int = FILTER_BITS) -> None:
        if digest_bits % 8 or not 8 <= digest_bits <= 256:
            raise ValueError("digest_bits: 8, 16, ... 256")
        self.spark, self.bytes, self.filter_bits = spark, digest_bits // 8, filter_bits
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None

    def digest(self, sha: str = "sha") -> Column:
        return F.substring(F.col(sha), 1, self.bytes)

    def flush(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Append one sorted run per input split."""
        rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("sha"))
        rows = rows.select("id", "sha", self.digest().alias("digest")).sortWithinPartitions("digest", "id")
        self.runs.append(cut(rows, "run"))

    def rows(self) -> DataFrame:
        out = self.runs[0]
        for run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def compact(self) -> DataFrame:
        """Merge all runs: (digest, id: the smallest, n), sorted by digest within its files."""
        merged = self.rows().groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        self.level = cut(merged.sortWithinPartitions("digest"), "level")
        return self.level

    def candidates(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, digest, norm) of the rows that share a digest with another row, and of some others that the filters let pass."""
        level = self.level if self.level is not None else self.compact()
        hits = may_contain(self.rows().select("id", "digest"), "digest", level.where("n > 1"), "digest", self.filter_bits)
        rows = may_contain(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", hits, "id", self.filter_bits)
        norm = rows.select("id", normalised("text").alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        return norm.select("id", self.digest().alias("digest"), "norm")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_bits: int = 256,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after normalisation; null counts as empty, and empty
    texts are copies of each other. The row with the smallest id stays. Rows that repeat an id and a
    text are one document: they count in group_size and share ``kept``. A null id is larger than any
    other; in a group of null ids alone keep_id is null and all are kept. No rows give no rows.
    Other columns of ``docs`` are not read; an id column named like one of the result gets an underscore.
    """
    index = DigestIndex(docs.sparkSession, digest_bits, filter_bits)
    index.flush(docs, id_col, text_col)
    index.compact()
    found = index.candidates(docs, id_col, text_col)
    by_bytes = found.groupBy("digest", "norm").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    if digest_bits < 256:
        by_bytes = cut(by_bytes, "verified")
        verified = by_bytes.select("digest", "keep", "n")
    else:
        verified = cut(by_bytes.select("digest", "keep", "n"), "verified")
    clash = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    rows = index.rows()
    if clash.isEmpty():
        out = rows.join(verified.where("n > 1"), "digest", "left")
    else:  # different bytes under one digest: these rows are told apart by their bytes
        if digest_bits == 256:
            by_bytes = cut(by_bytes, "verified-texts")
        clash = cut(clash, "clash")
        alike = rows.join(clash, "digest", "left_anti").join(verified.where("n > 1"), "digest", "left")
        told = found.join(clash, "digest", "left_semi").join(by_bytes, ["digest", "norm"])
        told = told.withColumn("sha", F.unhex(F.sha2("norm", 256)))
        out = alike.unionByName(told.select("digest", "id", "sha", "keep", "n"))
    n = F.coalesce(F.col("n"), F.lit(1))
    keep = F.when(n == 1, F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(apart(id_col, "keep_id", "group_size", "kept", "text_sha256")),
        keep.alias("keep_id"),
        n.alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows that repeat an id and a text, one stays."""
    key, sha = fresh(docs, "gone_id"), fresh(docs, "gone_sha")
    found = cut(exact_dedup(docs, id_col, text_col), "classes")
    same = lambda rows, side: rows[id_col].eqNullSafe(side[key]) & (rows[sha] == side["text_sha256"])
    kept, once = found.where("kept").groupBy(F.col(id_col).alias(key), "text_sha256"), F.count("*").alias("n")
    twice = cut(kept.agg(once).where("n > 1").drop("n"), "twice")
    gone = cut(found.where("not kept").select(F.col(id_col).alias(key), "text_sha256").distinct(), "dropped")
    asked = cut(gone.select(key).union(twice.select(key)).distinct(), "asked")
    # texts whose id is not among those asked about stay where they are
    clear = cannot_contain(docs, id_col, asked, key)
    rest = may_contain(docs, id_col, asked, key).withColumn(sha, F.sha2(normalised(text_col), 256))
    rest = rest.join(gone, same(rest, gone), "left_anti")
    if not twice.isEmpty():
        first = rest.join(twice, same(rest, twice), "left_semi").dropDuplicates([id_col, sha])
        rest = rest.join(twice, same(rest, twice), "left_anti").unionByName(first)
    return clear.unionByName(rest.drop(sha))
