"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, text_of

#: One draw covers a rate of at most STEP; larger rates are sums of independent draws.
STEP = 16
#: Terms of the distribution function that one draw inverts: P(X > TERMS) < 1e-15 at a rate of STEP.
TERMS = 64


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of the SHA-256 of the parts, joined by colons; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, targets: DataFrame, source_col: str, size: Column, total: float | None) -> DataFrame:
    """(source, weight, rate): the mean repetitions that bring each source to its share of ``total``.

    ``targets`` has (source, weight), weights >= 0; repeated sources add up. One row per source that
    ``docs`` has; a source without a target has weight 0 and rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    goal = targets.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
    both = sizes.join(goal.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal")), "left")
    both = both.select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    both = cut(both, "sources")
    weights, sizes = both.where("size > 0").agg(F.sum("weight"), F.sum("size")).first()
    if not weights:
        return both.select("source", "weight", F.lit(0.0).alias("rate"))
    scale = float(sizes if total is None else total) / weights
    rate = F.when(F.col("size") > 0, F.lit(scale) * F.col("weight") / F.col("size")).otherwise(0.0)
    return both.select("source", "weight", rate.alias("rate"))


def poisson(rate: Column, seed: Column, key: Column) -> Column:
    """The Poisson number with mean ``rate`` whose distribution function first exceeds a hash-seeded uniform."""
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP)).cast("int")
    step = rate / draws

    def one(draw: Column) -> Column:
        none = F.exp(-step)
        first = F.struct(uniform(seed, draw, key).alias("u"), none.alias("p"), none.alias("cdf"), F.lit(0).alias("n"))

        def next_(acc: Column, k: Column) -> Column:
            p = acc["p"] * step / k
            n = F.when(acc["cdf"] <= acc["u"], k).otherwise(acc["n"])
            return F.struct(acc["u"].alias("u"), p.alias("p"), (acc["cdf"] + p).alias("cdf"), n.alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, next_, lambda acc: acc["n"])

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda acc, draw: acc + one(draw))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total: float | None = None,
    seed: int = 0,
    by: str = "docs",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Replicate rows so that each source's expected share of the output is its weight, then shuffle all rows.

    A row of source s appears Poisson(rate_s) times, where rate_s = total * weight_s / sum of weights
    / size_s; sizes are rows (``by="docs"``) or characters (``by="chars"``) and ``total`` is in that unit
    (None: the size of ``docs``). Weights of sources that ``docs`` has count alone. The number depends on
    the seed, the id and the text's SHA-256 only, so that reruns and retries agree; rows that repeat an id
    and a text get the same number. Null sources are a source; a null text is empty; no rows give no rows.

    Returns the columns of ``docs`` plus ``mix_copy`` (1, 2, ...), ``mix_rate`` and ``mix_key``, which the
    rows are dealt out and sorted by (names get underscores where ``docs`` has them).
    """
    size = F.lit(1) if by == "docs" else F.length(text_of(text_col))
    rates = source_rates(docs, targets, source_col, size, total)
    src, w, rate, copy, key, n = (fresh(docs, c) for c in ("mix_source", "mix_weight", "mix_rate", "mix_copy", "mix_key", "mix_n"))
    rates = rates.toDF(src, w, rate)
    rows = docs.join(rates, docs[source_col].eqNullSafe(F.col(src))).drop(src, w)
    rows = rows.where(F.col(rate) > 0)
    same = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(text_of(text_col), 256))
    rows = rows.withColumn(n, poisson(F.col(rate), F.lit(seed), same)).where(F.col(n) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    rows = rows.withColumn(key, F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(copy)))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, copy)
