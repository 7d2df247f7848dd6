"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking by the vectors.

Rotations that make balanced binary codes are learned on a bounded sample; every vector is then coded by
all of them. The codes are cut into short keys, each the index of one Hamming table: vectors whose codes
differ in few bits share a key in some table. The members of a key are compared as blocks, in double
precision and by their original vectors. A pair counts in the first table that it shares, so that
numbers of links add up without any list of pairs, and each block gives a spanning forest of its links,
which has fewer edges than members.

A key has some bits more than the largest label has vectors to its power of two, so that vectors which
are not alike seldom share one, however many there are; the number of tables follows from the bits, so that
a pair at the limit is missed in all of them with a probability of MISSED at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import apart, bounded_batches, connected_components, cut

#: Least cosine of a link.
ALIKE = 0.93
#: At most this many vectors (those with the smallest hash of their id) learn the rotations.
SAMPLE = 20_000
#: Bits of one rotation's code, rounds of learning.
CODE, ROUNDS = 60, 25
#: Bits of a key: SPARE more than the largest label's count has, within these limits; chance that no table has a pair that is just alike.
SPARE, LEAST_BITS, MOST_BITS, MISSED = 3, 12, 30, 0.008
#: Members of a key that are compared as one block; larger groups are compared block against block, smaller than SMALL many at a time.
BLOCK, SMALL = 1024, 5


def layout(n: int, alike: float = ALIKE) -> tuple[int, int, int]:
    """(rotations, tables of each, bits of a key) for labels of at most ``n`` vectors.

    A random hyperplane parts two vectors with probability angle / pi; keys of b bits agree with (1 - angle / pi) ** b.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) + SPARE))
    same = (1 - math.acos(min(1.0, alike)) / math.pi) ** bits
    tables = CODE // bits
    needed = math.log(MISSED) / math.log(1 - same) if same < 1 else 1
    return max(1, math.ceil(needed / tables)), tables, bits


def learn(sample: np.ndarray, bits: int, rotations: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projections (rotations, d, bits), thresholds (rotations, bits)) from unit vectors."""
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    x = sample - mean
    values, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))
    pca = axes[:, ::-1][:, : min(bits, d)]
    out, cuts = [], []
    for r in range(rotations):
        rng = np.random.default_rng(r)
        basis = pca if pca.shape[1] == bits else np.concatenate([pca, pca @ np.linalg.qr(rng.normal(size=(pca.shape[1],) * 2))[0]] * (bits // pca.shape[1] + 1), 1)[:, :bits]
        v = x @ basis
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds if len(v) else 0):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v, full_matrices=False)
            turn = (u @ w).T
        out.append(basis @ turn)
        cuts.append(np.median(x @ out[-1], 0) if len(x) else np.zeros(bits))
    return mean, np.stack(out), np.stack(cuts)


def keys(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray], tables: int, bits: int) -> np.ndarray:
    """(n, rotations * tables) keys of unit vectors; vectors of another length are cut or filled with zeros for their codes."""
    mean, projections, cuts = model
    d = len(mean)
    x = np.zeros((len(unit), d))
    x[:, : min(d, unit.shape[1])] = unit[:, :d]
    weights = 1 << np.arange(bits)
    out = [(((x - mean) @ p > c).reshape(len(x), tables, bits) @ weights) for p, c in zip(projections, cuts)]
    return np.concatenate(out, 1).astype(np.int32)


def _stack(column: pa.Array) -> np.ndarray:
    """Rows of one length as an array of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _code(schema: pa.Schema, model, tables: int, bits: int):
    """The rows, with the keys of their vectors (column ``v``)."""
    place = schema.get_field_index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(place).offsets.to_numpy())
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = _stack(own.column(place))
                code = keys(x / np.linalg.norm(x, axis=1)[:, None], model, tables, bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own.columns, lists], schema)], schema=schema)

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components of the pairs (i, j) among n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def compare(table: int, left: tuple, right: tuple | None, alike: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each left member, of each right member, edges a, edges b) of two blocks, or within one.

    A block is (ids, weights, keys, unit vectors); only pairs whose first common key is ``table`` count.
    """
    ids, weight, code, x = left
    ids2, weight2, code2, y = right or left
    hit = x @ y.T >= alike
    if right is None:
        hit &= np.tri(len(ids), k=-1, dtype=bool)
    i, j = np.nonzero(hit)
    if table:
        new = ~(code[i, :table] == code2[j, :table]).any(1)
        i, j = i[new], j[new]
    n1 = np.bincount(i, weight2[j], len(ids)).astype(np.int64)
    n2 = np.bincount(j, weight[i], len(ids2)).astype(np.int64)
    if right is None:
        edge, root = _forest(i, j, len(ids))
        return n1 + n2, n2 * 0, ids[edge], ids[root]
    all_ = np.concatenate([ids, ids2])
    edge, root = _forest(i, j + len(ids), len(all_))
    return n1, n2, all_[edge], all_[root]


NAME = ["label", "dim", "place", "key", "low", "high"]


def _blocks(alike: float):
    """Rows sorted by NAME make one tile after the other; ``side`` is 0 or 1, by block."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def small(table: np.ndarray, rep: np.ndarray, weight: np.ndarray, code: np.ndarray, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple:
        """Links and edges of many tiles of few members each, which begin at ``first``."""
        i, j = [], []
        for a in range(1, SMALL):
            for b in range(a):
                at = first[size > a]
                i.append(at + a)
                j.append(at + b)
        i, j = np.concatenate(i), np.concatenate(j)
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= alike
        i, j = i[ok], j[ok]
        before = np.arange(code.shape[1]) < table[i][:, None]
        new = ~((code[i] == code[j]) & before).any(1)
        i, j = i[new], j[new]
        n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
        some = np.flatnonzero(n)
        return rep[some], n[some].astype(np.int64), rep[i], rep[j]

    def large(table: int, rep: np.ndarray, weight: np.ndarray, code: np.ndarray, x: np.ndarray, side: np.ndarray, two: bool) -> tuple | None:
        sides = [tuple(v[side == k] for v in (rep, weight, code, x)) for k in (0, 1) if (side == k).any()]
        if two and len(sides) < 2:
            return None
        n1, n2, a, b = compare(table, sides[0], sides[1] if len(sides) == 2 else None, alike)
        ids = np.concatenate([s[0] for s in sides])
        n = np.concatenate([n1, n2]) if len(sides) == 2 else n1
        return ids[n > 0], n[n > 0], a, b

    def tiles(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """All of whole tiles of vectors of one length."""
        name = np.zeros(len(rows), bool)
        name[:1] = True
        for c in NAME:
            own = rows.column(rows.schema.get_field_index(c))
            name[1:] |= pc.not_equal(own.slice(1), own.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(name)
        size = np.diff(np.append(first, len(rows)))
        of = lambda c: rows.column(rows.schema.get_field_index(c))
        table, side, rep, weight, low, high = (of(c).to_numpy() for c in ("place", "side", "rep", "weight", "low", "high"))
        code = of("keys").flatten().to_numpy().reshape(len(rows), -1)
        x = _stack(of("vector"))
        x /= np.linalg.norm(x, axis=1)[:, None]
        few = (size < SMALL) & (low[first] == high[first])
        done = [small(table, rep, weight, code, x, first[few], size[few])] if few.any() else []
        for k, n in zip(first[~few], size[~few]):
            own = slice(k, k + n)
            if n > 1:
                done.append(large(int(table[k]), rep[own], weight[own], code[own], x[own], side[own], low[k] != high[k]))
        for ids, n, a, b in filter(None, done):
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a])), pa.concat_arrays([none, pa.array(b)]), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the tile that may go on, or all of vectors of one length
        for batch in batches:
            for k in range(0, len(batch), 1 << 14):
                rows = pa.concat_batches([*kept, batch.slice(k, 1 << 14)])
                dim = rows.column(rows.schema.get_field_index("dim")).to_numpy()
                last = {c: rows.column(rows.schema.get_field_index(c))[len(rows) - 1] for c in NAME}
                open_ = np.ones(len(rows), bool)
                for c, v in last.items():
                    open_ &= pc.equal(rows.column(rows.schema.get_field_index(c)), v).to_numpy(zero_copy_only=False)
                end = int(np.flatnonzero(open_)[0])
                cuts = [0, *(np.flatnonzero(dim[1:end] != dim[: end - 1]) + 1).tolist(), end] if end else [0]
                for a, b in zip(cuts, cuts[1:]):
                    yield from tiles(rows.slice(a, b - a))
                kept = [rows.slice(end)]
        if kept and len(kept[0]):
            yield from tiles(kept[0])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    alike: float = ALIKE,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors are linked when their labels are equal, their lengths are equal and their cosine, in double
    precision, is at least ``alike``. Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null label or id, link with nothing: they are components of their own.
    Equal vectors of a label are one in the index and count as many; rows that repeat an id count too.
    n_links counts the other rows that are linked directly; component_id is the smallest id that links
    reach. An id column named like another one of the result gets an underscore; other columns are not read.
    No rows give no rows.
    """
    bounded_batches(vectors.sparkSession)
    named_id = apart(id_col, "n_links", "component_id", "kept")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = cut(rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))), "vectors")
    good = rows.where("fine").withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    good = good.withColumn("h", F.xxhash64(F.lit(1), "v")).withColumn("g", F.xxhash64(F.lit(2), "v"))  # 128 bits name a vector
    named = ["label", "h", "g"]
    same = cut(good.groupBy(*named).agg(F.first("v").alias("v"), F.min("id").alias("first"), F.count("*").alias("weight")), "distinct")
    same = cut(same.select(F.monotonically_increasing_id().alias("rep"), *named, "v", "first", "weight"), "reps")
    dims = same.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows.select(F.col("id").alias(named_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = same.where(F.size("v") == dims.d).orderBy(F.xxhash64("first"), "first", "rep").limit(sample).select("v").toPandas()
    x = np.stack(drawn["v"])
    most = same.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rotations, tables, bits = layout(most, alike)
    model = learn(x / np.linalg.norm(x, axis=1)[:, None], tables * bits, rotations)

    wide = same.select("rep", "label", "v", "weight")
    kind = StructType([*wide.schema, *StructType.fromDDL("keys array<int>")])
    coded = cut(wide.mapInArrow(_code(to_arrow_schema(kind), model, tables, bits), kind), "coded")
    placed = coded.select("rep", "label", F.size("v").alias("dim"), F.posexplode("keys").alias("place", "key"))
    chunks = F.ceil(F.col("n") / block).cast("int")
    many = placed.groupBy("label", "dim", "place", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", chunks).drop("n")
    met = placed.join(many, ["label", "dim", "place", "key"])
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("rep", "label", "dim", "place", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    tiles = met.join(coded.select("rep", "weight", "keys", F.col("v").alias("vector")), "rep")
    tiles = tiles.repartition(*NAME).sortWithinPartitions(*NAME).select(*NAME, "side", "rep", "weight", "keys", "vector")
    found = cut(tiles.mapInArrow(_blocks(alike), "a bigint, b bigint, n bigint"), "found")

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).toDF("rep", "root")
    one = same.join(links, "rep", "left").join(roots, "rep", "left")
    one = cut(one.select(*named, "first", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    low = one.groupBy("root").agg(F.min("first").alias("component"))
    one = one.join(low, "root").select(*named, "n_links", "component")
    out = good.select("id", *named).join(one, named).select("id", "n_links", "component")
    out = out.unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(named_id), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
