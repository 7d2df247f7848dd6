"""Near-dedup by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

A document is a bag of shingles, weighted by how often each occurs. Weights are discretised to unit
cells, grouped in octaves (1], (1, 2], (2, 4], (4, 8] ...: each shingle has one Poisson process of
points per octave, the same in every document, and a document takes the points whose cell lies below
its weight. A point falls on one component of the signature; the component keeps its earliest point.
Processes stop as soon as they are later than the latest component, so that the cost hardly depends on
weights. Two signatures agree in a component with probability (sum of minima) / (sum of maxima).

Bands of the signature give buckets. First each text is compared, by the true overlap of the bags, with one
other: the leader of most of its buckets; what is linked merges, and again with other leaders. That takes one
pair a text and round, and leaves few buckets that hold more than one component. In those, members outside
the largest component are compared with the members of other components, never with their own. So the links
found connect all that comparing all pairs of a bucket would connect, and a bucket of copies takes pairs in
proportion to its members.

Two bounds keep a pair of the second part from being compared. What two bags share is at most what each of
them shares with any text left: shingles that no other text left holds count for nothing. That bound is exact.
The other isn't: pairs whose four-bit sketches differ in more components than a pair at the limit does, but
for ``sigmas`` standard deviations (4: a chance of 3 in 100,000 to lose the pair), are left out. ``sigmas=None``
compares them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import apart, bounded_batches, cannot_contain, connected_components, cut, discard, fresh, give_back, may_contain, text_of
from .words import hashed, mix, parts, rolling

#: Words in a shingle, and the least similarity of a link.
WIDTH, ALIKE = 5, 0.8
#: Signatures of BANDS * ROWS components: a pair at ALIKE shares a bucket with probability 0.9993, one at 0.5 with 0.14.
BANDS, ROWS = 40, 8
#: BANDS * ROWS must be a multiple of 16.
#: Rounds in which each text is compared with one other; then members of a bucket that lead at a time, in the first round and later.
ROUNDS, LEADERS = 3, (16, 128)
#: Standard deviations by which the sketches of a pair may differ more than those of a pair at the limit.
SIGMAS = 4.0
#: Texts that are signed at a time: their signatures, and each array of numbers on the way, take 5 MB at 40 bands of 8.
SIGNED = 1 << 11
_HASH_BITS = 50
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _steps(n: int) -> np.uint64:
    return np.uint64(int(_STEP) * n % (1 << 64))


def bags(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) for each different shingle, sorted; a text of fewer than ``width`` words is one shingle.

    At most 2 ** 14 texts; shingles are 50-bit hashes. Texts without words have no shingle.
    """
    words, offsets = hashed(texts)
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], n)
    whole = place + width <= np.repeat(n, n)
    runs = np.zeros(len(words), np.uint64)
    runs[: max(0, len(words) - width + 1)] = rolling(words, width)
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            at = offsets[short]
            runs[at] = rolling(words[at[:, None] + np.arange(k)].ravel(), k)[::k]
            whole[at] = True
    key = (text[whole].astype(np.uint64) << np.uint64(_HASH_BITS)) | (runs[whole] >> np.uint64(64 - _HASH_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & np.uint64((1 << _HASH_BITS) - 1), weight


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """(texts, size): the earliest point on each component; rows of texts without shingles are infinite."""
    out = np.full(texts * size, np.inf)
    doc, seed = [text], [mix(shingle + _STEP)]
    cells, taken = [np.ones(len(text), np.int64)], [np.ones(len(text), np.int64)]
    octave = 1
    while len(more := np.flatnonzero(weight > (half := 1 << (octave - 1)))):
        doc.append(text[more])
        seed.append(mix(shingle[more] + _steps(octave + 1)))
        cells.append(np.full(len(more), half))
        taken.append(np.minimum(weight[more], 2 * half) - half)
        octave += 1
    doc, seed, cells, taken = (np.concatenate(x) for x in (doc, seed, cells, taken))
    at, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        draw = mix(seed + _steps(2 * turn))
        at = at - np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)) / cells
        draw = mix(draw + _STEP)
        component = ((draw >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        cell = ((draw & np.uint64(0xFFFFFFFF)) * cells.astype(np.uint64)) >> np.uint64(32)
        ok = cell.astype(np.int64) < taken
        np.minimum.at(out, doc[ok] * size + component[ok].astype(np.int64), at[ok])
        live = np.unique(doc)
        last = np.zeros(texts)
        last[live] = out.reshape(texts, size)[live].max(1)
        go = at < last[doc]
        doc, seed, cells, taken, at = doc[go], seed[go], cells[go], taken[go], at[go]
    return out.reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros(bits.shape[:2], np.uint64)
    for k in range(rows):
        key = mix(key * _STEP + bits[:, :, k])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each component, 16 components in a number."""
    bits = (mix(np.ascontiguousarray(signature).view(np.uint64)) & np.uint64(15)).reshape(len(signature), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def differing(a: F.Column, b: F.Column, numbers: int) -> F.Column:
    """In how many components two sketches (arrays) differ."""
    out = F.lit(0)
    for k in range(numbers):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return out


def most_differing(alike: float, size: int, sigmas: float) -> int:
    """Components in which the sketches of a pair that is just alike differ at most, but for ``sigmas`` standard deviations."""
    p = 15 / 16 * (1 - alike)
    return int(size * p + sigmas * (size * p * (1 - p)) ** 0.5)


def _sign(bands: int, rows: int, width: int):
    kind = pa.schema([("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                for k in range(0, len(part), SIGNED):
                    own = part.slice(k, SIGNED)
                    text, shingle, weight = bags(own.column(1), width)
                    signature = signatures(text, shingle, weight, len(own), bands * rows)
                    some = np.bincount(text, minlength=len(own)) > 0
                    lists = []
                    for x in (band_keys(signature, bands, rows), sketches(signature)):
                        offsets = np.concatenate([[0], np.cumsum(some * x.shape[1])]).astype(np.int32)
                        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[some].ravel())))
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.binary()), *lists], schema=kind)
        give_back()

    return run


def overlaps(a: pa.Array, b: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The weighted Jaccard similarity of a[i] and b[i]; two texts without words are alike."""
    ta, sa, wa = bags(a, width)
    tb, sb, wb = bags(b, width)
    _, i, j = np.intersect1d((ta.astype(np.uint64) << np.uint64(_HASH_BITS)) | sa, (tb.astype(np.uint64) << np.uint64(_HASH_BITS)) | sb, True, True)
    both = np.bincount(ta[i], np.minimum(wa[i], wb[j]), len(a))
    all_ = np.bincount(ta, wa, len(a)) + np.bincount(tb, wb, len(a)) - both
    return np.where(all_ > 0, both / np.maximum(all_, 1), 1.0)


def _verify(width: int):
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("alike", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, 3):
                for k in range(0, len(part), 1 << 14):
                    own = part.slice(k, 1 << 14)
                    alike = overlaps(own.column(2), own.column(3), width)
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.binary()), own.column(1).cast(pa.binary()), pa.array(alike)], schema=kind)
        give_back()

    return run


def nodes(text_col: str) -> F.Column:
    """The same 16 bytes for texts that differ in white space alone."""
    norm = F.trim(F.regexp_replace(text_of(text_col), r"\s+", " "))
    return F.substring(F.unhex(F.sha2(norm, 256)), 1, 16)


def _bags(width: int):
    kind = pa.schema([("node", pa.binary()), ("total", pa.int64()), ("bag", pa.list_(pa.struct([("shingle", pa.int64()), ("weight", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                for k in range(0, len(part), 1 << 14):
                    own = part.slice(k, 1 << 14)
                    text, shingle, weight = bags(own.column(1), width)
                    ends = pa.array(np.searchsorted(text, np.arange(len(own) + 1)).astype(np.int32))
                    pairs = pa.StructArray.from_arrays([pa.array(shingle.view(np.int64)), pa.array(weight)], ["shingle", "weight"])
                    total = np.bincount(text, weight, len(own)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.binary()), pa.array(total), pa.ListArray.from_arrays(ends, pairs)], schema=kind)
        give_back()

    return run


def _shared_weights(texts: DataFrame, width: int) -> DataFrame:
    """(node, total, common): the weight of each bag, and of its shingles that another of the texts holds, too."""
    bag = cut(texts.mapInArrow(_bags(width), "node binary, total bigint, bag array<struct<shingle bigint, weight bigint>>"), "bags")
    each = bag.select("node", F.explode("bag").alias("s")).select("node", "s.shingle", "s.weight")
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("weight").alias("weight")).where("n = 1")
    alone = alone.groupBy("node").agg(F.sum("weight").alias("alone"))
    return bag.select("node", "total").join(alone, "node", "left").select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("common"))


BUCKET = ["band", "key"]


def _one_each(active: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), at most one for each node: with the leader, of another component, of most of its buckets.

    At first the texts lead that share most buckets with others (the text that others were made from shares
    more with them than they do with each other), later those with the largest hash of the round.
    """
    rank = F.struct("met", "node") if not turn else F.struct(F.xxhash64(F.lit(turn), "node"), "node")
    now = active.join(roots, "node")
    lead = now.groupBy(*BUCKET).agg(F.max_by(F.struct("node", "root"), rank).alias("lead"))
    met = now.join(lead, BUCKET).where("lead.root <> root").groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("buckets"))
    best = met.groupBy("node").agg(F.max_by("lead", F.struct("buckets", "lead")).alias("lead"))
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))


def classes(
    docs: DataFrame, text_col: str = "text", alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, sigmas: float | None = SIGMAS
) -> DataFrame:
    """(node, root) of linked nodes: the components of all verified links between nodes that share a bucket.

    Links within a component would change nothing, so that a bucket is done once it is known to hold one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows_ = docs.select(nodes(text_col).alias("node"), text_of(text_col).alias("text"))
    signed = rows_.mapInArrow(_sign(bands, rows, width), "node binary, bands array<bigint>, sketch array<bigint>")
    one = cut(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "signed")
    member = one.select("node", F.posexplode("bands").alias("band", "key"))
    many = member.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n > 1")
    members = cut(member.join(many, BUCKET), "buckets")
    asked = cut(members.groupBy("node").agg(F.sum("n").alias("met")).join(one.select("node", "sketch"), "node"), "asked")
    active = cut(members.join(asked.select("node", "met"), "node").select(*BUCKET, "node", "met"), "members")
    discard(members)
    texts = may_contain(rows_, "node", asked, "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = cut(texts.join(asked, "node", "left_semi"), "texts")
    known = spark.createDataFrame([], "a binary, b binary, alike double")
    roots = cut(asked.select("node", F.col("node").alias("root")), "roots")

    def merge(pairs: DataFrame) -> DataFrame:
        """Compare the pairs, and the components after that."""
        nonlocal known
        pairs = pairs.distinct().join(known, ["a", "b"], "left_anti")
        both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        found = cut(both.mapInArrow(_verify(width), "a binary, b binary, alike double"), "known")
        known = known.union(found)
        merged = cut(_hooked(roots, found.where(F.col("alike") >= alike).select("a", "b")), "roots")
        discard(roots)
        return merged

    for turn in range(ROUNDS):
        roots = merge(_one_each(active, roots, turn))
    now = active.join(roots, "node")
    mixed = now.groupBy(*BUCKET).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*BUCKET)
    mixed = cut(active.join(mixed, BUCKET, "left_semi"), "mixed")
    facts = _shared_weights(texts.join(mixed.select("node").distinct(), "node", "left_semi"), width)
    enough = F.col("common") * (1 + 1e-9) >= alike * F.col("total")  # a text that shares less with all others together has no link
    facts = cut(facts.where(enough).join(asked, "node"), "facts")
    active, turn = mixed.join(facts.select("node"), "node", "left_semi"), 0
    leader = F.struct("node", "root", "sketch", "total", "common")
    most = None if sigmas is None else most_differing(alike, bands * rows, sigmas)

    def may_link(x: F.Column) -> F.Column:
        both = F.least(x["common"], F.col("common"))  # what the two share at most
        ok = (x["root"] != F.col("root")) & (both * (1 + alike) * (1 + 1e-9) >= alike * (x["total"] + F.col("total")))
        return ok if most is None else ok & (differing(x["sketch"], F.col("sketch"), bands * rows // 16) <= most)

    while True:
        now = cut(active.join(roots, "node").join(facts.drop("met"), "node"), "now")
        sizes = now.groupBy(*BUCKET, "root").agg(F.count("*").alias("n"))
        main = sizes.groupBy(*BUCKET).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        # leaders come from all components but the largest: few compare with many, not many with few
        may = now.join(main, BUCKET).where("root <> main")
        first = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(F.desc("met"), "node"))
        lead = may.withColumn("n", first).where(F.col("n") <= LEADERS[min(turn, len(LEADERS) - 1)])
        lead = cut(lead.groupBy(*BUCKET).agg(F.collect_list(leader).alias("leads")), "leads")
        if lead.isEmpty():
            return cut(connected_components(known.where(F.col("alike") >= alike).select("a", "b")).toDF("node", "root"), "components")
        met = now.join(lead, BUCKET).withColumn("leads_", F.exists("leads", lambda x: x["node"] == F.col("node")))
        other = F.filter("leads", lambda x: (~F.col("leads_") | (F.col("node") > x["node"])) & may_link(x))
        other = F.transform(other, lambda x: x["node"])
        each = met.select("node", other.alias("b")).where(F.size("b") > 0)  # a pair meets in many buckets, and is taken once
        each = each.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b"))
        pairs = each.select("node", F.explode("b").alias("b"))
        roots = merge(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")))
        active, turn = cut(met.where("not leads_").select(*BUCKET, "node", "met"), "active"), turn + 1
        discard(now, lead)


def _hooked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after one step of merging along the links: nodes of a component may still differ, those of two never agree."""
    ends = links.join(roots.toDF("a", "u"), "a").join(roots.toDF("b", "v"), "b").where("u <> v").select("u", "v").distinct()
    both = ends.union(ends.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hook = both.join(least, "u").groupBy("v").agg(F.min("m").alias("m")).select(F.col("v").alias("root"), F.least("v", "m").alias("to"))
    return roots.join(hook, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH,
    sigmas: float | None = SIGMAS,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, kept.

    Documents are linked when the weighted Jaccard similarity of their ``width``-word shingles is at least
    ``alike``; a class is what links connect, and its document with the smallest id is kept. Texts without
    words (null, empty, white space) are copies of each other. Rows that repeat an id and a text are one
    document: they count in class_size and share ``kept``. A null id is larger than any other; a class of
    null ids alone has a null class_id and keeps all. An id column named like another one of the result gets an
    underscore; other columns are not read. No rows give no rows.
    """
    out = _judged(docs, id_col, text_col, (), alike=alike, bands=bands, rows=rows, width=width, sigmas=sigmas)
    return out.select(F.col("id").alias(apart(id_col, "class_id", "class_size", "kept")), "class_id", "class_size", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...], **options) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, kept, and node if it is in ``more``."""
    row = cut(docs.select(F.col(id_col).alias("id"), nodes(text_col).alias("node")), "nodes")
    roots = classes(docs, text_col, **options)
    row = cut(row.join(roots, "node", "left").select("id", *more, F.coalesce("root", "node").alias("root")), "roots")
    summed = cut(row.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return row.join(summed, "root").withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose documents are kept, with all columns; ids that are null stay."""
    key, node = fresh(docs, "gone_id"), fresh(docs, "gone_node")
    gone = _judged(docs, id_col, text_col, ("node",), **options).where("not kept").select(F.col("id").alias(key), F.col("node").alias(node)).distinct()
    gone = cut(gone, "gone")
    clear, rest = cannot_contain(docs, id_col, gone, key), may_contain(docs, id_col, gone, key)
    own = fresh(docs, "own_node")
    rest = rest.withColumn(own, nodes(text_col))  # one id may stand on two texts, of which one stays
    rest = rest.join(gone, (rest[id_col] == F.col(key)) & (rest[own] == F.col(node)), "left_anti")
    return clear.unionByName(rest.drop(own))
