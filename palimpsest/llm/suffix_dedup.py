"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at minimisers alone: of any WINDOW runs of GRAM words in a row, the run with the
smallest hash. A passage of GRAM + WINDOW - 1 words or more has the same minimiser wherever it stands.
Suffixes whose first run occurs in one text only can't repeat and are left out; the others, with the words
around them, are sorted as a suffix array by range partitioning, and each is compared with its neighbours
of other texts, before and after it, and extended to the left and to the right. Texts that are
copies of each other are one text in the array.

A neighbour has the longest common right part, not the longest left and right one together: where a passage
ends in words that many texts hold without its head, its partner may be any number of rows away. So the
windows of the least length at kept minimisers are grouped by their hash, too, and those of two documents
or more are marked, wherever they stand in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import apart, bounded_batches, cut, may_contain, text_of
from .words import hashed, parts, rolling

#: Least words of a repeated passage; words of a run; runs of which one is kept.
LEAST, GRAM, WINDOW = 50, 16, 32
#: Words to the left and right of a minimiser that are compared (to the right as many as ``least`` where that is more):
#: minimisers come at least every WINDOW words, so that the matches of neighbouring ones overlap and long passages are found whole.
LEFT, RIGHT = 32, 50
#: Suffixes in one Arrow batch.
ROWS = 20_000


def picked(hashes: np.ndarray, offsets: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each window of ``window`` runs begins, the place of its minimiser, hashes of all runs); ``window`` is a power of two, 32 at most.

    Among equal runs, as in a text that repeats one word, the one at a multiple of 32 is smallest, so
    that such texts don't keep all their places.
    """
    n = np.diff(offsets)
    runs = rolling(hashes, gram)
    if len(runs) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    begin = np.repeat(offsets[:-1], n)
    place = (np.arange(len(hashes)) - begin)[: len(runs)].astype(np.uint64)
    low = ((place & np.uint64(31)) << np.uint64(15)) | ((place >> np.uint64(5)) & np.uint64(0x7FFF))
    key = (runs >> np.uint64(20) << np.uint64(20)) | low
    step = 1
    while step < window:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    inside = np.flatnonzero(place[: len(key)].astype(np.int64) + gram + window - 1 <= np.repeat(n, n)[: len(key)])
    low = key[inside] & np.uint64(0xFFFFF)
    mod = (((low & np.uint64(0x7FFF)) << np.uint64(5)) | (low >> np.uint64(15))).astype(np.int64)
    ahead = (mod - place[inside].astype(np.int64)) & 0xFFFFF
    return inside, inside + ahead, runs


def minimisers(hashes: np.ndarray, offsets: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``hashes``, hashes of the runs there) of all texts' minimisers."""
    _, at, runs = picked(hashes, offsets, gram, window)
    at = np.unique(at)
    return at, runs[at]


def _anchors():
    kind = pa.schema([("node", pa.binary()), ("words", pa.int64()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, offsets = hashed(part.column(1))
                at, grams = minimisers(words, offsets)
                text = np.searchsorted(offsets, at, "right") - 1
                ends = pa.array(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (grams.view(np.int64), at - offsets[text])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), pa.array(np.diff(offsets)), *lists], schema=kind)

    return run


def _bytes(words: np.ndarray) -> pa.Array:
    data = words.astype(">u4").tobytes()
    ends = np.arange(len(words) + 1, dtype=np.int32) * (4 * words.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)])


SUFFIX = "after binary, node binary, place bigint, before binary, n_after int, n_before int"
_SUFFIX = pa.schema([("after", pa.binary()), ("node", pa.binary()), ("place", pa.int64()), ("before", pa.binary()), ("n_after", pa.int32()), ("n_before", pa.int32())])


def _suffixes(ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, offsets = hashed(part.column(1))
                small = np.append(words >> np.uint64(32), np.uint64(0)).astype(np.uint32)
                lists = part.column(2)
                n = np.diff(lists.offsets.to_numpy())
                text = np.repeat(np.arange(len(part)), n)
                place = lists.flatten().to_numpy()
                node = part.column(0)
                for k in range(0, len(place), ROWS):
                    t, p = text[k : k + ROWS], place[k : k + ROWS]
                    at, n_after = offsets[t] + p, np.minimum(ahead, offsets[t + 1] - offsets[t] - p)
                    n_before = np.minimum(LEFT, p)
                    right, left = np.arange(ahead), np.arange(LEFT)
                    after = small[np.where(right < n_after[:, None], at[:, None] + right, -1)]
                    before = small[np.where(left < n_before[:, None], at[:, None] - 1 - left, -1)]
                    yield pa.RecordBatch.from_arrays(
                        [_bytes(after), node.take(pa.array(t)).cast(pa.binary()), pa.array(p), _bytes(before), pa.array(n_after.astype(np.int32)), pa.array(n_before.astype(np.int32))], schema=_SUFFIX
                    )

    return run


def _words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), width)


def _same(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The number of equal words at the start of rows of a and b, ``limit`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), limit)


_FOUND = pa.schema([*_SUFFIX, ("begin", pa.int64()), ("stop", pa.int64()), ("other", pa.binary())])
FOUND = SUFFIX + ", begin bigint, stop bigint, other binary"


def _neighbours(least: int, edges: bool, ahead: int):
    """Of rows in suffix order: matches (node, begin, stop, other), and with ``edges`` the suffixes whose neighbours lie in other tasks.

    Of equal suffixes of one text the first stands for all, so that a text which repeats one line makes no
    long run; their windows are marked with those of other texts.
    """

    def matches(rows: pa.Table, done: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch | None:
        """Rows ``done`` against the row before and the row after their run of one node."""
        after, before = _words(rows.column("after"), ahead), _words(rows.column("before"), LEFT)
        na, nb = rows.column("n_after").to_numpy(), rows.column("n_before").to_numpy()
        place, out = rows.column("place").to_numpy(), []
        for side in (first - 1, last):
            i = done[(side[done] >= 0) & (side[done] < len(place))]
            j = side[i]
            right = _same(after[i], after[j], np.minimum(na[i], na[j]))
            left = _same(before[i], before[j], np.minimum(nb[i], nb[j]))
            ok = right + left >= least
            i, j = i[ok], j[ok]
            out.append((i, place[i] - left[ok], place[i] + right[ok], j))
        i, begin, stop, j = (np.concatenate(x) for x in zip(*out))
        if not len(i):
            return None
        none = {f.name: pa.nulls(len(i), f.type) for f in _SUFFIX}
        none |= {"node": rows.column("node").take(pa.array(i)), "begin": pa.array(begin), "stop": pa.array(stop), "other": rows.column("node").take(pa.array(j))}
        return pa.Table.from_pydict(none, schema=_FOUND).combine_chunks().to_batches()[0]

    def edge(rows: pa.Table) -> pa.RecordBatch | None:
        if not len(rows) or not edges:
            return None
        more = {f.name: (rows.column(f.name) if f.name in _SUFFIX.names else pa.nulls(len(rows), f.type)) for f in _FOUND}
        return pa.Table.from_pydict(more, schema=_FOUND).combine_chunks().to_batches()[0]

    def repeated(rows: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
        """Which rows are the same suffix of the same text as the row before them."""
        out = np.ones(len(rows), bool)
        out[0] = before is not None
        for c in ("node", "after", "before"):
            own = rows.column(rows.schema.get_field_index(c))
            out[1:] &= pc.equal(own.slice(1), own.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
            out[0] &= before is not None and before.column(before.schema.get_field_index(c))[0] == own[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the last run, and the row before it
        head, before = True, None
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS).cast(_SUFFIX)
                again, before = repeated(part, before), part.slice(len(part) - 1)
                part = part.filter(pa.array(~again))
                if not len(part):
                    continue
                new = pa.Table.from_batches([part])
                rows = (pa.concat_tables([kept, new]) if kept is not None else new).combine_chunks()
                node = np.array(rows.column("node").to_pylist(), object)
                starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                run_of = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
                ends = np.append(starts[1:], len(node))
                if head and len(starts) > 1:
                    head = False
                    if x := edge(rows.slice(0, int(starts[1]))):
                        yield x
                carried = 0 if kept is None or len(kept) == 0 else int(kept.schema.metadata[b"row"])
                done = np.arange(carried, starts[-1])
                if len(done) and (x := matches(rows, done, starts[run_of], ends[run_of])):
                    yield x
                begin = max(0, int(starts[-1]) - 1)
                kept = rows.slice(begin).replace_schema_metadata({"row": str(int(starts[-1]) - begin)})
        if kept is not None:
            own = int(kept.schema.metadata[b"row"])
            if own:
                n = len(kept)
                if x := matches(kept.combine_chunks(), np.arange(1, n), np.full(n, 1), np.full(n, n)):
                    yield x
            if x := edge(kept.slice(own)):
                yield x

    return run


WINDOWS = "hash bigint, node binary, place bigint, low bigint, high bigint"
_WINDOWS = pa.schema([("hash", pa.int64()), ("node", pa.binary()), ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _windows(least: int):
    """Of rows (node, text, places, low, high): the windows of ``least`` words whose first and last minimisers are among the places."""
    last = least - (GRAM + WINDOW - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, offsets = hashed(part.column(1))
                start, at, _ = picked(words, offsets)
                lists = part.column(2)
                shared, good = np.zeros(len(words), bool), np.zeros(len(words) + last, bool)
                shared[np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()] = True
                good[start[shared[at]]] = True
                begin = np.flatnonzero(good[: len(words)] & good[last:])
                text = np.searchsorted(offsets, begin, "right") - 1
                inside = begin + least <= offsets[text + 1]
                begin, text = begin[inside], text[inside]
                hashes = rolling(words, least).view(np.int64)[begin]
                for k in range(0, len(begin), ROWS):
                    b, t = begin[k : k + ROWS], pa.array(text[k : k + ROWS])
                    who = [part.column(c).take(t) for c in (3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + ROWS]), part.column(0).take(t).cast(pa.binary()), pa.array(b - offsets[text[k : k + ROWS]]), *who], schema=_WINDOWS)

    return run


def _repeated(held: DataFrame, owners: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """Spans (node, begin, stop, other_id, other_high) of the windows that stand in two documents or more, of texts of one document.

    Documents are told apart by hashes of their ids: ``low`` and ``high`` are the least and the largest of a text's documents.
    """
    windows = held.join(owners, "node").select("node", "text", "places", "low", "high").mapInArrow(_windows(least), WINDOWS)
    windows = cut(windows, "windows")
    twice = windows.groupBy("hash").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    other = F.when(F.col("least") != F.col("low"), F.col("least")).otherwise(F.col("most"))
    marked = windows.where("low = high").join(cut(twice, "twice"), "hash")
    marked = marked.select("node", F.col("place").alias("begin"), (F.col("place") + least).alias("stop"), other.alias("other_id"), other.alias("other_high"))
    named = ids.select(F.xxhash64("id").alias("who"), F.col("id").alias("other")).distinct()
    spans = islands(marked).join(named, F.col("other_id") == F.col("who"))
    return spans.select("node", "begin", "stop", F.col("other").alias("other_id"), F.col("other").alias("other_high"))


def node_of(text_col: str) -> Column:
    return F.substring(F.unhex(F.sha2(text_of(text_col), 256)), 1, 16)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Passages of at least ``least`` words that stand in another document, too: id, begin_word, stop_word, n_words, other_id.

    Words are what stands between white space, compared by hashes, ``least`` or more in a row; stop
    is exclusive; overlapping passages of a text are one. ``other_id`` is a document that shares a part of it.
    Documents without such a passage have no row; a passage repeated within one document alone isn't one.
    Rows that repeat an id and a text are one document. Null texts are empty. Null ids are one document's.
    An id column named like another one of the result gets an underscore; other columns are not read.
    """
    if least < GRAM + WINDOW - 1:
        raise ValueError(f"least: {GRAM + WINDOW - 1} at least")
    ahead = max(RIGHT, least)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), node_of(text_col).alias("node"), text_of(text_col).alias("text"))
    signed = rows.select("node", "text").mapInArrow(_anchors(), "node binary, words bigint, grams array<bigint>, places array<bigint>")
    one = cut(signed.groupBy("node").agg(F.first("words").alias("words"), F.first("grams").alias("grams"), F.first("places").alias("places")), "minimisers")
    anchor = one.select("node", F.explode(F.arrays_zip("grams", "places")).alias("a")).select("node", F.col("a.grams").alias("gram"), F.col("a.places").alias("place"))
    shared = anchor.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("gram")
    asked = anchor.join(cut(shared, "grams"), "gram", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("place")).alias("places"))
    asked = cut(asked, "asked")
    texts = may_contain(rows.select("node", "text"), "node", asked, "node").groupBy("node").agg(F.first("text").alias("text"))
    held = cut(texts.join(asked, "node").select("node", "text", "places"), "held")
    suffixes = held.mapInArrow(_suffixes(ahead), SUFFIX)
    order = ["after", "before", "node", "place"]  # of equal suffixes, those with the most words before in common are neighbours
    sorted_ = cut(suffixes, "suffixes").repartitionByRange("after", "before", "node").sortWithinPartitions(*order)
    found = cut(sorted_.mapInArrow(_neighbours(least, True, ahead), FOUND), "found")
    ends = found.where("begin is null").select(*_SUFFIX.names)  # some rows a task: where one task's suffixes meet the next one's
    met = ends.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(least, False, ahead), FOUND)
    spans = found.unionByName(cut(met, "met")).where("begin is not null").select("node", "begin", "stop", "other")

    ids = cut(rows.select("id", "node").distinct(), "ids")
    copies = ids.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    copies = cut(copies.join(one.select("node", "words"), "node"), "copies")
    whole = copies.where((F.col("n") > 1) & (F.col("words") >= least)).select("node", "words", "low", "high")
    joined = spans.join(copies.select(F.col("node").alias("other"), F.col("low").alias("other_id"), F.col("high").alias("other_high")), "other")
    owners = ids.groupBy("node").agg(F.min(F.xxhash64("id")).alias("low"), F.max(F.xxhash64("id")).alias("high"))
    joined = joined.drop("other").unionByName(cut(_repeated(held, owners, ids, least), "repeated"))
    merged = islands(joined.join(whole.select("node"), "node", "left_anti"))
    parts_ = ids.join(merged, "node").withColumn("other_id", F.when(F.col("id").eqNullSafe(F.col("other_id")), F.col("other_high")).otherwise(F.col("other_id")))
    parts_ = parts_.where(~F.col("id").eqNullSafe(F.col("other_id"))).select("id", "begin", "stop", "other_id")
    all_ = ids.join(whole, "node").select("id", F.lit(0).cast("long").alias("begin"), F.col("words").alias("stop"), F.when(F.col("id").eqNullSafe(F.col("low")), F.col("high")).otherwise(F.col("low")).alias("other_id"))
    out = parts_.unionByName(all_)
    return out.select(F.col("id").alias(apart(id_col, "begin_word", "stop_word", "n_words", "other_id")), F.col("begin").alias("begin_word"), F.col("stop").alias("stop_word"), (F.col("stop") - F.col("begin")).alias("n_words"), "other_id")


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a node as one."""
    from pyspark.sql import Window

    by = Window.partitionBy("node").orderBy("begin", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach >= F.col("begin"), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    best = marked.groupBy("node", "island").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min("other_id").alias("other_id"), F.max("other_high").alias("other_high"))
    return best.drop("island")
