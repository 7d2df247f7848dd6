"""A quality classifier: gradient-boosted trees on histograms of document statistics.

The trees are complete binary trees in flat arrays (feature, threshold, leaf), so that a batch of rows
goes down all trees at once, one numpy step per level.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh, give_back

#: At most this many labelled rows fit a model: those with the smallest hash of their id.
SAMPLE = 20_000
#: Bins per feature, depth, trees, step, leaf penalty and least hessian in a leaf.
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 5, 160, 0.1, 1.0, 3.0
THRESHOLD = 0.7

MARKS = b".,!?|#$%&*-_:;\"'()[]{}<>/\\@=+~`^"
_CLASS = np.zeros(256, np.int64)  # 0: other control characters
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", *(bytes([c]) for c in MARKS[:11]), MARKS[11:])):
    _CLASS[list(_set)] = _i + 1
_CLASS[128:192], _CLASS[192:] = _i + 2, _i + 3
CLASSES = _i + 4
ENDS = re.compile(r"[.!?][\"')\]]*$")
#: Parts of a text that are looked at on their own, for texts that are poor in places.
PARTS = 8


def features(text: str) -> np.ndarray:
    """Statistics of a whole text; an empty text gives zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return np.zeros(FEATURES)
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    size = len(raw)
    shares = np.bincount(kinds, minlength=CLASSES) / size
    edges = np.linspace(0, size, PARTS + 1).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum((kinds > 6) & (kinds < CLASSES - 2))])
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    width = np.maximum(np.diff(edges), 1)
    mark, caps = np.diff(marks[edges]) / width, np.diff(upper[edges]) / width
    count = Counter(words)
    top = count.most_common(3)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x]
    twice = sum(map(str.__eq__, words, words[1:]))
    last = sum(1 for w in words if w[-1] in ".!?")
    letters = sum(map(str.isalpha, words))
    pairs = len(set(zip(words, words[1:])))
    own = (
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), lengths.max(), len(count) / n, len(count) / n**0.75, top[0][1] / n, sum(c for _, c in top) / n,
        twice / n, last / n, letters / n, pairs / n, len(lines) / n, len(set(lines)) / max(1, len(lines)), size / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / size, mark.max(), mark.min(), caps.max(), caps.min(), float(bool(ENDS.search(text.rstrip()))),
    )
    return np.concatenate([own, shares])


FEATURES = 22 + CLASSES


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # the same; at most it goes left
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        trees, rows = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        out = self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting; with one class or no rows, the smoothed share of label 1 is every score."""
    n1 = int(y.sum())
    base = float(np.log((n1 + 1) / (len(y) - n1 + 1)))
    inner = 2**DEPTH - 1
    if n1 in (0, len(y)):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # bin b: edge b - 1 < x <= edge b
    n, f = bins.shape
    flat = bins + np.arange(f) * BINS
    raw = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(DEPTH):
            wide = 1 << level
            key = (node[:, None] * (f * BINS) + flat).ravel()
            gs, hs = (np.bincount(key, np.repeat(w, f), wide * f * BINS).reshape(wide, f, BINS).cumsum(2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            won = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            col, cut = best // BINS, best % BINS
            for k in np.flatnonzero(won):
                feature[t, wide - 1 + k], threshold[t, wide - 1 + k] = col[k], edges[col[k]][cut[k]]
            node = 2 * node + (won[node] & (bins[np.arange(n), col[node]] > cut[node]))
        gs, hs = (np.bincount(node, w, inner + 1) for w in (g, h))
        leaf[t] = -RATE * gs / (hs + RIDGE)
        raw += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def _mapped(docs: DataFrame, text_col: str, model: Trees | None) -> DataFrame:
    """``docs`` without its text, with ``score`` (or without a model ``features``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != text_col]
    kind = StructType([*kept, *StructType.fromDDL(f"`{fresh(docs, 'score')}` double" if model else "features array<double>")])
    schema, place = to_arrow_schema(kind), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([features(t.as_py() or "") for t in batch.column(place)])
            own = [c for i, c in enumerate(batch.columns) if i != place]
            new = pa.array(model.score(x)) if model else pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*own, new.cast(schema.field(len(own)).type)], schema=schema)
        give_back()

    return docs.mapInArrow(run, kind)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept for testing: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows outside the held-out ones.

    An id with several labels counts as 1 if at least half of them are; ids and labels that are null
    aren't used. The sample is bounded, so its ids are broadcast and its features fit the driver.
    """
    one = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    one = one.groupBy(F.col(id_col).alias("label_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    one = one.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(one), F.col("row_id") == F.col("label_id")).select("row_id", "y", "text")
    found = _mapped(rows, "text", None).orderBy(F.xxhash64("row_id"), "row_id", "features").limit(sample).toPandas()
    if not len(found):
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    return fit(np.stack(found["features"]).astype(float), found["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score``: the probability of label 1; null texts are empty and get a score too.

    All other columns stay; where one is named score, the new one is score_. No rows give no rows.
    """
    return _mapped(docs, text_col, model)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all columns."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.stack([features(t.as_py() or "") for t in batch.column(place)])
                yield batch.filter(pa.array(model.score(x) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
