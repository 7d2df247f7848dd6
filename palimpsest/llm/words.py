"""Words of Arrow text columns as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at a time.
BYTES = 2 << 20


def parts(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (columns ``texts``) have at most BYTES together, or of one row."""
    if not len(batch):
        return
    size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in texts)
    part = np.cumsum(size) // BYTES
    begin = 0
    for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]:
        yield batch.slice(begin, stop - begin)
        begin = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words begin, and the end); words are what stands between white space."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    each = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
    index = coded.indices.to_numpy()
    offsets = offsets - offsets[0]
    if "" in each:  # white space at either end of a text
        full = index != each.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        index = index[full]
    return hashes[index], offsets


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (across texts, too): as many as there are words, less width - 1."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)
