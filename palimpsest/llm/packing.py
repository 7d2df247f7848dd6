"""Order-preserving packing of token ids into sequences by dynamic programming.

Documents are laid end to end in the order in which their rows come (the order of the table's files,
which a global shuffle before has made random): no exchange is needed, and a task streams its split
with bounded look-ahead. Cuts are chosen among document ends, sentence ends and, inside long
sentences, every few tokens; the sum of padding and truncation penalties is the least that the
look-ahead allows. f(j) = min over windows (i, j] of f(i) + size - (p_j - p_i) + penalty(j), whose
minimum over i slides with j in a monotone queue.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, bounded_batches, give_back

#: White space that Arrow and the tokenizers may see differently: texts with it are encoded in one go.
ODD = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"
#: Bytes of text whose words are encoded together, words in one call, and words of texts whose ids are laid out at a time.
BYTES, WORDS, LAID = 16 << 20, 4096, 1 << 17
#: Marks that can follow a word of letters; they are tokens of their own.
AFTER = ".,!?#$%&*|;:"
#: Tokens that one run of the dynamic programme looks at; all but the last windows of a run are final.
LOOK_AHEAD = 1 << 19
#: Penalties in tokens of padding: a cut inside a document after a sentence, a cut inside a sentence, a shorter window.
SENTENCE, INSIDE, SHORTER = 8, 64, 32
#: Stretches without a sentence end get a place to cut after so many tokens.
STEP = 64

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts, equal to the tokenizer's own: each distinct word between white space is encoded once per call."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.sentence_end = self._marked(vocab, r"[.!?][\"')\]]*</w>$")
        self.word_end = self._marked(vocab, "</w>$")

    @staticmethod
    def _marked(vocab: dict[str, int], pattern: str) -> np.ndarray:
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for s, i in vocab.items() if re.search(pattern, s)]] = True
        return out

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each)."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of letters alone, many per call: each ends at its first token that ends a word."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), WORDS):
            own = words[k : k + WORDS]
            ids = np.array(self._whole([" ".join(own)])[0], np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            size = np.diff(ends, prepend=0)
            if len(ends) != len(own):  # a letter became several when lower-cased
                ids, size = self._flat(self._whole(own))
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes): each word is two stretches of ids, its letters and the marks after them."""
        stems = pc.utf8_rtrim(words, AFTER)
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        coded = stems.filter(pa.array(plain)).dictionary_encode()
        letters, letter_sizes = self._letters(coded.dictionary.to_pylist())
        odd, odd_sizes = self._flat(self._whole(words.filter(pa.array(~plain)).to_pylist()))
        length = lambda a: pc.utf8_length(a).to_numpy(zero_copy_only=False)
        kept = length(stems)
        tailed = np.flatnonzero(plain & (length(words) > kept))
        tails = [w[n:] for w, n in zip(words.take(pa.array(tailed)).to_pylist(), kept[tailed].tolist())]
        known = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        marks, mark_sizes = self._flat(self._whole(list(known)))
        begins, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        at = lambda s: np.cumsum(s) - s
        index = coded.indices.to_numpy(zero_copy_only=False)
        begins[plain, 0], sizes[plain, 0] = at(letter_sizes)[index], letter_sizes[index]
        begins[~plain, 0], sizes[~plain, 0] = at(odd_sizes) + len(letters), odd_sizes
        index = np.fromiter(map(known.__getitem__, tails), np.int64, len(tails))
        begins[tailed, 1], sizes[tailed, 1] = at(mark_sizes)[index] + len(letters) + len(odd), mark_sizes[index]
        return np.concatenate([letters, odd, marks]), begins, sizes

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty. Ids of many texts never stand in memory together."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        words = pc.utf8_split_whitespace(texts)
        offsets = words.offsets.to_numpy()
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        flat, begins, sizes = self._words(coded.dictionary)
        index = coded.indices.to_numpy()
        offsets = offsets.astype(np.int64) - offsets[0]
        odd, text = set(odd.tolist()), 0
        while text < len(texts):
            stop = max(text + 1, int(np.searchsorted(offsets, offsets[text] + LAID, "right")) - 1)  # or one long text
            own = index[offsets[text] : offsets[stop]]
            size = sizes[own].ravel()
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(begins[own].ravel() - upto[:-1], size) + np.arange(upto[-1])]
            ends = upto[2 * (offsets[text : stop + 1] - offsets[text])]
            for k in range(text, stop):
                if k in odd:
                    yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[ends[k - text] : ends[k - text + 1]]
            text = stop


def places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, ascending, and the penalty there. ``ends``: where documents end, the last at len(ids)."""
    soft = np.flatnonzero(sentence_end[ids]) + 1
    at = np.union1d(soft, ends)
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > min(size, 4 * STEP))
    more = [np.arange(at[k] - gaps[k] + min(STEP, size), at[k], min(STEP, size)) for k in long]
    at = np.unique(np.concatenate([at, *more])) if more else at
    cost = np.full(len(at), INSIDE)
    cost[np.isin(at, soft)] = SENTENCE
    cost[np.isin(at, ends)] = 0
    return at, cost


def cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Ends of the windows of least padding plus penalties; ``at`` has no gap above ``size``."""
    pos, n = [0, *at.tolist()], len(at)
    pen = [0, *cost.tolist()]
    back = np.full(pos[-1] + 1, -1, np.int64)
    back[pos] = np.arange(n + 1)
    shorter = [p for p in (size // 2, size // 4, size // 8) if p and not p & (p - 1)]
    exact = [[-1, *np.where(at >= p, back[np.maximum(at - p, 0)], -1).tolist()] for p in shorter]
    best, via = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p_i, i), ascending
    for j in range(1, n + 1):
        p = pos[j]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        value, i = queue[0]
        value += size - p
        for known in exact:
            k = known[j]
            if k >= 0 and best[k] + SHORTER < value:
                value, i = best[k] + SHORTER, k
        value += pen[j]
        best[j], via[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out = []
    while n:
        out.append(pos[n])
        n = via[n]
    return out[::-1]


class Packer:
    """Takes documents one by one and gives back pieces (row, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, sentence_end: np.ndarray, look_ahead: int = LOOK_AHEAD) -> None:
        self.size, self.sentence_end, self.look_ahead = size, sentence_end, max(look_ahead, 16 * size)
        self.docs: list[tuple[object, np.ndarray, int]] = []  # row, ids, ids that are packed already
        self.waiting, self.sequence = 0, 0

    def add(self, row: object, ids: np.ndarray) -> list[tuple]:
        self.docs.append((row, ids, 0))
        self.waiting += len(ids)
        return self.pack(False) if self.waiting >= self.look_ahead else []

    def pack(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        rest = [ids[done:] for _, ids, done in self.docs]
        ends = np.cumsum([len(x) for x in rest])
        windows = cuts(*places(np.concatenate(rest), ends, self.sentence_end, self.size), self.size)
        windows = windows if last else windows[:-8]
        out, left, begin = [], 0, 0
        done = [d for _, _, d in self.docs]
        for stop in windows:
            offset = 0
            while begin < stop:
                row, ids, _ = self.docs[left]
                take = min(stop - begin, len(ids) - done[left])
                piece = ids[done[left] : done[left] + take]
                out.append((row, done[left], take, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, offset))
                done[left] += take
                offset += take
                begin += take
                if done[left] == len(ids):
                    left += 1
            self.sequence += 1
        self.docs = [(row, ids, d) for (row, ids, _), d in zip(self.docs[left:], done[left:])]
        self.waiting -= begin
        return out


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of (id, text) of at most BYTES of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) // BYTES) if len(sizes) else sizes
    begin = 0
    for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]:
        if stop > begin:
            yield batch.slice(begin, stop - begin)
        begin = stop


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    look_ahead: int = LOOK_AHEAD,
) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; a null text is ``end_id`` alone. Each id is in one piece,
    pieces keep the order of rows, and a sequence has at most ``size`` ids without gaps. Rows that repeat
    an id are documents of their own; a null id is passed on; an id column named like another one of the result gets
    an underscore; other columns are not read; no rows give no rows. Sequence ids are unique
    over all tasks and grow with the split's number; a task that is run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        packer = Packer(size, encoder.sentence_end, look_ahead)
        first = TaskContext.get().partitionId() << 40
        kind = schema

        def give(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            columns[5] = [first + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        for batch in batches:
            for part in parts(batch):
                for name, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    if pieces := packer.add(name, np.append(ids, np.uint32(end_id))):
                        yield give(pieces)
        if pieces := packer.pack(True):
            yield give(pieces)
        del packer, encoder
        give_back()

    bounded_batches(docs.sparkSession, 16)  # words are encoded once per batch
    named = apart(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    rows = docs.select(F.col(id_col).alias(named), F.col(text_col))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([rows.schema[0], *StructType.fromDDL(SCHEMA)])
    schema = to_arrow_schema(out)
    return rows.mapInArrow(run, out)
