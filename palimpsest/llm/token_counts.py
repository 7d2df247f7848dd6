"""Edit-aware token counts over trees of pre-tokens.

A text is cut into pre-tokens, which are encoded on their own; LEAF of them make a leaf that knows its
characters and tokens, and a segment tree sums both. An edit finds its leaves by the character sums,
encodes them again with as much context as can change a boundary, goes on to the right until an old
boundary is met, and updates the sums above. The rest of the text is never looked at again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, bounded_batches

#: The pattern of pre-tokens that goes with byte-level rank files, as a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in a leaf; a leaf that has grown to GROWN times as many makes the tree anew.
LEAF, GROWN = 64, 4
#: A pre-token is decided by its characters and at most so many after it.
CONTEXT = 2
#: Pre-tokens whose number of tokens a worker remembers.
REMEMBERED = 400_000


class Counter:
    """Numbers of tokens of pre-tokens under a rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n

    def sum(self, pieces: list[str]) -> int:
        return sum(map(self, pieces))


@cache
def counter(path: str) -> Counter:
    return Counter(path)


_find = regex.compile(PATTERN).findall


class Tree:
    """The pre-token tree of one text. ``leaves`` are its strings, in order; sums[1] is the root's (characters, tokens)."""

    def __init__(self, leaves: list[str], tokens: list[int], count: Counter) -> None:
        self.count, self.leaves = count, leaves or [""]
        self._sum(tokens or [0])

    @classmethod
    def of(cls, text: str, count: Counter) -> Tree:
        leaves, tokens = cls._cut(_find(text), count)
        return cls(leaves, tokens, count)

    @staticmethod
    def _cut(pieces: list[str], count: Counter, size: int = LEAF) -> tuple[list[str], list[int]]:
        groups = [pieces[k : k + size] for k in range(0, len(pieces), size)]
        return ["".join(g) for g in groups], [count.sum(g) for g in groups]

    def _sum(self, tokens: list[int]) -> None:
        self.wide = 1 << (len(self.leaves) - 1).bit_length()
        sums = np.zeros((2 * self.wide, 2), np.int64)
        sums[self.wide : self.wide + len(self.leaves), 0] = [len(x) for x in self.leaves]
        sums[self.wide : self.wide + len(self.leaves), 1] = tokens
        level = self.wide
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        self.sums = sums

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        own = self.sums[self.wide : self.wide + len(self.leaves)]
        return own[:, 0].tolist(), own[:, 1].tolist()

    def _find_leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end) and where it begins."""
        node, begin = 1, 0
        while node < self.wide:
            node *= 2
            left = int(self.sums[node, 0])
            if at >= begin + left:
                begin += left
                node += 1
        leaf = node - self.wide
        if leaf >= len(self.leaves):
            leaf = len(self.leaves) - 1
            begin = self.chars - len(self.leaves[leaf])
        return leaf, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.wide + leaf
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, stop: int, text: str) -> int:
        """Replace characters [start, stop), clipped to the text, by ``text``; the number of characters encoded anew."""
        start = min(max(start, 0), self.chars)
        stop = min(max(stop, start), self.chars)
        first, begin = self._find_leaf(max(0, start - CONTEXT))
        while first and not begin:  # empty leaves
            first -= 1
        last, at = self._find_leaf(stop)
        own = "".join(self.leaves[first : last + 1])
        own = own[: start - begin] + text + own[stop - begin :]
        while True:  # until a boundary falls on the end of the last leaf
            ahead, k = "", last + 1
            while k < len(self.leaves) and len(ahead) <= CONTEXT:
                ahead += self.leaves[k]
                k += 1
            pieces, length = [], 0
            for piece in _find(own + ahead):
                if length >= len(own):
                    break
                pieces.append(piece)
                length += len(piece)
            if length == len(own):
                break
            last += 1
            own += self.leaves[last]
        size = max(1, -(-len(pieces) // (last - first + 1)))
        if size > GROWN * LEAF:
            leaves, tokens = self._cut(pieces, self.count)
            _, old = self.leaf_sums()
            self.leaves[first : last + 1] = leaves
            self._sum(old[:first] + tokens + old[last + 1 :])
        else:
            leaves, tokens = self._cut(pieces, self.count, size)
            for k in range(first, last + 1):
                i = k - first
                self._set(k, *((leaves[i], tokens[i]) if i < len(leaves) else ("", 0)))
        return len(own)


def _mapped(rows: DataFrame, text_col: str, more: str, work) -> DataFrame:
    """Rows with the columns ``more`` instead of those that begin with ``text_col`` and follow it; ``work`` takes a row's values."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(rows.sparkSession)
    place = rows.columns.index(text_col)
    kind = StructType([*rows.schema[:place], *StructType.fromDDL(more)])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                new = [work(*(c[i].as_py() for c in part.columns[place:])) for i in range(len(part))]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*new), list(schema)[place:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:place], *columns], schema=schema)

    return rows.mapInArrow(run, kind)


TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"


def build_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, leaf_chars, leaf_tokens, n_tokens): each row's text (null: empty) and the leaves of its tree.

    Rows that repeat an id are texts of their own; null ids are passed on; an id column named like another
    one of the result gets an underscore; other columns are not read; no rows give no rows.
    """

    def work(text: str | None) -> tuple:
        tree = Tree.of(text or "", counter(ranks_path))
        return text or "", *tree.leaf_sums(), tree.tokens

    return _mapped(docs.select(F.col(id_col).alias(apart(id_col, "text", "leaf_chars", "leaf_tokens", "n_tokens", "reencoded", "edits")), F.col(text_col).alias("text")), "text", TREE, work)


def apply_edits(trees: DataFrame, ranks_path: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """Trees (with ``edits``: array of (start, stop, text), one after the other) after their edits, and ``reencoded``.

    Positions are code points of the text as the edits before left it, clipped to it; a null text deletes;
    null edits count as none. ``reencoded`` is the number of characters that were encoded anew.
    """

    def work(text: str, chars: list[int], tokens: list[int], n: int, edits: list[dict] | None) -> tuple:
        ends = np.cumsum([0, *chars]).tolist()
        tree = Tree([text[a:b] for a, b in zip(ends, ends[1:])], list(tokens), counter(ranks_path))
        done = sum(tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "") for e in edits or [] if e)
        return "".join(tree.leaves), *tree.leaf_sums(), tree.tokens, done

    rows = trees.select(id_col, "text", "leaf_chars", "leaf_tokens", "n_tokens", F.col(edits_col).alias("edits"))
    return _mapped(rows, "text", TREE + ", reencoded long", work)
