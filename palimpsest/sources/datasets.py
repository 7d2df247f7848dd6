"""Deterministic datasets of six kinds, as pure functions of (kind, seed, place, size), made on the executors."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.codecs import zstd_encode
from ..functions.hashing import blake3, fmix64
from ..functions.keys import EPOCH_MS

KINDS = ("repetitive", "sequences", "chat", "duplicates", "entropy", "compressed")
#: Of every ten records of ``duplicates`` so many copy an earlier one; channels and users of ``chat``; milliseconds between messages.
COPIES, CHANNELS, USERS, GAP_MS, BASE_MS = 3, 1000, 10_000, 100, 1735689600000


def _hash(*parts: int) -> int:
    h = 0
    for p in parts:
        h = fmix64((h ^ p) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return h


def _bytes(kind: int, seed: int, i: int, n: int) -> bytes:
    return blake3(struct.pack("<QQQ", kind, seed & (1 << 64) - 1, i), n)


def zipf_rank(u: float, n: int) -> int:
    """A rank in [0, n) with probability near 1 / (rank + 1), by the inverse of the harmonic sum."""
    return min(n - 1, int((n + 1) ** u) - 1)


def is_copy(i: int) -> bool:
    """Whether a record copies another: COPIES of every ten, at places that move from ten to ten."""
    return i >= 10 and (i + i // 10) % 10 < COPIES


def duplicate_root(seed: int, i: int) -> int:
    """The record whose bytes record ``i`` has: a copy names one of an earlier ten, which may be a copy itself."""
    while is_copy(i):
        i = _hash(seed, 77, i) % (i - i % 10)
    return i


def value(kind: str, seed: int, i: int, size: int) -> bytes:
    k = KINDS.index(kind)
    if kind == "repetitive":
        if i % 2 == 0:
            return bytes(size)
        motif = _bytes(k, seed, i, 2 + _hash(seed, i) % 63)
        return (motif * (size // len(motif) + 1))[:size]
    if kind == "sequences":
        start, step = _hash(seed, i, 1) >> 16, 1 + _hash(seed, i, 2) % 65536
        return b"".join(struct.pack("<Q", start + step * j) for j in range(size // 8))
    if kind == "chat":
        channel = zipf_rank(_hash(seed, i, 3) / 2**64, CHANNELS)
        user = zipf_rank(_hash(seed, i, 4) / 2**64, USERS)
        id_ = (BASE_MS + GAP_MS * i - EPOCH_MS) << 22
        body = {"id": str(id_), "channel_id": str(channel), "author": {"id": str(user), "username": f"user{user}"}, "content": "", "timestamp": str(BASE_MS + GAP_MS * i), "mentions": [], "pinned": False}
        words, content = _bytes(k, seed, i, size).hex(), []
        room = size - len(json.dumps(body, separators=(",", ":")))
        at = 0
        while sum(map(len, content)) + len(content) < room:
            n = 2 + int(words[at % len(words)], 16) % 8
            content.append(words[at % len(words) :][:n] or "a")
            at += n
        body["content"] = " ".join(content)[: max(0, room)]
        return json.dumps(body, separators=(",", ":")).encode()
    if kind == "duplicates":
        return _bytes(k, seed, duplicate_root(seed, i), size)
    if kind == "entropy":
        return _bytes(k, seed, i, size)
    if kind == "compressed":
        return zstd_encode(_bytes(k, seed, i, max(1, size - 13)))
    raise InvalidArgument(kind)


def records(spark: SparkSession, kind: str, n: int, size: int, seed: int = 42) -> DataFrame:
    """(i, key, value) of ``n`` records."""
    if kind not in KINDS:
        raise InvalidArgument(kind)
    schema = pa.schema([("i", pa.int64()), ("key", pa.string()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                i = batch.column(0).slice(k, 1024)
                made = [value(kind, seed, x, size) for x in i.to_pylist()]
                yield pa.RecordBatch.from_arrays([i, pa.array([f"{kind}/{x:012}" for x in i.to_pylist()]), pa.array(made, pa.binary())], schema=schema)

    return spark.range(n).select(F.col("id").alias("i")).mapInArrow(run, "i bigint, key string, value binary")


def digest(rows: DataFrame) -> str:
    """One digest of (i, key, value) in any order of rows: each row's hash, summed."""
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "i", "key", F.sha2("value", 256)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return str(rows.agg(F.sum(one)).first()[0])
