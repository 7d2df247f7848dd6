"""Routing hashes as DataFrame expressions, and BLAKE3 over numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's offset and prime, and the two factors of MurmurHash3's 64-bit finaliser; fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FMIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_M64, _M32 = (1 << 64) - 1, (1 << 32) - 1


def fmix64(x: int) -> int:
    for factor in FMIX:
        x = (x ^ (x >> 33)) * factor & _M64
    return x ^ (x >> 33)


def stable_hash_of(raw: bytes) -> int:
    h = FNV_OFFSET
    for b in raw:
        h = (h ^ b) * FNV_PRIME & _M64
    return fmix64(h)


def shard_of_hash(h: int, shards: int) -> int:
    return h * shards >> 64


def _half(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_M32))


def _times(hi: Column, lo: Column, factor: int) -> tuple[Column, Column]:
    """(hi, lo) * factor mod 2**64 by 16-bit limbs: no product reaches 2**63."""
    limbs = [factor >> s & 0xFFFF for s in (0, 16, 32, 48)]
    p0, p1 = lo * F.lit(limbs[0]), lo * F.lit(limbs[1])
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    cross = lambda x, a, b: _half(x * F.lit(a) + F.shiftleft((x * F.lit(b)).bitwiseAND(F.lit(0xFFFF)), 16))
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + cross(lo, limbs[2], limbs[3]) + cross(hi, limbs[0], limbs[1])
    return _half(high), _half(low)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def stable_hash(raw: Column) -> Column:
    """The 64-bit routing hash of bytes as struct(hi, lo) of its 32-bit halves, in the JVM alone."""
    digits = F.hex(raw)
    bytes_ = F.transform(
        F.filter(F.sequence(F.lit(0), F.length(raw)), lambda i: i < F.length(raw)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    )
    start = _pair(F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & _M32))
    fnv = F.aggregate(bytes_, start, lambda h, b: _pair(*_times(h["hi"], h["lo"].bitwiseXOR(b), FNV_PRIME)))

    def shifted(h: Column) -> Column:  # x ^ (x >> 33)
        return _pair(h["hi"], h["lo"].bitwiseXOR(F.shiftright(h["hi"], 1)))

    def times(factor: int):
        return lambda h: _pair(*_times(h["hi"], h["lo"], factor))

    for factor in FMIX:
        fnv = _let(_let(fnv, shifted), times(factor))
    return _let(fnv, shifted)


def hash_hex(h: Column) -> Column:
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.concat(half(h["hi"]), half(h["lo"]))


def shard_index(h: Column, shards: int) -> Column:
    """hash * shards >> 64."""
    return F.shiftright(h["hi"] * F.lit(shards) + F.shiftright(h["lo"] * F.lit(shards), 32), 32).cast("int")


#: BLAKE3's initial words (those of SHA-256), message permutation and flags; fixed values.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED = 1, 2, 4, 8, 16


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The 16 output words for rows of (chaining value, message words, counter, length, flags)."""
    n = len(block)
    v = np.zeros((16, n), np.uint32)
    v[:8] = cv.T
    v[8:12] = IV[:4, None]
    v[12], v[13] = (counter & _M32).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = length, flags
    m = block.T.copy()

    def g(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, (r1, r2) in ((x, (16, 12)), (y, (8, 7))):
            v[a] += v[b] + word
            v[d] = _rotate(v[d] ^ v[a], r1)
            v[c] += v[d]
            v[b] = _rotate(v[b] ^ v[c], r2)

    for _ in range(7):
        for k in range(4):
            g(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            g(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        m = m[PERMUTATION]
    v[:8] ^= v[8:]
    v[8:] ^= cv.T
    return v.T.copy()


def blake3(data: bytes, length: int = 32, key: bytes | None = None, seek: int = 0) -> bytes:
    """BLAKE3 of the data (keyed with 32 bytes), ``length`` bytes of its output from byte ``seek`` on."""
    iv = IV if key is None else np.frombuffer(key, "<u4").astype(np.uint32)
    base = 0 if key is None else KEYED
    chunks = max(1, -(-len(data) // 1024))
    padded = np.frombuffer(data + b"\0" * (chunks * 1024 - len(data)), "<u4").reshape(chunks, 16, 16)
    sizes = np.full(chunks, 1024)
    sizes[-1] = len(data) - 1024 * (chunks - 1)
    cv = np.tile(iv, (chunks, 1))
    last_block = np.maximum(0, -(-sizes // 64) - 1)
    final = None
    for b in range(int(last_block.max()) + 1):
        on = np.flatnonzero(b <= last_block)
        flags = np.full(len(on), base | (CHUNK_START if b == 0 else 0)) | np.where(b == last_block[on], CHUNK_END, 0)
        args = [cv[on], padded[on, b], on.astype(np.uint64), np.clip(sizes[on] - 64 * b, 0, 64).astype(np.uint32), flags.astype(np.uint32)]
        if chunks == 1 and b == last_block[0]:
            final = args
        cv[on] = _compress(*args)[:, :8]
    while len(cv) > 1:  # pairs from the left; an odd last one moves up
        pairs = len(cv) // 2
        blocks = cv[: 2 * pairs].reshape(pairs, 16)
        args = [np.tile(iv, (pairs, 1)), blocks, np.zeros(pairs, np.uint64), np.full(pairs, 64, np.uint32), np.full(pairs, base | PARENT, np.uint32)]
        if len(cv) == 2:
            final = args
        cv = np.concatenate([_compress(*args)[:, :8], cv[2 * pairs :]])
    first, count = seek // 64, (seek + length + 63) // 64 - seek // 64
    rep = lambda x: np.repeat(x, count, 0)
    counter = np.arange(first, first + count).astype(np.uint64)
    out = _compress(rep(final[0]), rep(final[1]), counter, rep(final[3]), rep(final[4] | np.uint32(ROOT)))
    return out.astype("<u4").tobytes()[seek % 64 : seek % 64 + length]


def blake3_many(units: list[bytes]) -> list[bytes]:
    """The 32-byte BLAKE3 of each unit, all units' chunks and tree levels at a time."""
    if not units:
        return []
    sizes = np.array([len(u) for u in units])
    chunks = np.maximum(1, -(-sizes // 1024))
    data = b"".join(u + b"\0" * (1024 * int(c) - len(u)) for u, c in zip(units, chunks))
    blocks = np.frombuffer(data, "<u4").reshape(-1, 16, 16)
    unit = np.repeat(np.arange(len(units)), chunks)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    held = np.clip(sizes[unit] - 1024 * place, 0, 1024)
    last = np.maximum(0, -(-held // 64) - 1)
    alone = chunks[unit] == 1
    cv = np.tile(IV, (len(unit), 1))
    for b in range(int(last.max()) + 1):
        on = np.flatnonzero(b <= last)
        end = b == last[on]
        flags = np.where(end, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0) | np.where(end & alone[on], ROOT, 0)
        cv[on] = _compress(cv[on], blocks[on, b], place[on].astype(np.uint64), np.clip(held[on] - 64 * b, 0, 64).astype(np.uint32), flags.astype(np.uint32))[:, :8]
    while len(cv) > len(units):
        n = np.bincount(unit, minlength=len(units))
        place = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < n[unit]))
        flags = np.where(n[unit[left]] == 2, PARENT | ROOT, PARENT).astype(np.uint32)
        both = np.concatenate([cv[left], cv[left + 1]], 1)
        cv[left] = _compress(np.tile(IV, (len(left), 1)), both, np.zeros(len(left), np.uint64), np.full(len(left), 64, np.uint32), flags)[:, :8]
        keep = np.ones(len(unit), bool)
        keep[left + 1] = False
        cv, unit = cv[keep], unit[keep]
    return [row.tobytes() for row in cv.astype("<u4")]
