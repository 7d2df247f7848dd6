"""Values that are computed from parameters: the registry is the store's surface for user functions."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import InvalidArgument, UnknownGenerator
from .hashing import blake3

MAX_PARAMS, MAX_MOTIF = 65536, 65536


def check_range(length: int, offset: int, n: int) -> None:
    """An empty range at the end is fine."""
    if offset < 0 or n < 0 or offset + n > length:
        raise InvalidArgument("range beyond the value")


@dataclass(frozen=True)
class Generator:
    """``length(params)`` and ``read(params, offset, n)``."""

    name: str
    id: int
    version: int
    length: Callable[[bytes], int]
    read: Callable[[bytes, int, int], bytes]

    def range(self, params: bytes, offset: int, n: int) -> bytes:
        check_range(self.length(params), offset, n)
        return self.read(params, offset, n)

    def whole(self, params: bytes) -> bytes:
        return self.read(params, 0, self.length(params))


def arith_params(start: int, step: int, count: int) -> bytes:
    return struct.pack("<QQQ", start, step, count)


def _arith(params: bytes) -> tuple[int, int, int]:
    if len(params) != 24:
        raise InvalidArgument("arithmetic parameters")
    start, step, count = struct.unpack("<QQQ", params)
    if count and start + step * (count - 1) >= 1 << 64 or count >= 1 << 61:
        raise InvalidArgument("arithmetic overflow")
    return start, step, count


def _arith_read(params: bytes, offset: int, n: int) -> bytes:
    start, step, _ = _arith(params)
    if not n:
        return b""
    first, last = offset // 8, (offset + n - 1) // 8
    values = np.array([(start + step * i) & (1 << 64) - 1 for i in (first,)], np.uint64) + np.uint64(step) * np.arange(last - first + 1, dtype=np.uint64)
    return values.astype("<u8").tobytes()[offset - 8 * first :][:n]


def xof_params(key: bytes, length: int) -> bytes:
    return key + struct.pack("<Q", length)


def _xof_length(params: bytes) -> int:
    if len(params) != 40:
        raise InvalidArgument("output parameters")
    return struct.unpack("<Q", params[32:])[0]


def _xof_read(params: bytes, offset: int, n: int) -> bytes:
    return blake3(b"", n, params[:32], offset) if n else b""


def repeat_params(length: int, motif: bytes) -> bytes:
    return struct.pack("<Q", length) + motif


def _repeat_length(params: bytes) -> int:
    if not 9 <= len(params) <= 8 + MAX_MOTIF:
        raise InvalidArgument("repeat parameters")
    return struct.unpack("<Q", params[:8])[0]


def _repeat_read(params: bytes, offset: int, n: int) -> bytes:
    motif = params[8:]
    at = offset % len(motif)
    return (motif * (-(-(at + n) // len(motif))))[at : at + n]


BUILTIN = (
    Generator("arith_u64", 1, 1, lambda p: 8 * _arith(p)[2], _arith_read),
    Generator("blake3_xof", 2, 1, _xof_length, _xof_read),
    Generator("repeat", 3, 1, _repeat_length, _repeat_read),
)


class Registry:
    """Generators by (id, version); the first registration of a pair stays."""

    def __init__(self) -> None:
        self.known = {(g.id, g.version): g for g in BUILTIN}

    def register(self, generator: Generator) -> bool:
        new = (generator.id, generator.version) not in self.known
        self.known.setdefault((generator.id, generator.version), generator)
        return new

    def get(self, id_: int, version: int = 1) -> Generator:
        if (id_, version) not in self.known:
            raise UnknownGenerator(f"{id_} v{version}")
        return self.known[id_, version]

    def list(self) -> list[tuple[int, int, str]]:
        return sorted((*k, g.name) for k, g in self.known.items())
