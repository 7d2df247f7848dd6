"""Byte encodings: varints, envelopes and manifests (format version 1)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..errors import FormatError

MAGIC, HEADER, MAX_UNIT = b"BBO1", struct.Struct("<4sBBHIIQ32sQ"), 1 << 24
KINDS = ("inline", "chunks", "generated", "tombstone")
MAX_PARAMS = 65536


def put_varint(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 127, n >> 7
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def get_varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place after it); at most 64 bits, in the shortest form."""
    n = 0
    for k in range(10):
        if at + k >= len(raw):
            raise FormatError("varint is cut off")
        b = raw[at + k]
        n |= (b & 127) << 7 * k
        if b < 128:
            if (b == 0 and k) or n >> 64:
                break
            return n, at + k + 1
    raise FormatError("varint")


@dataclass(frozen=True)
class Envelope:
    codec_id: int
    codec_version: int
    raw_len: int
    aux_id: int
    digest: bytes
    body: bytes

    def encode(self) -> bytes:
        return HEADER.pack(MAGIC, self.codec_id, self.codec_version, 0, self.raw_len, len(self.body), self.aux_id, self.digest, 0) + self.body

    @classmethod
    def decode(cls, raw: bytes) -> Envelope:
        if len(raw) < HEADER.size:
            raise FormatError("envelope is cut off")
        magic, codec, version, flags, raw_len, body_len, aux, digest, reserved = HEADER.unpack_from(raw)
        if magic != MAGIC or flags or reserved or raw_len > MAX_UNIT or body_len != len(raw) - HEADER.size:
            raise FormatError("envelope header")
        return cls(codec, version, raw_len, aux, digest, raw[HEADER.size :])


@dataclass(frozen=True)
class Manifest:
    revision: int
    logical_len: int
    kind: str
    source_id: int | None = None
    envelope: Envelope | None = None
    chunks: list[tuple[int, int]] = field(default_factory=list)  # (logical end, object id)
    generator: tuple[int, int, bytes, bytes] | None = None  # id, version, params, digest

    def encode(self) -> bytes:
        head = struct.pack("<BQQBB", 1, self.revision, self.logical_len, KINDS.index(self.kind), self.source_id is not None)
        if self.source_id is not None:
            head += struct.pack("<Q", self.source_id)
        if self.kind == "inline":
            unit = self.envelope.encode()
            return head + put_varint(len(unit)) + unit
        if self.kind == "chunks":
            return head + put_varint(len(self.chunks)) + b"".join(struct.pack("<QQ", *c) for c in self.chunks)
        if self.kind == "generated":
            id_, version, params, digest = self.generator
            return head + struct.pack("<HH", id_, version) + put_varint(len(params)) + params + digest
        return head

    @classmethod
    def decode(cls, raw: bytes) -> Manifest:
        if len(raw) < 19:
            raise FormatError("manifest is cut off")
        version, revision, length, kind, flags = struct.unpack_from("<BQQBB", raw)
        if version != 1 or kind >= len(KINDS) or flags > 1:
            raise FormatError("manifest header")
        at, source = 19, None
        if flags:
            if len(raw) < 27:
                raise FormatError("manifest is cut off")
            (source,), at = struct.unpack_from("<Q", raw, at), 27
        name = KINDS[kind]
        if name == "tombstone":
            if length or at != len(raw):
                raise FormatError("tombstone")
            return cls(revision, 0, name, source)
        if name == "generated":
            if len(raw) < at + 4:
                raise FormatError("manifest is cut off")
            id_, of = struct.unpack_from("<HH", raw, at)
            n, at = get_varint(raw, at + 4)
            if n > MAX_PARAMS or len(raw) != at + n + 32:
                raise FormatError("generated manifest")
            return cls(revision, length, name, source, generator=(id_, of, raw[at : at + n], raw[at + n :]))
        n, at = get_varint(raw, at)
        if name == "inline":
            if n != len(raw) - at:
                raise FormatError("inline manifest")
            unit = Envelope.decode(raw[at:])
            if unit.raw_len != length:
                raise FormatError("inline length")
            return cls(revision, length, name, source, envelope=unit)
        if not n or n * 16 != len(raw) - at:
            raise FormatError("chunk count")
        chunks = [struct.unpack_from("<QQ", raw, at + 16 * k) for k in range(n)]
        ends = [0, *(end for end, _ in chunks)]
        if any(b <= a for a, b in zip(ends, ends[1:])) or ends[-1] != length or not all(i for _, i in chunks):
            raise FormatError("chunks")
        return cls(revision, length, name, source, chunks=chunks)
