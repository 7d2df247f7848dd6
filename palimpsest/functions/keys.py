"""Keys: bounds, prefixes, history keys, message keys, snowflakes and routing bytes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError, InvalidArgument

#: A snowflake is milliseconds since EPOCH_MS (42 bits), worker (5), process (5), increment (12); fixed values.
EPOCH_MS = 1420070400000


def prefix_successor(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with the prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


@dataclass(frozen=True)
class Bound:
    """One end of a range: ``kind`` is included, excluded or unbounded."""

    kind: str = "unbounded"
    key: bytes | str = b""


UNBOUNDED = Bound()


def included(key: bytes | str) -> Bound:
    return Bound("included", key)


def excluded(key: bytes | str) -> Bound:
    return Bound("excluded", key)


def prefix_bounds(prefix: bytes | str) -> tuple[Bound, Bound]:
    """Half-open bounds, which reach the Parquet scan, where startswith on binary would not."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    after = prefix_successor(raw)
    if isinstance(prefix, str):
        after = after.decode() if after is not None else None
    return included(prefix) if raw else UNBOUNDED, UNBOUNDED if after is None else excluded(after)


def within(key: Column, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> Column:
    """Whether a key lies in a range. Inverted ranges hold nothing."""
    out = F.lit(True)
    if start.kind != "unbounded":
        out = key >= F.lit(start.key) if start.kind == "included" else key > F.lit(start.key)
    if end.kind != "unbounded":
        last = key <= F.lit(end.key) if end.kind == "included" else key < F.lit(end.key)
        out = last if start.kind == "unbounded" else out & last
    return out


def history_key(key: bytes, revision: int) -> bytes:
    """Bytes that sort by (key, revision): zero bytes are escaped as 00 FF, 00 00 ends the key."""
    return key.replace(b"\0", b"\0\xff") + b"\0\0" + revision.to_bytes(8, "big")


def parse_history_key(raw: bytes) -> tuple[bytes, int]:
    if len(raw) < 10 or raw[-10:-8] != b"\0\0":
        raise FormatError("history key")
    key = raw[:-10]
    plain = key.replace(b"\0\xff", b"\0")
    if history_key(plain, 0)[:-10] != key:
        raise FormatError("history key")
    return plain, int.from_bytes(raw[-8:], "big")


def message_key(channel: Column, message: Column) -> Column:
    """16 bytes: both numbers big-endian, so that keys sort by channel, then message."""
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(wide(channel), wide(message)))


def parse_message_key(key: Column) -> tuple[Column, Column]:
    part = lambda at: F.conv(F.hex(F.substring(key, at, 8)), 16, 10).cast("long")
    return part(1), part(9)


def channel_prefix(channel: int) -> bytes:
    return channel.to_bytes(8, "big")


def snowflake_parts(snowflake: Column) -> dict[str, Column]:
    s = snowflake
    return {
        "unix_ms": F.shiftright(s, 22) + F.lit(EPOCH_MS),
        "worker": F.shiftright(s, 17).bitwiseAND(F.lit(31)),
        "process": F.shiftright(s, 12).bitwiseAND(F.lit(31)),
        "increment": s.bitwiseAND(F.lit(4095)),
    }


def snowflake(unix_ms: Column, worker: Column, process: Column, increment: Column) -> Column:
    time = F.shiftleft((unix_ms - F.lit(EPOCH_MS)).cast("long"), 22)
    return time + F.shiftleft(worker.cast("long"), 17) + F.shiftleft(process.cast("long"), 12) + increment.cast("long")


class Snowflakes:
    """Strictly growing ids of one process; an overflow of the increment carries into the next millisecond."""

    def __init__(self, worker: int = 0, process: int = 0) -> None:
        if not (0 <= worker < 32 and 0 <= process < 32):
            raise InvalidArgument("worker and process: 0 to 31")
        self.fixed, self.last = worker << 17 | process << 12, -1

    def next_id(self, now_ms: int) -> int:
        self.last = max(self.last + 1, (now_ms - EPOCH_MS) << 12)
        return (self.last >> 12) << 22 | self.fixed | (self.last & 4095)


def shared_prefix(start: Bound, end: Bound) -> bytes:
    """The longest prefix that every key of a range has: where its ends agree, and one byte on where no key lies at the end itself."""
    if "unbounded" in (start.kind, end.kind):
        return b""
    a, b = (x.key.encode() if isinstance(x.key, str) else bytes(x.key) for x in (start, end))
    n = len(os.path.commonprefix([a, b]))
    if end.kind == "excluded" and len(b) == n + 1 and len(a) > n and a[n] + 1 == b[n]:
        n += 1 + len(a[n + 1 :]) - len(a[n + 1 :].lstrip(b"\xff"))
    return a[:n]


def first_bytes(key: Column, n: int) -> Column:
    return F.substring(key, 1, n)


def until_separator(key: Column, separator: str, count: int) -> Column:
    """The key up to its ``count``-th separator, whole where it has fewer (text keys)."""
    return F.substring_index(key, separator, count)


def until_separator_bytes(key: bytes, separator: int, count: int) -> tuple[bytes, bool]:
    at = -1
    for _ in range(count):
        at = key.find(bytes([separator]), at + 1)
        if at < 0:
            return key, False
    return key[:at], True
