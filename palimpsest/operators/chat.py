"""Channels of messages over a store: keys are (channel, message id), both big-endian."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RevisionConflict
from ..functions.keys import Bound, Snowflakes, excluded, included, parse_message_key, prefix_bounds
from .scans import latest as latest_rows

RETRIES = 16


def page(messages: DataFrame, n: int, before: int | None = None) -> DataFrame:
    """The newest ``n`` messages of every channel, or of those older than ``before``, newest first by ``rank``."""
    return latest_rows(messages, "channel", "id", n, None if before is None else F.col("id") < before)


class Chat:
    def __init__(self, store, worker: int = 0, process: int = 0) -> None:
        self.store, self.ids = store, Snowflakes(worker, process)

    @staticmethod
    def key(channel: int, message: int) -> bytes:
        return channel.to_bytes(8, "big") + message.to_bytes(8, "big")

    def send(self, channel: int, payload: bytes, now_ms: int | None = None) -> int:
        message = self.ids.next_id(int(time.time() * 1000) if now_ms is None else now_ms)
        self.insert(channel, message, payload)
        return message

    def insert(self, channel: int, message: int, payload: bytes) -> int:
        """Fails if the message is there."""
        return self.store.put(self.key(channel, message), payload, "absent")

    def get(self, channel: int, message: int) -> bytes | None:
        return self.store.get(self.key(channel, message))

    def edit(self, channel: int, message: int, payload: bytes) -> bool:
        """Replace an existing message by compare and set; False if it is missing."""
        for _ in range(RETRIES):
            head = self.store.head(self.key(channel, message))
            if head is None:
                return False
            try:
                self.store.put(self.key(channel, message), payload, "revision", head[0])
                return True
            except RevisionConflict:
                continue
        raise RevisionConflict(self.key(channel, message), "a quiet moment", None)

    def delete(self, channel: int, message: int) -> bool:
        return self.store.delete(self.key(channel, message))

    def _page(self, start: Bound, end: Bound, n: int) -> list[tuple[int, bytes]]:
        if n <= 0:
            return []
        rows = self.store.scan(start, end, reverse=True, limit=n)
        return [(r.id, bytes(r.value)) for r in rows.select(parse_message_key(F.col("key"))[1].alias("id"), "value").collect()]

    def latest(self, channel: int, n: int) -> list[tuple[int, bytes]]:
        return self._page(*prefix_bounds(channel.to_bytes(8, "big")), n)

    def before(self, channel: int, message: int, n: int) -> list[tuple[int, bytes]]:
        """The newest ``n`` messages older than ``message``."""
        return self._page(included(channel.to_bytes(8, "big")), excluded(self.key(channel, message)), n)
