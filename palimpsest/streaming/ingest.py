"""Structured Streaming: group commits of micro-batches, and the newest page of each channel as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.store import Store


def commit_stream(ops: DataFrame, store: Store, checkpoint: str, name: str = "ingest", interval: str | None = None) -> StreamingQuery:
    """One atomic commit per micro-batch of (ord, key, op, value); a batch that is replayed after a failure is recognised by its tag.

    ``interval`` (such as "200 milliseconds") buffers arrivals that long; None takes what is there and ends.
    """

    def commit(batch: DataFrame, number: int) -> None:
        full = {"expect": F.lit("any"), "expect_revision": F.lit(None).cast("long")}
        rows = batch.select("ord", "op", "key", "value", *[F.col(c) if c in batch.columns else d.alias(c) for c, d in full.items()])
        if (done := store.write(rows, atomic=False, tag=f"{name}:{number}")) is not None:
            done.unpersist()

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def recent_pages(messages: DataFrame, n: int) -> DataFrame:
    """(channel, id, payload, rank) after each micro-batch for the channels that it touched: the newest ``n`` as state.

    Only ``n`` messages per channel are kept, whatever the channel's length; an id that comes again replaces
    its payload, and a null payload deletes the message from the page.
    """

    def page(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, bytes] = dict(zip(*state.get)) if state.exists else {}
        for batch in batches:
            for id_, payload in zip(batch["id"], batch["payload"]):
                if payload is None:
                    held.pop(id_, None)
                else:
                    held[id_] = bytes(payload)
            held = dict(sorted(held.items(), reverse=True)[:n])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"channel": key[0], "id": list(held), "payload": list(held.values()), "rank": range(1, len(held) + 1)})

    return messages.groupBy("channel").applyInPandasWithState(
        page, "channel long, id long, payload binary, rank long", "ids array<long>, payloads array<binary>", "update", GroupStateTimeout.NoTimeout
    )
