"""Messages that keep arriving, at least once, into the keyed store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.store import KeyedStore


def upsert_stream(stream: DataFrame, store: KeyedStore, key: Column, order: Column, checkpoint: str, compact_every: int = 20, after: Callable[[int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Appends every micro-batch to the store as a sorted run; every ``compact_every`` batches the runs are merged.

    A batch that is delivered again after a failure, whole or in part, changes nothing that ``store.read()`` returns: copies lose to the
    row already there by precedence. No state grows with the stream; all that is kept is in the store's files. ``once`` reads what
    is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch, key, order)
        if number % compact_every == compact_every - 1:
            store.compact()
        if after is not None:
            after(number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
