"""Runs a stream of changes into a store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .store import Store


def start(stream: DataFrame, store: Store, checkpoint: str, to_changes: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True) -> StreamingQuery:
    """Fold every micro-batch into the store. A replayed batch is skipped by its positions, so that state is folded
    exactly once; the source's offsets advance only after the manifest has."""

    def fold(batch: DataFrame, _: int) -> None:
        store.apply(to_changes(batch))

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def tap(stream: DataFrame, observe: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Observe micro-batches without storing anything."""
    return stream.writeStream.foreachBatch(lambda df, _: observe(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def supervise(begin: Callable[[], StreamingQuery], attempts: int | None = None, least: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Restart a query that fails, after a pause that doubles from `least` to `most` seconds."""
    pause, left = least, attempts
    while True:
        try:
            begin().awaitTermination()
            return
        except Exception:
            if left is not None:
                left -= 1
                if left <= 0:
                    raise
            sleep(pause)
            pause = min(most, pause * 2)


def wait_for_change(store: Store, after: int, seconds: float = 300.0, poll: float = 0.2) -> bool:
    """Whether the store's log goes beyond operation `after` within the time: for requests that are held open."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        m = store.manifest()
        if m and m.last_op_id > after:
            return True
        time.sleep(poll)
    return False
