"""The latest stage of each document, forgotten once nothing has happened to the document for a while."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "document_id long, stage string, ts timestamp, ms long, event_id long"


class Stages(StatefulProcessor):
    """State of one document: its newest event, until the watermark is `idle` milliseconds past it."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = max(rows, key=lambda r: (r.ms, r.event_id))
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and (held[0], held[1]) >= (best.ms, best.event_id):
            return
        self.newest.update((best.ms, best.event_id))
        self.handle.registerTimer(max(best.ms + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(document_id=key[0], stage=best.stage, ts=best.ts, ms=best.ms, event_id=best.event_id)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.newest.exists() and self.newest.get()[0] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_stages(events: DataFrame, delay: str = "2 hours", idle_days: float = 30) -> DataFrame:
    """A row whenever a document reaches a newer stage, from events (document_id, stage, ts, event_id).

    Events later than `delay` are dropped. A document's state goes when the watermark is `idle_days` past its newest
    event; what comes for it later is newer than that by the watermark, and is its stage again. Needs `keyed_state`.
    """
    e = events.select(F.col("document_id").cast("long").alias("document_id"), "stage", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    e = e.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return e.groupBy("document_id").transformWithState(Stages(int(idle_days * 86_400_000)), RESULT, "Append", "EventTime")
