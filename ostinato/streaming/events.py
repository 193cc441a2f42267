"""Streams of events: windows, latest values, fan-out, work queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import steps


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts and sums per type and window of event time; events later than `late` are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events that follow each other within the gap."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Of queued updates of one item only the last."""
    values = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("u")).select(key, "u.*")


class Bus:
    """Handlers by event type for the batches of a stream. One that fails doesn't keep the others from theirs."""

    def __init__(self):
        self.handlers: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.failed: list[tuple[str, str]] = []

    def subscribe(self, event: str, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.setdefault(event, []).append(handler)

    def unsubscribe(self, event: str, handler: Callable[[DataFrame], None]) -> None:
        if handler in self.handlers.get(event, ()):
            self.handlers[event].remove(handler)

    def emit(self, batch: DataFrame, _: int = 0) -> None:
        batch = batch.persist()
        for event, handlers in self.handlers.items():
            for h in list(handlers):
                try:
                    h(batch.filter(F.col("event_type") == event))
                except Exception as e:  # a handler's failure is its own
                    self.failed.append((event, repr(e)))
        batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.emit).option("checkpointLocation", checkpoint).start()


def queue(items: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Items (item, at) in order of work: those of priority (item, at) first, the last asked for foremost; each once."""
    rows = items.select("item", F.lit(1).alias("rank"), F.col("at").alias("at"))
    if priority is not None:
        rows = priority.select("item", F.lit(0).alias("rank"), (-F.col("at")).alias("at")).unionByName(rows)
    once = rows.groupBy("item").agg(F.min(F.struct("rank", "at")).alias("k"))
    return steps.numbered(once.select("item", "k.rank", "k.at"), ["rank", "at", "item"], "place").select("item", "place")


def needing_work(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")
