"""Stage queries of a pipeline as Structured Streaming: the same transformations run over a batch frame or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import TokenBucket


def with_event_time(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time with a time zone and a watermark, where the frame is a stream."""
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, late) if events.isStreaming else timed


def fixed_window_counts(events: DataFrame, seconds: int = 60, most: int = 5) -> DataFrame:
    """Requests of each user in fixed windows, and whether they pass the limit."""
    counted = with_event_time(events).groupBy(F.window("ts", f"{seconds} seconds"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "user_id", "n", (F.col("n") > most).alias("limited"))


def leased_once(messages: DataFrame, keys: list[str], lease: str = "10 minutes") -> DataFrame:
    """The first message of each key within the lease."""
    timed = with_event_time(messages, late=lease)
    return timed.dropDuplicatesWithinWatermark(keys) if messages.isStreaming else timed.dropDuplicates(keys)


def per_item(items: DataFrame) -> DataFrame:
    """Streaming mode: every item goes on by itself."""
    return items.where(F.col("event_type") == "view").select("event_id", F.lit("filter").alias("stage"))


def barrier(items: DataFrame) -> DataFrame:
    """Batch mode: a job goes on once none of its items is open."""
    return items.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("open"), F.count("*").alias("n"))


class FanIn(StatefulProcessor):
    """Says once that all stages of an item have come, whatever their order and repeats; a timer says that they haven't in time."""

    def __init__(self, stages: frozenset[str], patience_ms: int):
        self.stages, self.patience_ms = stages, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "stage string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = {x[0] for x in self.seen.get()} if self.seen.exists() else set()
        if not seen:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        for frame in rows:
            for stage in frame["stage"]:
                if stage in self.stages and stage not in seen:
                    seen.add(stage)
                    self.seen.appendValue((stage,))
        if seen == self.stages and not self.done.exists():
            self.done.update((True,))
            yield pd.DataFrame({"item": [key[0]], "outcome": ["complete"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.done.exists():
            self.done.update((True,))
            yield pd.DataFrame({"item": [key[0]], "outcome": ["timed_out"]})

    def close(self) -> None:
        pass


def fan_in(arrivals: DataFrame, stages: set[str], patience_ms: int = 300_000) -> DataFrame:
    """item, outcome from a stream of (item, stage)."""
    return arrivals.groupBy("item").transformWithStateInPandas(FanIn(frozenset(stages), patience_ms), "item long, outcome string", "append", "processingTime")


def admitted(requests: DataFrame, per_minute: float, capacity: float) -> DataFrame:
    """Token buckets over a stream of (owner, request, at_ms)."""
    return requests.groupBy("owner").transformWithStateInPandas(TokenBucket(per_minute, capacity), "owner long, request long, granted boolean, retry_ms long", "append", "none")
