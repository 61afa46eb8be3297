"""Timers and limits as keyed state: stages that time out by the clock of their events, and requests that a window, leases and a cooldown let in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stages import with_event_time


class StageTimeouts(StatefulProcessor):
    """A stage of an item has timed out if no end of it came within its time after its first start. Earliest times count, so neither repeats nor the order of rows matter."""

    def __init__(self, limits_ms: dict[str, int]):
        self.limits = limits_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "started_ms long, ended_ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        late: list[tuple] = []
        for frame in rows:
            for stage, ended, at in zip(frame["stage"], frame["ended"], frame["at_ms"].tolist(), strict=True):
                if stage not in self.limits:
                    continue
                start, end, told = self.stages.getValue((stage,)) if self.stages.containsKey((stage,)) else (None, None, False)
                if ended:
                    end = at if end is None else min(end, at)
                elif start is None or at < start:
                    start = at
                    self.handle.registerTimer(start + self.limits[stage])
                self.stages.updateValue((stage,), (start, end, told))
        yield pd.DataFrame(late, columns=["item", "stage", "started_ms", "deadline_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = []
        for (stage,), (start, end, told) in list(self.stages.iterator()):
            if start is None or told or start + self.limits[stage] > expiredTimerInfo.getExpiryTimeInMs():
                continue
            deadline = start + self.limits[stage]
            if end is None or end > deadline:
                rows.append((key[0], stage, start, deadline))
            self.stages.updateValue((stage,), (start, end, True))
        yield pd.DataFrame(rows, columns=["item", "stage", "started_ms", "deadline_ms"])

    def close(self) -> None:
        pass


TIMED_OUT = "item long, stage string, started_ms long, deadline_ms long"


def stage_timeouts(events: DataFrame, limits_ms: dict[str, int], late: str = "10 minutes") -> DataFrame:
    """item, stage, started_ms, deadline_ms of stages that timed out. events: item, stage, ended (whether it is an end or a start), ts.

    As a stream: told once the watermark is past the deadline, whether or not rows of the item come any more. As a
    batch: all that the table says. Rows of other stages, and those without item, are left out.
    """
    timed = with_event_time(events.where(F.col("item").isNotNull() & F.col("ts").isNotNull()), "ts", late)
    rows = timed.select("item", "stage", F.coalesce("ended", F.lit(False)).alias("ended"), F.unix_millis("ts").alias("at_ms"), "ts")
    if events.isStreaming:
        return rows.groupBy("item").transformWithStateInPandas(StageTimeouts(limits_ms), TIMED_OUT, "append", "eventTime")
    limit = F.create_map(*(F.lit(x) for kv in limits_ms.items() for x in kv))[F.col("stage")]
    ends = rows.where(F.col("stage").isin(*limits_ms)).groupBy("item", "stage").agg(F.min(F.when(~F.col("ended"), F.col("at_ms"))).alias("started_ms"), F.min(F.when(F.col("ended"), F.col("at_ms"))).alias("ended_ms"))
    deadline = (F.col("started_ms") + limit).cast("long")
    return ends.where(F.col("ended_ms").isNull() | (F.col("ended_ms") > deadline)).where("started_ms IS NOT NULL").select("item", "stage", "started_ms", deadline.alias("deadline_ms"))


class RequestLimit(StatefulProcessor):
    """Requests let in by a sliding window and running leases, unless a cooldown is on; a request that comes again within its lease is one."""

    def __init__(self, window_ms: int, rate: int, held: int, lease_ms: int):
        self.window, self.rate, self.held, self.lease = window_ms, rate, held, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cooldown = handle.getValueState("cooldown", "until_ms long")
        # A request's entry is of no use once it is out of the window and its lease is over.
        self.granted = handle.getMapState("granted", "request long", "at_ms long, until_ms long", ttlDurationMs=max(2 * (self.window + self.lease), 60_000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["at_ms", "request"], kind="stable")
        until = self.cooldown.get()[0] if self.cooldown.exists() else None
        known = {r[0]: tuple(v) for r, v in self.granted.iterator()}
        out, after = limited(list(zip(frame["at_ms"].tolist(), frame["kind"].tolist(), frame["request"].tolist(), strict=True)), dict(known), until, self.window, self.rate, self.held, self.lease)
        for request in known.keys() - after[0].keys():
            self.granted.removeKey((request,))
        for request, value in after[0].items():
            if known.get(request) != value:
                self.granted.updateValue((request,), value)
        if after[1] is not None and after[1] != until:
            self.cooldown.update((after[1],))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["owner", "request", "at_ms", "granted", "wait_ms"])

    def close(self) -> None:
        pass


def limited(rows: list[tuple[int, str, int]], granted: dict[int, tuple[int, int]], until: int | None, window: int, rate: int, held: int, lease: int) -> tuple[list[tuple], tuple[dict[int, tuple[int, int]], int | None]]:
    """(request, at_ms, granted, wait_ms) of the asks among rows (at_ms, kind, request), and the state after them.

    Kinds: ask; release, which ends a request's lease; cooldown, which lets nothing in for as many milliseconds as its request says.
    """
    out = []
    for now, kind, request in rows:
        granted = {r: (at, end) for r, (at, end) in granted.items() if at > now - window or end > now}
        if kind == "release":
            if request in granted:
                granted[request] = (granted[request][0], now)
        elif kind == "cooldown":
            until = max(until or 0, now + request)
        elif kind == "ask":
            recent, running = sorted(at for at, _ in granted.values() if at > now - window), sorted(end for _, end in granted.values() if end > now)
            if request in granted and granted[request][1] > now:
                out.append((request, now, True, 0))
            elif until is not None and until > now:
                out.append((request, now, False, until - now))
            elif len(recent) < rate and len(running) < held:
                granted[request] = (now, now + lease)
                out.append((request, now, True, 0))
            else:
                out.append((request, now, False, max(250, *([recent[0] + window - now] if len(recent) >= rate else []), *([running[0] - now] if len(running) >= held else []))))
    return out, (granted, until)


LIMITED = "owner long, request long, at_ms long, granted boolean, wait_ms long"


def request_limits(requests: DataFrame, window_ms: int = 60_000, rate: int = 24, held: int = 5, lease_ms: int = 20_000) -> DataFrame:
    """owner, request, at_ms, granted, wait_ms of the asks among requests (owner, request, kind, at_ms), in the order of their times.

    As a stream, rows of an owner must come in that order from batch to batch, as a queue gives them; within a batch they may be mixed. As a batch, an
    owner's requests are one group.
    """
    rows = requests.where(F.col("owner").isNotNull() & F.col("request").isNotNull() & F.col("at_ms").isNotNull()).select("owner", "request", "kind", "at_ms")
    if requests.isStreaming:
        return rows.groupBy("owner").transformWithStateInPandas(RequestLimit(window_ms, rate, held, lease_ms), LIMITED, "append", "processingTime")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_ms", "request"], kind="stable")
        out, _ = limited(list(zip(frame["at_ms"].tolist(), frame["kind"].tolist(), frame["request"].tolist(), strict=True)), {}, None, window_ms, rate, held, lease_ms)
        return pd.DataFrame([(frame["owner"].iloc[0], *r) for r in out], columns=["owner", "request", "at_ms", "granted", "wait_ms"])

    return rows.groupBy("owner").applyInPandas(work, LIMITED)
