"""Operators whose each step depends on the outputs before: small numpy or plain loops per group, grouped and shuffled by Spark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def box_overlaps(a: np.ndarray, b: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Intersection over union of each box (x0, y0, x1, y1) of a with each of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.prod(np.maximum(high - low, 0), axis=2)
    area = lambda x: np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1)
    return both / np.maximum(least, area(a)[:, None] + area(b)[None, :] - both)


BOX = ["x0", "y0", "x1", "y1"]


def by_groups(frame: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """The rows that work gives for each group's columns, its rows in an order. Groups follow each other in sorted partitions, so a small one costs no frame, call or Arrow batch of its own; one group is held at a time."""
    names = [f.split()[0] for f in schema.split(", ")]
    columns = frame.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        whole = lambda: held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns}
        for part in frames:
            out: list[tuple] = []
            values = {c: part[c].to_numpy() for c in columns}
            starts = np.flatnonzero(part["_at"].to_numpy() == 1).tolist()
            for a, b in zip([0, *starts], [*starts, len(part)], strict=True):
                if a in starts[:1] or a > 0:  # a group begins
                    out += work(whole()) if held else []
                    held = []
                if b > a:
                    held.append({c: v[a:b] for c, v in values.items()})
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(whole()), columns=names)

    return frame.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).mapInPandas(run, schema)


def _sides(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, those of the first with side 0."""
    return first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True)


def _boxes(group: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([group[c].astype(float) for c in BOX], axis=1)


def detection_outcomes(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, class, outcome (tp, fp, fn), n. In each image and class the surest prediction takes the box that it overlaps most, if by the threshold, and so on.

    predictions: image_id, class, confidence and a box; truth: image_id, class and a box. One picture's boxes are one group.
    """

    def work(group: dict[str, np.ndarray]) -> list[tuple]:
        boxes, n = _boxes(group), int((group["side"] == 0).sum())
        t = len(boxes) - n
        free, hits = np.ones(t, bool), 0
        for row in box_overlaps(boxes[:n], boxes[n:]) if n and t else ():
            best = int(np.where(free, row, -1.0).argmax())
            if free[best] and row[best] >= threshold:
                free[best] = False
                hits += 1
        return [(group["image_id"][0], group["class"][0], outcome, k) for outcome, k in (("tp", hits), ("fp", n - hits), ("fn", t - hits))]

    both = _sides(predictions.select("image_id", "class", "confidence", *BOX), truth.select("image_id", "class", *BOX))
    return by_groups(both, ["image_id", "class"], ["side", F.desc_nulls_last("confidence"), *BOX], work, "image_id long, class string, outcome string, n long")


def best_first_matches(expected: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, expected_id, predicted_id, overlap: pairs taken by descending overlap, each box once; ties go to larger ids."""

    def work(group: dict[str, np.ndarray]) -> list[tuple]:
        boxes, ids, n = _boxes(group), group["id"], int((group["side"] == 0).sum())
        if not 0 < n < len(boxes):
            return []
        found = box_overlaps(boxes[:n], boxes[n:])
        rows, used_e, used_p = [], set(), set()
        for overlap, i, j in sorted(((found[i, j], ids[i], ids[n + j]) for i, j in zip(*np.nonzero(found >= threshold), strict=True)), reverse=True):
            if i not in used_e and j not in used_p:
                used_e.add(i)
                used_p.add(j)
                rows.append((group["image_id"][0], i, j, overlap))
        return rows

    both = _sides(expected.select("image_id", "id", *BOX), predicted.select("image_id", "id", *BOX))
    return by_groups(both, ["image_id"], ["side", "id"], work, "image_id long, expected_id long, predicted_id long, overlap double")


def suppressed(boxes: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Boxes of each picture and class that no surer kept box overlaps by more than the threshold."""
    names = boxes.columns

    def work(group: dict[str, np.ndarray]) -> list[tuple]:
        at = _boxes(group)
        kept: list[int] = []
        for k in range(len(at)):
            if not kept or box_overlaps(at[k : k + 1], at[kept]).max() <= threshold:
                kept.append(k)
        return [tuple(group[c][k] for c in names) for k in kept]

    schema = ", ".join(f"{c} {k}" for c, k in boxes.dtypes)
    return by_groups(boxes, ["image_id", "class"], [F.desc_nulls_last("confidence"), *BOX], work, schema)


class TokenBucket(StatefulProcessor):
    """Each request takes a token; tokens come back by the minute up to the capacity. Rows of a key in the order of their times."""

    def __init__(self, per_minute: float, capacity: float):
        self.per_minute, self.capacity = per_minute, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frame = pd.concat(list(rows)).sort_values(["at_ms", "request"], kind="stable")
        tokens, at = self.state.get() if self.state.exists() else (self.capacity, int(frame["at_ms"].iloc[0]))
        out, tokens, at = drained(frame["at_ms"].to_numpy(), self.per_minute, self.capacity, tokens, at)
        self.state.update((tokens, at))
        yield pd.DataFrame({"owner": key[0], "request": frame["request"].to_numpy(), "granted": out[0], "retry_ms": out[1]})

    def close(self) -> None:
        pass


def drained(times: np.ndarray, per_minute: float, capacity: float, tokens: float, at: int) -> tuple[tuple[list[bool], list[int]], float, int]:
    granted, retry = [], []
    for now in times.tolist():
        tokens = min(capacity, tokens + max(0, now - at) * per_minute / 60_000)
        at = now
        if tokens < 1:
            granted.append(False)
            retry.append(int(np.ceil((1 - tokens) * 60_000 / per_minute)))
        else:
            tokens -= 1
            granted.append(True)
            retry.append(0)
    return (granted, retry), tokens, at


def token_bucket(requests: DataFrame, per_minute: float = 3, capacity: float = 20) -> DataFrame:
    """owner, request, granted, retry_ms of requests (owner, request, at_ms), batch form; an owner's requests are one group."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_ms", "request"], kind="stable")
        out, _, _ = drained(frame["at_ms"].to_numpy(), per_minute, capacity, capacity, int(frame["at_ms"].iloc[0]))
        return pd.DataFrame({"owner": frame["owner"].to_numpy(), "request": frame["request"].to_numpy(), "granted": out[0], "retry_ms": out[1]})

    return requests.groupBy("owner").applyInPandas(work, "owner long, request long, granted boolean, retry_ms long")


def cascade(runs: DataFrame, detections: DataFrame, threshold: float = 0.45) -> DataFrame:
    """image_id, detector and n: each picture's first healthy detector and how many of its boxes are left after suppression.

    runs: image_id, place (the detectors' order), detector, healthy; detections: image_id, detector,
    confidence and a box. A healthy detector that finds nothing ends the search; where none is healthy,
    detector and n are null. Detections of a detector that didn't run count for nothing.
    """
    first = runs.groupBy("image_id").agg(F.min(F.when(F.col("healthy"), F.struct("place", "detector")))["detector"].alias("detector"))
    boxes = detections.join(first, ["image_id", "detector"]).select("image_id", F.col("detector").alias("class"), "confidence", *BOX)
    kept = suppressed(boxes, threshold).groupBy("image_id").agg(F.count("*").alias("n"))
    return first.join(kept, "image_id", "left").select("image_id", "detector", F.when(F.col("detector").isNotNull(), F.coalesce("n", F.lit(0))).alias("n"))


def admitted(times: list[int], window_ms: int, rate: int, held: int, lease_ms: int) -> tuple[list[bool], list[int]]:
    """Whether each request, at rising times, is let in, and how long it has to wait if not.

    At most `rate` are let in within a window and `held` leases run at once; a wait is 250 ms at least.
    """
    recent: deque[int] = deque()
    leases: deque[int] = deque()
    granted, waits = [], []
    for now in times:
        while recent and recent[0] <= now - window_ms:
            recent.popleft()
        while leases and leases[0] <= now:
            leases.popleft()
        full = (recent[0] + window_ms - now if len(recent) >= rate else None, leases[0] - now if len(leases) >= held else None)
        granted.append(full == (None, None))
        waits.append(0 if granted[-1] else max(250, *(w for w in full if w is not None)))
        if granted[-1]:
            recent.append(now)
            leases.append(now + lease_ms)
    return granted, waits


def rate_limited(requests: DataFrame, window_ms: int = 60_000, rate: int = 30, held: int = 4, lease_ms: int = 20_000) -> DataFrame:
    """owner, request, granted, wait_ms of requests (owner, request, at_ms) by a sliding window and running leases; an owner's requests are one group, in the order of their times."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_ms", "request"], kind="stable")
        granted, waits = admitted(frame["at_ms"].tolist(), window_ms, rate, held, lease_ms)
        return pd.DataFrame({"owner": frame["owner"].to_numpy(), "request": frame["request"].to_numpy(), "granted": granted, "wait_ms": waits})

    return requests.groupBy("owner").applyInPandas(work, "owner long, request long, granted boolean, wait_ms long")


#: Whose turn it is: stages by weight.
GRANTS = (1, 1, 1, 2, 3, 4)


def fair_order(waiting: DataFrame, age_ms: int = 15_000, every_ms: int = 1_000, most: int = 256) -> DataFrame:
    """lane, token, place: the order in which waiters of a lane (token, stage, job, at_ms) are let in, one each `every_ms`.

    Stages take turns by GRANTS, another job than the last one first; a waiter of over age_ms goes before
    all. Beyond `most` waiters, the queue's own limit, a newcomer is turned away (no place).
    """

    def arriving(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            yield from zip(*(frame[c].tolist() for c in ("lane", "token", "stage", "job", "at_ms")), strict=True)

    def placed(rows: Iterator[tuple]) -> Iterator[tuple[int, int, int]]:
        """The waiters of one lane, of which the queue alone is held."""
        queue: list[tuple] = []
        cursor, last_job, place = 0, None, 0
        after = next(rows, None)
        now = after[4] if after else 0
        while after or queue:
            while after and after[4] <= now:
                if len(queue) < most:
                    queue.append(after)
                after = next(rows, None)
            if not queue:
                now = after[4]
                continue
            chosen = queue[0] if now - queue[0][4] >= age_ms else None
            for step in range(len(GRANTS)) if chosen is None else ():
                at = (cursor + step) % len(GRANTS)
                of_stage = [w for w in queue if w[2] == GRANTS[at]]
                if of_stage:
                    chosen = next((w for w in of_stage if w[3] != last_job), of_stage[0])
                    cursor = (at + 1) % len(GRANTS)
                    break
            chosen = chosen or queue[0]
            queue.remove(chosen)
            last_job = chosen[3]
            place += 1
            yield chosen[0], chosen[1], place
            now += every_ms

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (row for _, lane in groupby(arriving(frames), itemgetter(0)) for row in placed(lane))
        while some := list(islice(found, 10_000)):
            yield pd.DataFrame(some, columns=["lane", "token", "place"])

    # sorted by lane and time, so a lane is a stream and never a frame
    return waiting.select("lane", "token", "stage", "job", "at_ms").repartition("lane").sortWithinPartitions("lane", "at_ms", "token").mapInPandas(work, "lane long, token long, place long")


def lockouts(attempts: DataFrame, most: int = 3, minutes: int = 15) -> DataFrame:
    """account, attempt, locked: whether an attempt (account, attempt, at_ms, good) meets a lock, which `most` failures in a row set for some minutes."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_ms", "attempt"], kind="stable")
        failures, until, locked = 0, -1, []
        for now, good in zip(frame["at_ms"].tolist(), frame["good"].tolist(), strict=True):
            locked.append(now < until)
            if locked[-1]:
                continue
            failures = 0 if good else failures + 1
            if failures >= most:
                failures, until = 0, now + minutes * 60_000
        return pd.DataFrame({"account": frame["account"].to_numpy(), "attempt": frame["attempt"].to_numpy(), "locked": locked})

    return attempts.groupBy("account").applyInPandas(work, "account long, attempt long, locked boolean")
