"""Streams against the same rows as a batch, cut off and started again."""

import json
import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from prismatic.streaming import timers
from prismatic.streaming.callbacks import Deliveries, attempts, signed

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def written(folder, rows):
    """A file of JSON lines per list of rows, older ones first."""
    folder.mkdir()
    for k, part in enumerate(rows):
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in part))
        time.sleep(0.02)


class Receiver:
    """Writes down what comes, and answers as the address says: fail-N fails N times."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, url, body, headers):
        import os
        import uuid

        with open(f"{self.folder}/{headers['X-Event-Id']}.{uuid.uuid4().hex}", "w") as out:
            json.dump({"body": body.decode(), **headers}, out)
        seen = sum(name.startswith(headers["X-Event-Id"] + ".") for name in os.listdir(self.folder))
        if url.startswith("raise"):
            raise OSError("no way there")
        return 500 if seen <= int(url.rsplit("-", 1)[-1]) else 204


def test_deliveries_survive_being_cut_off(spark, tmp_path):
    (tmp_path / "got").mkdir()
    events = [[{"id": "a", "url": "fail-0", "body": "{}"}, {"id": "a", "url": "fail-0", "body": "{}"}, {"id": "b", "url": "fail-1", "body": "é"}], [{"id": "c", "url": "fail-9", "body": ""}, {"id": None, "url": "x", "body": ""}], [{"id": "d", "url": "raise-0", "body": None}], [], [{"id": "e", "url": "fail-0", "body": "x"}]]
    written(tmp_path / "events", events)
    clock = {"now": 1000}

    class Cut(Deliveries):
        def keep(self, rows, kind, batch, schema):
            found = super().keep(rows, kind, batch, schema)
            if kind == "log" and batch == 1 and clock.get("cut", True):
                clock["cut"] = False
                raise RuntimeError("cut off")
            return found

    def now():
        clock["now"] += 100
        return clock["now"]

    deliver = Cut(str(tmp_path / "state"), b"secret", send=Receiver(tmp_path / "got"), now=now)

    def run():
        stream = spark.readStream.schema("id string, url string, body string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "events"))
        query = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="cut off"):
        run()
    run()
    found = attempts(spark, str(tmp_path / "state")).collect()
    by_id = {i: sorted((r["attempt"], r["outcome"]) for r in found if r["id"] == i) for i in "abcde"}
    assert by_id["a"] == [(1, "delivered")] and by_id["b"] == [(1, "retry"), (2, "delivered")] and by_id["e"] == [(1, "delivered")]
    assert by_id["c"] == [(1, "retry"), (2, "retry"), (3, "failed")] and by_id["d"] == [(1, "retry"), (2, "retry"), (3, "failed")][: len(by_id["d"])]
    assert all("no way" in r["error"] for r in found if r["id"] == "d")
    # Each attempt reached the receiver once, though a batch was replayed.
    files = [json.loads(f.read_text()) for f in (tmp_path / "got").iterdir()]
    assert Counter(f["X-Event-Id"] for f in files) == Counter(r["id"] for r in found)
    assert all(f["X-Signature"] == signed(b"secret", int(f["X-Timestamp"]), f["body"].encode()) for f in files)


def test_waits_double(spark, tmp_path):
    deliver = Deliveries(str(tmp_path / "s"), b"", base_seconds=30, send=lambda url, body, headers: 503, now=lambda: 0)
    frame = spark.createDataFrame([("x", "u", "b", n, 0) for n in range(2)] + [("y", "u", "b", 2, 0)], "id string, url string, body string, attempts int, due long")
    assert sorted((r["id"], r["attempt"], r["outcome"], r["due"]) for r in deliver.attempted(frame, 1000).collect()) == [("x", 1, "retry", 1030), ("x", 2, "retry", 1060), ("y", 3, "failed", None)]


LIMITS = {"filter": 60_000, "match": 180_000}


def test_timeouts_of_a_stream_are_those_of_the_table(rocks, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for item in range(30):
        for stage in ("filter", "match", "other"):
            begun = rng.randrange(0, 3000)
            rows.append((begun, item, stage, False))
            if rng.random() < 0.8:
                rows.append((begun + rng.choice([10, 59, 60, 61, 170, 180, 181, 400]), item, stage, True))
    rows += rng.sample(rows, 20)  # repeats
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 240))  # up to four minutes late
    as_json = [{"item": i, "stage": s, "ended": e, "ts": (start + timedelta(seconds=t)).isoformat()} for t, i, s, e in arrival]
    end = [{"item": None, "stage": "filter", "ended": False, "ts": (start + timedelta(hours=9)).isoformat()}, {"item": 999, "stage": "other", "ended": False, "ts": (start + timedelta(hours=9)).isoformat()}]
    written(tmp_path / "in", [as_json[k : k + 25] for k in range(0, len(as_json), 25)] + [end, end])
    kind = "item long, stage string, ended boolean, ts timestamp"
    stream = rocks.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timers.stage_timeouts(stream, LIMITS, late="5 minutes")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).collect()))
    expected = sorted(map(tuple, timers.stage_timeouts(rocks.read.schema(kind).json(str(tmp_path / "in")), LIMITS).collect()))
    assert got == expected and len(got) > 10
    first = {(i, s): min(t for t, a, b, e in rows if (a, b, e) == (i, s, False)) for _, i, s, _ in rows}
    last = {(i, s): min((t for t, a, b, e in rows if (a, b, e) == (i, s, True)), default=None) for i, s in first}
    by_hand = {(i, s) for (i, s), t in first.items() if s in LIMITS and (last[i, s] is None or last[i, s] - t > LIMITS[s] // 1000)}
    assert {(r[0], r[1]) for r in got} == by_hand


def test_limits_of_a_stream_are_those_of_the_table(rocks, tmp_path):
    rng = random.Random(9)
    rows, now = [], 0
    for k in range(300):
        now += rng.choice([0, 200, 900, 4000])
        kind = rng.choices(["ask", "release", "cooldown"], [20, 5, 1])[0]
        rows.append({"owner": k % 3, "request": rng.randrange(max(0, k - 5), k + 1) if kind != "cooldown" else 7000, "kind": kind, "at_ms": now})
    kind = "owner long, request long, kind string, at_ms long"
    written(tmp_path / "in", [rng.sample(rows[k : k + 40], len(rows[k : k + 40])) for k in range(0, 300, 40)])
    stream = rocks.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = timers.request_limits(stream, window_ms=10_000, rate=6, held=3, lease_ms=5_000)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    batch = timers.request_limits(rocks.read.schema(kind).json(str(tmp_path / "in")), window_ms=10_000, rate=6, held=3, lease_ms=5_000)
    expected = sorted(map(tuple, batch.collect()))
    got, until = [], time.time() + 100
    while len(got) < len(expected) and time.time() < until:  # by the clock of the machine a stream never ends by itself
        time.sleep(1)
        if query.exception():
            raise query.exception()
        if (tmp_path / "out" / "_spark_metadata").exists():
            got = sorted(map(tuple, rocks.read.schema(timers.LIMITED).parquet(str(tmp_path / "out")).collect()))
    query.stop()
    assert got == expected and {r[3] for r in got} == {True, False}


def test_limits_by_hand():
    rows = [(0, "ask", 1), (10, "ask", 2), (20, "ask", 3), (30, "release", 1), (40, "ask", 3), (50, "ask", 3), (60, "cooldown", 500), (70, "ask", 4), (600, "ask", 5), (1000, "ask", 6), (1011, "ask", 6)]
    out, (granted, until) = timers.limited(rows, {}, None, window=1000, rate=4, held=2, lease=800)
    assert out == [(1, 0, True, 0), (2, 10, True, 0), (3, 20, False, 780), (3, 40, True, 0), (3, 50, True, 0), (4, 70, False, 490), (5, 600, False, 250), (6, 1000, True, 0), (6, 1011, True, 0)]
    assert until == 560 and set(granted) == {3, 6}
