"""Signed deliveries from a stream, each event tried a few times: a function for foreachBatch that keeps its attempts by batch and id.

The folder has a table per batch and kind: `log`, the attempts made in a batch; `open`, what is still to be
delivered after it. A batch that is replayed with its log written sends nothing again; one that was cut off while it sent
does, as the log comes after what it tells of. Receivers see the same event id each time.
"""

from __future__ import annotations

import hashlib
import hmac
import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, url string, body string, attempts int, due long"
ATTEMPT = "id string, url string, body string, attempt int, outcome string, status int, error string, due long"


def signed(secret: bytes, at: int, body: bytes) -> str:
    return "sha256=" + hmac.new(secret, str(at).encode() + b"." + body, hashlib.sha256).hexdigest()


def posted(url: str, body: bytes, headers: dict[str, str], seconds: float = 10.0) -> int:
    """The answer's status; redirects and errors of transport are exceptions."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=seconds) as answer:  # noqa: S310
            return answer.status
    except HTTPError as wrong:
        return wrong.code


class Deliveries:
    """foreachBatch(Deliveries(folder, ...)) of a stream of id, url, body. folder: one that all executors share.

    An event is delivered when an answer's status is below 300. Else it is tried again with a later batch, after a wait
    that doubles with each attempt up to an hour, `most` times in all, then it has failed. Ids that repeat in a batch, or
    that are still open, are one event; rows without id or url are left out.
    """

    def __init__(self, folder: str, secret: bytes, most: int = 3, base_seconds: int = 30, send: Callable[[str, bytes, dict[str, str]], int] = posted, now: Callable[[], float] = time.time):
        self.folder, self.secret, self.most, self.base, self.send, self.now = folder.rstrip("/"), secret, most, base_seconds, send, now

    def path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def table(self, spark: SparkSession, kind: str, batch: int, schema: str) -> DataFrame | None:
        """The table of a batch, or None where it isn't whole: a mark is written after it."""
        try:
            spark.read.schema("id long").parquet(self.path(f"{kind}-whole", batch)).schema  # noqa: B018  a missing path is an error here
        except AnalysisException:
            return None
        return spark.read.schema(schema).parquet(self.path(kind, batch))

    def keep(self, rows: DataFrame, kind: str, batch: int, schema: str) -> DataFrame:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(self.path(kind, batch))
        spark.range(1).write.mode("overwrite").parquet(self.path(f"{kind}-whole", batch))
        return spark.read.schema(schema).parquet(self.path(kind, batch))

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        if self.table(spark, "open", batch, EVENT) is not None:
            return
        before = self.table(spark, "open", batch - 1, EVENT) if batch > 0 else None
        before = spark.createDataFrame([], EVENT) if before is None else before
        now = int(self.now())
        new = events.where(F.col("id").isNotNull() & F.col("url").isNotNull()).groupBy("id").agg(F.min(F.struct("url", "body")).alias("e"))
        new = new.select("id", "e.url", F.coalesce("e.body", F.lit("")).alias("body"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("due"))
        waiting = before.unionByName(new.join(before, "id", "left_anti"))
        log = self.table(spark, "log", batch, ATTEMPT)
        if log is None:
            log = self.keep(self.attempted(waiting.where(F.col("due") <= now), now), "log", batch, ATTEMPT)
        again = log.where("outcome = 'retry'").select("id", "url", "body", F.col("attempt").alias("attempts"), "due")
        self.keep(waiting.join(log, "id", "left_anti").unionByName(again), "open", batch, EVENT)

    def attempted(self, due: DataFrame, now: int) -> DataFrame:
        """A row per event with what came of sending it. Each task sends its own."""
        secret, most, base, send = self.secret, self.most, self.base, self.send

        def work(frames):
            for frame in frames:
                rows = []
                for e in frame.itertuples(index=False):
                    body, n, status, error = e.body.encode(), int(e.attempts) + 1, None, None
                    headers = {"Content-Type": "application/json", "X-Event-Id": e.id, "X-Timestamp": str(now), "X-Signature": signed(secret, now, body)}
                    try:
                        status = send(e.url, body, headers)
                    except Exception as wrong:  # noqa: BLE001  whatever it is, the event is tried again
                        error = str(wrong)[:1000]
                    good = status is not None and 200 <= status < 300
                    outcome = "delivered" if good else "retry" if n < most else "failed"
                    rows.append((e.id, e.url, e.body, n, outcome, status, error, now + min(base * 2 ** (n - 1), 3600) if outcome == "retry" else None))
                out = pd.DataFrame(rows, columns=["id", "url", "body", "attempt", "outcome", "status", "error", "due"])
                yield out.astype({"status": "Int32", "due": "Int64"})

        return due.mapInPandas(work, ATTEMPT)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts of all batches: batch, and the columns of ATTEMPT."""
    return spark.read.schema(f"{ATTEMPT}, batch int").parquet(f"{folder.rstrip('/')}/log")
