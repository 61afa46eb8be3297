"""Queries of sources and sinks: tables written in another form to the shared folder and read back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import shared_folder
from ..sources import archives, files, paged
from ..streaming import callbacks, timers
from .registry import ITEMS, items, query, table


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the one that all executors share."""
    return f"{shared_folder(spark)}/prismatic-{uuid.uuid4().hex}"


@query(
    "s17_archived_items",
    f"""WITH {ITEMS} SELECT job_id::VARCHAR AS archive, printf('%03d', row_number() OVER (PARTITION BY job_id ORDER BY score DESC, image_id)) || '_' || event_type || '.jpg' AS name, strlen(coalesce(props, '')) AS size
    FROM items WHERE status = 'selected'""",
)
def archived_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected items of each job in an archive of its own, and what the archives hold."""
    folder = scratch(spark)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("score"), "image_id"))
    chosen = items(spark, sf_dir).where("status = 'selected'").select(F.col("job_id").cast("string").alias("archive"), place.alias("n"), "image_id", F.concat("event_type", F.lit(".png")).alias("key"), "props")
    archives.write_archives(chosen.select("archive", text.archive_name(F.col("n"), F.col("key"), F.col("image_id").cast("string")).alias("name"), F.col("props").cast("binary").alias("content")), folder)
    return archives.members(spark, folder).select("archive", "name", "size")


PAGE = 50


@query("s13_paged_items", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_custkey AS id, c_name AS name FROM customer")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table served in pages and read back by ranges of them."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    total, first = rows.agg(F.count("*"), F.coalesce(F.min("id"), F.lit(0))).first()
    # Keys have no gaps, so places in their order need no window over all rows; with a gap, a page would be too short, which the reader tells.
    placed = rows.withColumn("position", F.col("id") - first)
    page = placed.groupBy((F.col("position") - F.col("position") % PAGE).alias("offset")).agg(F.array_sort(F.collect_list(F.struct("position", "id", "name"))).alias("items"))
    body = F.to_json(F.struct(F.lit(total).alias("total"), F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("items")))
    page.select("offset", body.alias("value")).repartition("offset").write.partitionBy("offset").text(folder)
    found = paged.paged(spark, f"{folder}/offset={{offset}}", limit=PAGE)
    return found.select("position", F.from_json("item", "id long, name string").alias("x")).select("position", "x.*")


LIMITS = {"view": 3 * 3_600_000, "click": 12 * 3_600_000, "cart": 24 * 3_600_000}
_LIMITS = ", ".join(f"('{k}', {v}::BIGINT)" for k, v in LIMITS.items())


@query(
    "z6_stage_timeouts",
    f"""WITH ends AS (SELECT user_id AS item, event_type AS stage, min(epoch_us(ts)) FILTER (WHERE event_id % 2 = 0) // 1000 AS started_ms, min(epoch_us(ts)) FILTER (WHERE event_id % 2 = 1) // 1000 AS ended_ms FROM events GROUP BY 1, 2)
    SELECT item, stage, started_ms, started_ms + ms AS deadline_ms FROM ends JOIN (VALUES {_LIMITS}) l(stage, ms) USING (stage) WHERE started_ms IS NOT NULL AND (ended_ms IS NULL OR ended_ms > started_ms + ms)""",
)
def stage_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages whose end didn't come within their time after the start; the same function runs over a stream, with timers."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("stage"), (F.col("event_id") % 2 == 1).alias("ended"), "ts")
    return timers.stage_timeouts(rows, LIMITS)


@query("z7_request_limits")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that window, leases and cooldowns let in; every eleventh event gives a lease back, every hundredth sets a cooldown."""
    n = F.col("event_id")
    kind = F.when(n % 100 == 0, "cooldown").when(n % 11 == 0, "release").otherwise("ask")
    request = F.when(n % 100 == 0, 30_000).when(n % 11 == 0, n - 3).otherwise(n)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), request.alias("request"), kind.alias("kind"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))
    return timers.request_limits(rows, rate=6, held=3)


def answer(url: str, body: bytes, headers: dict[str, str]) -> int:
    """A stand-in for a receiver: addresses end with the clock from which on it takes what comes."""
    return 204 if int(headers["X-Timestamp"]) >= int(url.rsplit("/", 1)[-1]) else 503


@query(
    "s16_delivery_attempts",
    """WITH e AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey % 3 AS batch, CASE o_orderkey % 7 WHEN 0 THEN 9000 WHEN 1 THEN (o_orderkey % 3 + 2) * 1000 ELSE 0 END AS ready FROM orders),
    tries AS (SELECT id, b AS batch, row_number() OVER (PARTITION BY id ORDER BY b) AS attempt, (b + 1) * 1000 >= ready AS good FROM e, range(5) t(b) WHERE b >= batch),
    kept AS (SELECT *, coalesce(bool_or(good) OVER (PARTITION BY id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM tries)
    SELECT batch, id, attempt, CASE WHEN good THEN 'delivered' WHEN attempt < 3 THEN 'retry' ELSE 'failed' END AS outcome FROM kept WHERE NOT done AND attempt <= 3""",
)
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of five batches of a stream, those that fail tried again with later ones, three times at most: all attempts that were made."""
    folder, key = scratch(spark), F.col("o_orderkey")
    ready = F.when(key % 7 == 0, 9000).when(key % 7 == 1, (key % 3 + 2) * 1000).otherwise(0)
    orders = table(spark, sf_dir, "orders")
    for batch in range(5):
        mine = orders.where(key % 3 == batch).select(key.cast("string").alias("id"), F.concat(F.lit("receiver/"), ready.cast("string")).alias("url"), F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("body"))
        callbacks.Deliveries(folder, b"catalog callbacks", send=answer, now=lambda at=batch: 1000 * (at + 1))(mine, batch)
    return callbacks.attempts(spark, folder).select(F.col("batch").cast("long").alias("batch"), "id", F.col("attempt").cast("long").alias("attempt"), "outcome")


@query("s9_label_pairs", "SELECT id::VARCHAR AS query_id, form, round(score, 4) AS final_score FROM (SELECT l_orderkey AS id, l_quantity / 50 AS score FROM lineitem WHERE l_linenumber = 1), (VALUES ('csv'), ('json')) f(form)")
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs as CSV and as arrays in JSON files, read back."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("query_id"), *(F.lit(None).cast("string").alias(c) for c in ("expected_asset_id", "candidate_asset_id")), *(F.lit(None).cast("double").alias(c) for c in ("similarity_score", "feature_score")), (F.col("l_quantity") / 50).alias("final_score"))
    rows.write.option("header", True).csv(f"{folder}/csv")
    parts = max(1, rows.count() // 5000)  # a file's array is a row
    lists = rows.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(f"{folder}/json")
    both = files.pairs_csv(spark, f"{folder}/csv").withColumn("form", F.lit("csv")).unionByName(files.pairs_json(spark, f"{folder}/json").drop("part").withColumn("form", F.lit("json")))
    return both.select("query_id", "form", F.round("final_score", 4).alias("final_score"))


@query("s10_asset_lines", "SELECT vec_id::VARCHAR AS id, label::VARCHAR AS group_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def asset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets as lines of JSON, the vector of every second one as a text of its own, read back."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    vector = F.when(F.col("vec_id") % 2 == 0, F.to_json("v")).otherwise(quoted(F.to_json("v")))
    fields = {"id": quoted(F.col("vec_id").cast("string")), "group_id": quoted(F.col("label").cast("string")), "embedding": vector}
    as_text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items())), F.lit("}"))
    rows.select(as_text.alias("value")).write.text(folder)
    found = files.assets_jsonl(spark, folder)
    return found.select("id", "group_id", F.size("embedding").cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("s15_metric_rows", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with labels, appended in two parts and read back."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.lit("event").alias("name"), "value", F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), "event_id")
    for part in (0, 1):
        files.append_metrics(rows.where(F.col("event_id") % 2 == part), folder)
    back = spark.read.parquet(folder)
    return back.groupBy(F.col("labels")["type"].alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s19_manifest", f"WITH {ITEMS} SELECT job_id % 40 AS job_id, count(*) AS items, min(image_id) AS first FROM items GROUP BY 1")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs' items in folders by job, read back a job at a time or all."""
    folder = scratch(spark)
    files.append_manifest(items(spark, sf_dir).select((F.col("job_id") % 40).alias("job_id"), "image_id", "status"), folder)
    return spark.read.schema("image_id long, status string, job_id long").parquet(folder).groupBy("job_id").agg(F.count("*").alias("items"), F.min("image_id").alias("first"))
