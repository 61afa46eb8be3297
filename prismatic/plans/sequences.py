"""Queries of operators that SQL doesn't express, and of streams; tests hold them against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, pixels, retouching, sequential, shapes
from ..streaming import stages
from .aggregates import report
from .registry import assets, query, table
from .scalars import boxes


@query("v1_usable_vectors", "SELECT vec_id AS asset_id, label AS group_id, len(embedding) AS size FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0")
def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unit_vectors(assets(spark, sf_dir)).select("asset_id", "group_id", F.size("vector").cast("long").alias("size"))


@query("v4_prototypes")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.prototypes(assets(spark, sf_dir), 12)


@query("v18_leave_one_out")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset against the prototypes of each group, chosen without it and its equal copies."""
    asked = assets(spark, sf_dir).select(F.col("asset_id").alias("query_id"), F.col("group_id").alias("expected"))
    rows = matching.group_scores(matching.leave_one_out_scores(assets(spark, sf_dir), 12), support=0.25).withColumns({"final_score": F.col("similarity"), "feature_score": F.lit(None).cast("double")})
    return report(matching.decided(rows, auto=0.35).join(asked, "query_id").rollup("expected"))


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir).withColumns({"image_id": F.floor(F.col("id") / 4), "class": F.when(F.col("id") % 2 == 0, "logo").otherwise("product")})
    moved = [(F.col(c) + F.col("id") % 5).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return b.select("id", "image_id", "class", (F.col("id") % 97 / 97).alias("confidence"), *moved), b.where("id % 6 <> 0").select("id", "image_id", "class", "x0", "y0", "x1", "y1")


@query("j21_detection_matches")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.detection_outcomes(*predictions(spark, sf_dir))


@query("j22_best_first_matches")
def best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = predictions(spark, sf_dir)
    return sequential.best_first_matches(t, p)


@query("d14_detector_report")
def detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0))
    rows = detections(spark, sf_dir).groupBy("class").agg(of("tp").alias("tp"), of("fp").alias("fp"), of("fn").alias("fn"))
    ratio = lambda a, b: F.round(F.col("tp") / F.greatest(F.lit(1), F.col(a) + F.col(b)), 6)
    return rows.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


@query("i27_suppressed_boxes")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.suppressed(predictions(spark, sf_dir)[0], 0.45)


def pictures(docs: DataFrame, side: int = 16, rows: int = 1) -> DataFrame:
    """A gray picture from all bytes of each text, as wide as side, padded with zero bytes to whole multiples of rows; without height where there is no byte."""
    payload = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    unit = side * rows
    padding = F.substring(F.lit(bytes(unit)), F.lit(1), F.pmod(-F.octet_length("payload"), F.lit(unit)))
    filled = docs.select(F.col("doc_id").alias("image_id"), payload.alias("payload")).select("image_id", F.concat("payload", padding).alias("pixels"))
    return filled.select("image_id", F.lit(side).alias("width"), F.floor(F.octet_length("pixels") / side).cast("int").alias("height"), "pixels")


@query("i3_quality_measures")
def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a picture from each whole text; null where it has no byte."""
    return pixels.measured(pictures(table(spark, sf_dir, "documents")))


def mosaics(docs: DataFrame, side: int = 16) -> DataFrame:
    """Each whole text as frames of side by side, each with its box in blocks."""
    box = {"x0": F.lit(2), "y0": F.lit(3), "x1": F.lit(12), "y1": F.lit(11)}
    return pixels.pixelated(pictures(docs, side, side).withColumns({"height": F.lit(side), **box}))


@query("i19_mosaic")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaics(table(spark, sf_dir, "documents")).select("image_id", F.sha2("pixels", 256).alias("sha"), "outside", "inside")


def colour_pictures(docs: DataFrame, side: int = 16) -> DataFrame:
    """An RGB picture from all bytes of each text, as wide as side."""
    return pictures(docs, 3 * side).withColumn("width", F.lit(side))


@query("i7_retouched")
def retouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture from each whole text through all steps, straightened where its lines say so, with what it is accepted by before and after."""
    plan = retouching.Retouch(0.5, 0.3, 0.2, 0.5, 0.3, 2.0, 0.3, 1.04, 1.05, 1.03, 0.3, 1.2, longest=64)
    images = colour_pictures(table(spark, sf_dir, "documents"))
    out = retouching.retouch_all(images.join(shapes.skew_turns(images), "image_id", "left"), plan)
    return out.withColumn("pixels", F.sha2("pixels", 256)).withColumnRenamed("pixels", "sha")


@query("i6_upright")
def upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture as its orientation mark says."""
    marked = colour_pictures(table(spark, sf_dir, "documents")).withColumn("mark", (F.col("image_id") % 9).cast("int"))
    out = retouching.each_picture(marked, lambda image, row: retouching.upright(image, row.mark))
    return out.select("image_id", "width", "height", F.sha2("pixels", 256).alias("sha"))


@query("i20_mark_taken_off")
def unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture with a white mark laid on it and taken off again by the opacity that the pair tells."""

    def step(image, row):
        alpha = np.linspace(0.1, 0.6, image.shape[1])[None, :, None]
        marked = np.rint(image + alpha * (255.0 - image)).astype(np.uint8)
        return pixels.unblended(marked, np.full(3, 255.0), retouching.alpha_of(image, marked))

    out = retouching.each_picture(colour_pictures(table(spark, sf_dir, "documents")), step)
    return out.select("image_id", "height", F.sha2("pixels", 256).alias("sha"))


@query("i28_detector_cascade")
def cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predictions(spark, sf_dir)[0].withColumn("detector", F.when(F.col("id") % 3 == 0, "text").otherwise("boxes")).drop("class")
    healthy = F.when(F.col("place") == 0, F.col("image_id") % 3 != 0).otherwise(F.col("image_id") % 2 == 0)
    runs = found.select("image_id").distinct().select("image_id", F.explode(F.create_map(F.lit(0), F.lit("boxes"), F.lit(1), F.lit("text"))).alias("place", "detector")).withColumn("healthy", healthy)
    return sequential.cascade(runs, found)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("request"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type", "value")


@query("z3_barrier", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS open, count(*) AS n FROM events GROUP BY user_id")
def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.barrier(table(spark, sf_dir, "events"))


@query("z3_per_item", "SELECT event_id, 'filter' AS stage FROM events WHERE event_type = 'view'")
def per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.per_item(table(spark, sf_dir, "events"))


@query(
    "z5_leased_once",
    """WITH RECURSIVE messages AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events),
    granted AS (SELECT user_id, event_type, min(us) AS us FROM messages GROUP BY 1, 2
      UNION ALL SELECT g.user_id, g.event_type, (SELECT min(a.us) FROM messages a WHERE a.user_id = g.user_id AND a.event_type = g.event_type AND a.us >= g.us + 6 * 3600000000::BIGINT) FROM granted g WHERE g.us IS NOT NULL)
    SELECT user_id, event_type, count(us) AS leases, max(us) AS last_us FROM granted GROUP BY 1, 2""",
)
def leased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key got a lease of six hours, and when last: a message within one gets none."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    times = rows.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_set("us")).alias("us"))
    start = F.struct(F.lit(0).cast("long").alias("leases"), F.lit(None).cast("long").alias("last_us"))
    lease = 6 * 3_600_000_000
    found = F.aggregate("us", start, lambda s, t: F.when(s["last_us"].isNull() | (t >= s["last_us"] + lease), F.struct((s["leases"] + 1).alias("leases"), t.alias("last_us"))).otherwise(s))
    return times.select("user_id", "event_type", found.alias("f")).select("user_id", "event_type", "f.leases", "f.last_us")


@query("z8_fair_order")
def fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiters in their turn, in eight lanes. A lane's queue holds 256; who comes while it is full is turned away and has no row, which is the queue's own rule."""
    rows = _requests(spark, sf_dir).select((F.col("owner") % 8).alias("lane"), F.col("request").alias("token"), (F.col("request") % 4 + 1).alias("stage"), F.col("owner").alias("job"), F.floor(F.col("at_ms") / 100).alias("at_ms"))
    return sequential.fair_order(rows)


#: Requests of each owner in the order of their times, with what follows from all before them by recursion.
_REQUESTS = "r AS (SELECT user_id AS owner, event_id AS request, value > 20 AS good, epoch_us(ts) // 1000000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events)"


@query(
    "z9_token_bucket",
    f"""WITH RECURSIVE {_REQUESTS}, f AS (SELECT owner, request, n, at_ms, 20.0::DOUBLE AS held FROM r WHERE n = 1
      UNION ALL SELECT r.owner, r.request, r.n, r.at_ms, least(20.0::DOUBLE, CASE WHEN f.held >= 1 THEN f.held - 1 ELSE f.held END + greatest(0, r.at_ms - f.at_ms) * 3 / 60000::DOUBLE) FROM f JOIN r ON r.owner = f.owner AND r.n = f.n + 1)
    SELECT owner, request, held >= 1 AS granted, CASE WHEN held >= 1 THEN 0 ELSE ceil((1 - held) * 60000 / 3) END::BIGINT AS retry_ms FROM f""",
)
def bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.token_bucket(_requests(spark, sf_dir).withColumn("at_ms", F.floor(F.col("at_ms") / 1000)), per_minute=3, capacity=20)


@query(
    "z7_sliding_leases",
    f"""WITH RECURSIVE {_REQUESTS}, f AS (SELECT owner, 0::BIGINT AS n, 0::BIGINT AS request, []::BIGINT[] AS recent, []::BIGINT[] AS leases, false AS granted, 0::BIGINT AS wait_ms FROM r WHERE n = 1
      UNION ALL SELECT owner, n, request, CASE WHEN ok THEN list_append(recent, at_ms) ELSE recent END, CASE WHEN ok THEN list_append(leases, at_ms + 20000) ELSE leases END, ok,
        CASE WHEN ok THEN 0 ELSE greatest(250, CASE WHEN len(recent) >= 6 THEN recent[1] + 60000 - at_ms ELSE 0 END, CASE WHEN len(leases) >= 3 THEN leases[1] - at_ms ELSE 0 END) END::BIGINT
      FROM (SELECT *, len(recent) < 6 AND len(leases) < 3 AS ok FROM (SELECT r.owner, r.n, r.request, r.at_ms, list_filter(f.recent, lambda x: x > r.at_ms - 60000) AS recent, list_filter(f.leases, lambda x: x > r.at_ms) AS leases FROM f JOIN r ON r.owner = f.owner AND r.n = f.n + 1)))
    SELECT owner, request, granted, wait_ms FROM f WHERE n > 0""",
)
def sliding_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.rate_limited(_requests(spark, sf_dir).withColumn("at_ms", F.floor(F.col("at_ms") / 1000)), window_ms=60_000, rate=6, held=3, lease_ms=20_000)


@query("z10_fixed_window", "SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS n, count(*) > 5 AS limited FROM events GROUP BY 1, 2")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.fixed_window_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "z11_lockout",
    f"""WITH RECURSIVE {_REQUESTS}, f AS (SELECT owner, 0::BIGINT AS n, 0::BIGINT AS request, 0 AS failures, -1::BIGINT AS until, false AS locked FROM r WHERE n = 1
      UNION ALL SELECT owner, n, request, CASE WHEN tries >= 3 THEN 0 ELSE tries END, CASE WHEN NOT locked AND tries >= 3 THEN at_ms + 900000 ELSE until END, locked
      FROM (SELECT *, CASE WHEN locked THEN failures WHEN good THEN 0 ELSE failures + 1 END AS tries FROM (SELECT r.owner, r.n, r.request, r.at_ms, r.good, f.failures, f.until, r.at_ms < f.until AS locked FROM f JOIN r ON r.owner = f.owner AND r.n = f.n + 1)))
    SELECT owner AS account, request AS attempt, locked FROM f WHERE n > 0""",
)
def lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir).select(F.col("owner").alias("account"), F.col("request").alias("attempt"), F.floor(F.col("at_ms") / 1000).alias("at_ms"), (F.col("value") > 20).alias("good"))
    return sequential.lockouts(rows)


@query(
    "z14_late_refinement",
    """SELECT user_id, round(avg(value) FILTER (WHERE event_type <> 'purchase'), 6) AS provisional, round(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), 6) AS refined,
    round(coalesce(arg_max(value, event_id) FILTER (WHERE event_type = 'purchase'), avg(value)), 6) AS final FROM events GROUP BY user_id""",
)
def refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provisional result of what has come, and the late one that takes its place once there is one."""
    late = F.col("event_type") == "purchase"
    refined = F.max_by(F.when(late, F.col("value")), F.when(late, F.col("event_id")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(~late, F.col("value"))).alias("provisional"), refined.alias("refined"), F.avg("value").alias("all"))
    return rows.select("user_id", F.round("provisional", 6).alias("provisional"), F.round("refined", 6).alias("refined"), F.round(F.coalesce("refined", "all"), 6).alias("final"))


@query("z16_expired_uploads", "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR < TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'purchase'")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("ts + INTERVAL 24 HOURS < TIMESTAMP_NTZ '2024-01-10 00:00:00' AND event_type <> 'purchase'").select("event_id")


@query("z17_transport_retry", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'retry' WHEN event_id % 4 = 1 THEN 'retry' WHEN event_id % 4 = 2 THEN 'fail' ELSE 'done' END AS action, CASE WHEN event_id % 4 = 0 THEN 7 WHEN event_id % 4 = 1 THEN least(60, 2 * 2 ** (event_id % 7))::BIGINT END AS wait FROM events")
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    code = F.when(n % 4 == 0, 429).when(n % 4 == 1, 503).when(n % 4 == 2, 404).otherwise(200)
    action = F.when((code == 429) | (code >= 500), "retry").when(code >= 400, "fail").otherwise("done")
    after = F.when(n % 4 == 0, F.lit(7))
    wait = F.when(action == "retry", F.coalesce(after, F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), n % 7)).cast("long")))
    return table(spark, sf_dir, "events").select("event_id", action.alias("action"), wait.alias("wait"))
