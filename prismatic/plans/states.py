"""State transitions as folds of events: no row is updated, the state of a key is what its rows say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .predicates import TERMINAL
from .registry import ITEMS, items, query, table

#: From status to status, as the stages allow it.
NEXT = (("queued", "analyzing"), ("analyzing", "filtered"), ("filtered", "beautify_planning"), ("beautify_planning", "enhancing"), ("enhancing", "enhanced"), ("enhanced", "tagging"), ("tagging", "selected"))
NEXT_SQL = "next(status, after) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NEXT) + ")"


def next_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEXT, "status string, after string")


@query("t1_current_state", "SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("t2_claim_batch", f"WITH {ITEMS} SELECT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, image_id) AS rn FROM items WHERE plan_status = 'pending') t WHERE rn <= 4")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "image_id"))
    return items(spark, sf_dir).where("plan_status = 'pending'").withColumn("rn", rn).where("rn <= 4").select("image_id")


@query("t3_claim_with_lease", f"WITH {ITEMS} SELECT image_id, image_id % 5 + 1 AS attempts, created_at + INTERVAL 10 MINUTE AS lease_until FROM items WHERE match_status = 'pending' AND image_id % 5 < 3")
def claim_with_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("match_status = 'pending' AND image_id % 5 < 3").select("image_id", (F.col("image_id") % 5 + 1).alias("attempts"), F.expr("created_at + INTERVAL 10 MINUTES").alias("lease_until"))


@query("t4_completion_rows", f"WITH {ITEMS} SELECT image_id, 'item' AS row_of, 'enhanced' AS value FROM items WHERE status = 'enhancing' UNION ALL SELECT image_id, 'result', 'enhanced/' || image_id || '.jpg' FROM items WHERE status = 'enhancing'")
def completion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.struct(F.lit("item").alias("row_of"), F.lit("enhanced").alias("value")), F.struct(F.lit("result").alias("row_of"), F.concat(F.lit("enhanced/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("value")))
    return items(spark, sf_dir).where("status = 'enhancing'").select("image_id", F.inline(both))


@query("t5_terminal_guard", f"WITH {ITEMS} SELECT image_id, CASE WHEN status IN ('analyzing', 'tagging') THEN 'failed' ELSE status END AS status FROM items")
def terminal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("image_id", F.when(F.col("status").isin("analyzing", "tagging"), "failed").otherwise(F.col("status")).alias("status"))


@query("t6_fan_out", f"WITH {ITEMS}, t AS (SELECT *, plan_status IS NULL AND analysis_status IS NULL AND match_status IS NULL AS fresh FROM items WHERE status = 'filtered') SELECT image_id, CASE WHEN fresh THEN 'pending' ELSE plan_status END AS plan_status, CASE WHEN fresh THEN 'pending' ELSE analysis_status END AS analysis_status, CASE WHEN fresh THEN 'pending' ELSE match_status END AS match_status FROM t")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ("plan_status", "analysis_status", "match_status")
    fresh = F.coalesce(*steps).isNull()
    return items(spark, sf_dir).where("status = 'filtered'").select("image_id", *(F.when(fresh, "pending").otherwise(F.col(c)).alias(c) for c in steps))


@query("t7_fan_in", "SELECT user_id, count(DISTINCT event_type) AS stages, count(DISTINCT event_type) = 5 AS complete FROM events GROUP BY user_id")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("stages")).withColumn("complete", F.col("stages") == 5)


@query("t8_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("t10_retry_reset", f"WITH {ITEMS} SELECT image_id, 'queued' AS status, NULL::VARCHAR AS match_status, greatest(image_id % 4 - 1, 0) AS failures FROM items WHERE status = 'failed'")
def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("status = 'failed'").select("image_id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("match_status"), F.greatest(F.col("image_id") % 4 - 1, F.lit(0)).alias("failures"))


@query("t11_cancel_cascade", f"WITH {ITEMS} SELECT image_id, CASE WHEN job_id % 10 = 0 AND status NOT IN ('rejected', 'selected', 'failed', 'not_selected', 'cancelled') THEN 'cancelled' ELSE status END AS status FROM items")
def cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_items = (F.col("job_id") % 10 == 0) & ~F.col("status").isin(*TERMINAL)
    return items(spark, sf_dir).select("image_id", F.when(open_items, "cancelled").otherwise(F.col("status")).alias("status"))


@query("t12_isolated_failure", f"WITH {ITEMS} SELECT job_id, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE status IN ('queued', 'analyzing')) > 0 THEN 'processing' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial_failed' ELSE 'completed' END AS job_status FROM items GROUP BY job_id")
def isolated_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("queued", "analyzing")).alias("open"))
    return rows.select("job_id", "failed", F.when(F.col("open") > 0, "processing").when(F.col("failed") > 0, "partial_failed").otherwise("completed").alias("job_status"))


@query("t14_mark_stale", f"WITH {ITEMS} SELECT DISTINCT n.c_custkey AS group_id, true AS stale FROM customer n WHERE n.c_custkey IN (SELECT job_id FROM items WHERE status = 'selected')")
def mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = items(spark, sf_dir).where("status = 'selected'").select(F.col("job_id").alias("group_id")).distinct()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id")).join(touched, "group_id", "left_semi").withColumn("stale", F.lit(True))


@query("t15_merge", "WITH s AS (SELECT o_custkey AS id, o_totalprice AS v, 2 AS p, o_orderkey AS k FROM orders UNION ALL SELECT c_custkey, c_acctbal, 1, 0 FROM customer) SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k DESC) AS rn FROM s) t WHERE rn = 1")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(2).alias("p"), F.col("o_orderkey").alias("k"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("k"))
    return new.unionByName(old).groupBy("id").agg(F.max_by("v", F.struct("p", "k")).alias("v"))


@query("t16_reindex_failed", f"WITH {ITEMS} SELECT image_id, 'pending' AS embedding_status FROM items WHERE embedding_status = 'failed'")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("embedding_status = 'failed'").select("image_id", F.lit("pending").alias("embedding_status"))


@query("t17_cursor_with_attempts", f"WITH {ITEMS} SELECT image_id, CASE WHEN image_id % 4 < 2 THEN image_id % 4 + 1 END AS attempt, CASE WHEN image_id % 4 >= 2 THEN 'failed' ELSE status END AS status FROM items WHERE status = 'enhancing'")
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = F.col("image_id") % 4
    return items(spark, sf_dir).where("status = 'enhancing'").select("image_id", F.when(tried < 2, tried + 1).alias("attempt"), F.when(tried >= 2, "failed").otherwise(F.col("status")).alias("status"))


@query("t19_stage_reset", f"WITH {ITEMS} SELECT image_id, 'queued' AS status FROM items WHERE status = 'analyzing' AND created_at < TIMESTAMP '2024-01-15 00:00:00'")
def stage_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("status = 'analyzing' AND created_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("image_id", F.lit("queued").alias("status"))


@query("t20_recovery_plan", f"WITH {ITEMS} SELECT DISTINCT publisher, image_id FROM (SELECT 'analysis' AS publisher, image_id FROM items WHERE analysis_status IN ('pending', 'failed') UNION ALL SELECT 'embedding', image_id FROM items WHERE embedding_status IN ('pending', 'failed') UNION ALL SELECT 'analysis', image_id FROM items WHERE status = 'tagging') t")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    sets = (("analysis", F.col("analysis_status").isin("pending", "failed")), ("embedding", F.col("embedding_status").isin("pending", "failed")), ("analysis", F.col("status") == "tagging"))
    publishers = F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in sets))))
    return rows.select(F.explode(publishers).alias("publisher"), "image_id")


@query("t21_advance_stage", f"WITH {ITEMS}, {NEXT_SQL} SELECT image_id, after AS status, 0 AS attempts FROM items JOIN next USING (status)")
def advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).join(F.broadcast(next_states(spark)), "status").select("image_id", F.col("after").alias("status"), F.lit(0).alias("attempts"))


@query("t22_provenance_guard", f"WITH {ITEMS} SELECT image_id, event_type AS writer FROM items WHERE status = 'tagging' AND event_type <> 'purchase'")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("status = 'tagging' AND event_type <> 'purchase'").select("image_id", F.col("event_type").alias("writer"))


@query("t23_append_reason", f"WITH {ITEMS} SELECT image_id, list_aggregate(list_distinct(CASE WHEN event_type = 'error' THEN ['blurry', 'dark', 'blurry'] ELSE ['blurry', event_type] END), 'count') AS reasons FROM items")
def append_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("event_type") == "error", F.array(F.lit("dark"), F.lit("blurry"))).otherwise(F.array(F.col("event_type")))
    return items(spark, sf_dir).select("image_id", F.size(F.array_union(F.array(F.lit("blurry")), new)).cast("long").alias("reasons"))
