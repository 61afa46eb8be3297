"""Filters, conditional columns and state predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, score
from .registry import ITEMS, items, query, table

TERMINAL = ("rejected", "selected", "failed", "not_selected", "cancelled")
AFTER_FILTER = ("filtered", "beautify_planning", "enhancing", "enhanced", "tagging")
OPEN = ("pending", "processing")


@query("f1_claimable", f"WITH {ITEMS} SELECT image_id, job_id FROM items WHERE status NOT IN ('failed', 'cancelled') AND match_status = 'pending' AND analysis_status IN ('completed', 'failed') AND embedding_status IN ('completed', 'failed')")
def claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ("completed", "failed")
    return items(spark, sf_dir).where(~F.col("status").isin("failed", "cancelled") & (F.col("match_status") == "pending") & F.col("analysis_status").isin(*done) & F.col("embedding_status").isin(*done)).select("image_id", "job_id")


def result_filter(frame: DataFrame, decision: str | None = None, kind: str | None = None, least: float | None = None) -> DataFrame:
    """Only the filters that are given."""
    for given, condition in ((decision, F.col("status") == decision), (kind, F.col("event_type") == kind), (least, F.col("score") >= least)):
        if given is not None:
            frame = frame.where(condition)
    return frame


@query("f2_optional_filters", f"WITH {ITEMS} SELECT image_id, status, score FROM items WHERE status = 'selected' AND score >= 20.0")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_filter(items(spark, sf_dir), decision="selected", least=20.0).select("image_id", "status", "score")


def lease_due(as_of: Column, attempts: Column, state: Column, lease_until: Column, most: int = 3) -> Column:
    waiting = state.isNull() | (state == "pending")
    return (attempts < most) & (waiting | ((state == "processing") & (lease_until.isNull() | (lease_until < as_of))) | ((state == "failed") & (lease_until < as_of)))


@query(
    "f3_lease_due",
    f"""WITH {ITEMS} SELECT image_id, match_status FROM (SELECT image_id, match_status, image_id % 5 AS attempts, created_at + INTERVAL 10 MINUTE AS lease FROM items)
    WHERE attempts < 3 AND (match_status IS NULL OR match_status = 'pending' OR (match_status = 'processing' AND lease < TIMESTAMP '2024-01-15 00:00:00') OR (match_status = 'failed' AND lease < TIMESTAMP '2024-01-15 00:00:00'))""",
)
def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return items(spark, sf_dir).where(lease_due(as_of, F.col("image_id") % 5, F.col("match_status"), F.expr("created_at + INTERVAL 10 MINUTES"))).select("image_id", "match_status")


def pending_stages() -> Column:
    """The stages to publish again for an item."""
    ready = (F.col("match_status") == "queued") | ((F.col("match_status") == "pending") & F.col("analysis_status").isin("completed", "failed") & F.col("embedding_status").isin("completed", "failed"))
    after = F.col("status").isin(*AFTER_FILTER)
    stages = ((F.col("status") == "filtered") & (F.col("plan_status") == "pending"), "beautify_plan"), (after & (F.col("analysis_status") == "pending"), "analysis"), (after & (F.col("embedding_status") == "pending"), "embedding"), (after & ready, "matching")
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in stages)))


@query(
    "f4_pending_dispatch",
    f"""WITH {ITEMS}, active AS (SELECT * FROM items WHERE status IN ('filtered', 'beautify_planning', 'enhancing', 'enhanced', 'tagging'))
    SELECT image_id, 'beautify_plan' AS stage FROM active WHERE status = 'filtered' AND plan_status = 'pending' UNION ALL
    SELECT image_id, 'analysis' FROM active WHERE analysis_status = 'pending' UNION ALL SELECT image_id, 'embedding' FROM active WHERE embedding_status = 'pending' UNION ALL
    SELECT image_id, 'matching' FROM active WHERE match_status = 'queued' OR (match_status = 'pending' AND analysis_status IN ('completed', 'failed') AND embedding_status IN ('completed', 'failed'))""",
)
def pending_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("image_id", F.explode(pending_stages()).alias("stage"))


def bucket() -> Column:
    """The funnel bucket of an item; items that are done but not closed are in none."""
    status = F.col("status")
    return (
        F.when(status == "queued", "waiting")
        .when((status == "analyzing") & F.col("completion_status").isin(*OPEN), "classifying")
        .when(status == "analyzing", "filtering")
        .when((status == "beautify_planning") | ((status == "filtered") & F.col("plan_status").isin(*OPEN)), "beautify_planning")
        .when(status.isin("filtered", "enhancing"), "beautifying")
        .when(status.isin("enhanced", "tagging") & F.col("analysis_status").isin(*OPEN), "content_analysis")
        .when(status.isin("enhanced", "tagging") & (F.col("embedding_status").isin(*OPEN) | F.col("match_status").isin("pending", "queued", "processing")), "matching")
        .when(status == "selected", "completed")
        .when(status.isin("rejected", "not_selected", "failed", "cancelled"), status)
    )


BUCKET = """CASE WHEN status = 'queued' THEN 'waiting' WHEN status = 'analyzing' AND completion_status IN ('pending', 'processing') THEN 'classifying' WHEN status = 'analyzing' THEN 'filtering'
    WHEN status = 'beautify_planning' OR (status = 'filtered' AND plan_status IN ('pending', 'processing')) THEN 'beautify_planning' WHEN status IN ('filtered', 'enhancing') THEN 'beautifying'
    WHEN status IN ('enhanced', 'tagging') AND analysis_status IN ('pending', 'processing') THEN 'content_analysis'
    WHEN status IN ('enhanced', 'tagging') AND (embedding_status IN ('pending', 'processing') OR match_status IN ('pending', 'queued', 'processing')) THEN 'matching'
    WHEN status = 'selected' THEN 'completed' WHEN status IN ('rejected', 'not_selected', 'failed', 'cancelled') THEN status END"""


@query("f5_stage_bucket", f"WITH {ITEMS} SELECT image_id, {BUCKET} AS bucket FROM items")
def stage_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("image_id", bucket().alias("bucket"))


def pipeline_stage() -> Column:
    status, open_or_none = F.col("status"), lambda c: F.col(c).isNull() | F.col(c).isin(*OPEN)
    return (
        F.when(status == "queued", "waiting")
        .when(status == "analyzing", F.when(open_or_none("completion_status"), "classifying").otherwise("filtering"))
        .when((status == "beautify_planning") | ((status == "filtered") & open_or_none("plan_status")), "beautify_planning")
        .when(status.isin("filtered", "enhancing", "enhanced"), "beautifying")
        .when(status == "tagging", F.when(F.col("analysis_status").isin(*OPEN) | F.col("embedding_status").isin(*OPEN), "content_analysis_and_embedding").otherwise("matching"))
        .when(status == "selected", "completed")
        .otherwise(status)
    )


@query(
    "f6_pipeline_stage",
    f"""WITH {ITEMS} SELECT image_id, CASE WHEN status = 'queued' THEN 'waiting'
    WHEN status = 'analyzing' THEN CASE WHEN completion_status IS NULL OR completion_status IN ('pending', 'processing') THEN 'classifying' ELSE 'filtering' END
    WHEN status = 'beautify_planning' OR (status = 'filtered' AND (plan_status IS NULL OR plan_status IN ('pending', 'processing'))) THEN 'beautify_planning'
    WHEN status IN ('filtered', 'enhancing', 'enhanced') THEN 'beautifying'
    WHEN status = 'tagging' THEN CASE WHEN analysis_status IN ('pending', 'processing') OR embedding_status IN ('pending', 'processing') THEN 'content_analysis_and_embedding' ELSE 'matching' END
    WHEN status = 'selected' THEN 'completed' ELSE status END AS stage FROM items""",
)
def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("image_id", pipeline_stage().alias("stage"))


@query(
    "f7_beautify_status",
    f"""WITH {ITEMS} SELECT image_id, CASE WHEN plan_status = 'failed' THEN 'failed' WHEN status IN ('enhanced', 'tagging', 'selected') THEN 'completed'
    WHEN status IN ('beautify_planning', 'enhancing') THEN 'processing' WHEN status = 'filtered' OR plan_status = 'pending' THEN 'pending' END AS beautify_status FROM items""",
)
def beautify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, plan = F.col("status"), F.col("plan_status")
    found = F.when(plan == "failed", "failed").when(status.isin("enhanced", "tagging", "selected"), "completed").when(status.isin("beautify_planning", "enhancing"), "processing").when((status == "filtered") | (plan == "pending"), "pending")
    return items(spark, sf_dir).select("image_id", found.alias("beautify_status"))


def failure_node() -> Column:
    unfinished = ("pending", "processing", "failed")
    return (
        F.when(F.col("completion_status").isin(*OPEN), "classification")
        .when(F.col("ai_status").isin(*unfinished), "filtering")
        .when(F.col("plan_status").isin(*unfinished), "beautify_planning")
        .when(F.col("status") == "enhancing", "beautifying")
        .when(F.col("analysis_status").isin(*unfinished), "content_analysis")
        .when(F.col("embedding_status").isin(*unfinished), "embedding")
        .when(F.col("match_status").isin(*unfinished, "queued"), "matching")
        .otherwise("preprocess")
    )


FAILURE_NODE = """CASE WHEN completion_status IN ('pending', 'processing') THEN 'classification' WHEN ai_status IN ('pending', 'processing', 'failed') THEN 'filtering'
    WHEN plan_status IN ('pending', 'processing', 'failed') THEN 'beautify_planning' WHEN status = 'enhancing' THEN 'beautifying' WHEN analysis_status IN ('pending', 'processing', 'failed') THEN 'content_analysis'
    WHEN embedding_status IN ('pending', 'processing', 'failed') THEN 'embedding' WHEN match_status IN ('pending', 'processing', 'failed', 'queued') THEN 'matching' ELSE 'preprocess' END"""


@query("f8_failure_node", f"WITH {ITEMS} SELECT image_id, {FAILURE_NODE} AS node FROM items WHERE status = 'failed'")
def failed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("status") == "failed").select("image_id", failure_node().alias("node"))


def stalled(as_of: Column, started: Column, normal: int = 60, ai: int = 180) -> Column:
    """struct(node, timeout) of an item that has been at one node for too long, else null."""
    late = lambda node, seconds: F.when(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(started.cast("timestamp")) >= seconds, F.struct(F.lit(node).alias("node"), F.lit(seconds).alias("timeout")))
    nothing = F.lit(None).cast("struct<node:string,timeout:int>")
    status = F.col("status")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return (
        F.when(status.isin("queued", *TERMINAL), nothing)
        .when((status == "analyzing") & is_("completion_status", "processing"), late("classification", ai))
        .when((status == "analyzing") & is_("ai_status", "processing"), late("filtering", ai))
        .when((status == "analyzing") & (is_("completion_status", "pending") | is_("ai_status", "pending")), nothing)
        .when(status == "analyzing", late("preprocess", normal))
        .when((status == "beautify_planning") | is_("plan_status", "processing"), late("beautify_planning", ai))
        .when(is_("plan_status", "pending"), nothing)
        .when(status == "enhancing", late("enhance", normal))
        .when(is_("analysis_status", "processing"), late("content_analysis", ai))
        .when(is_("analysis_status", "pending"), nothing)
        .when(is_("embedding_status", "processing"), late("embedding", normal))
        .when(is_("embedding_status", "pending"), nothing)
        .when(is_("match_status", "processing"), late("matching", normal))
        .when(F.coalesce(F.col("match_status").isin("pending", "queued"), F.lit(False)), nothing)
        .otherwise(late("pipeline", normal))
    )


@query(
    "f9_stalled_node",
    f"""WITH {ITEMS}, placed AS (SELECT image_id, created_at, CASE WHEN status IN ('queued', 'rejected', 'selected', 'failed', 'not_selected', 'cancelled') THEN NULL
    WHEN status = 'analyzing' AND completion_status = 'processing' THEN 'classification' WHEN status = 'analyzing' AND ai_status = 'processing' THEN 'filtering'
    WHEN status = 'analyzing' AND (completion_status = 'pending' OR ai_status = 'pending') THEN NULL WHEN status = 'analyzing' THEN 'preprocess'
    WHEN status = 'beautify_planning' OR plan_status = 'processing' THEN 'beautify_planning' WHEN plan_status = 'pending' THEN NULL WHEN status = 'enhancing' THEN 'enhance'
    WHEN analysis_status = 'processing' THEN 'content_analysis' WHEN analysis_status = 'pending' THEN NULL WHEN embedding_status = 'processing' THEN 'embedding' WHEN embedding_status = 'pending' THEN NULL
    WHEN match_status = 'processing' THEN 'matching' WHEN match_status IN ('pending', 'queued') THEN NULL ELSE 'pipeline' END AS node FROM items)
    SELECT image_id, node, CASE WHEN node IN ('classification', 'filtering', 'beautify_planning', 'content_analysis') THEN 180 ELSE 60 END AS timeout FROM placed
    WHERE node IS NOT NULL AND date_diff('second', created_at, TIMESTAMP '2024-01-20 00:00:00') >= CASE WHEN node IN ('classification', 'filtering', 'beautify_planning', 'content_analysis') THEN 180 ELSE 60 END""",
)
def stalled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stalled(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    return items(spark, sf_dir).select("image_id", found.alias("s")).where("s IS NOT NULL").select("image_id", "s.node", "s.timeout")


@query("f10_terminal_status", f"WITH {ITEMS} SELECT job_id, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE status = 'failed') >= count(*) THEN 'failed' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial_failed' ELSE 'completed' END AS terminal FROM items GROUP BY job_id")
def terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("job_id").agg(score.terminal_status(F.count("*"), F.count_if(F.col("status") == "failed")).alias("terminal"))


#: Parts of a hundred, exact as whole numbers, that a bucket counts towards progress.
PROGRESS = {"classifying": 18, "filtering": 28, "beautify_planning": 42, "beautifying": 62, "content_analysis": 72, "matching": 90} | dict.fromkeys(("completed", "rejected", "not_selected", "failed", "cancelled"), 100)


@query("f11_progress", f"WITH {ITEMS}, b AS (SELECT job_id, {BUCKET} AS bucket FROM items) SELECT job_id, least(99, sum(CASE bucket {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in PROGRESS.items())} ELSE 0 END) // count(*))::INT AS progress FROM b GROUP BY job_id")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PROGRESS.items() for x in kv)), F.coalesce(bucket(), F.lit(""))), F.lit(0))
    return items(spark, sf_dir).groupBy("job_id").agg(F.least(F.lit(99), F.floor(F.sum(weight) / F.count("*"))).cast("int").alias("progress"))


@query("f12_size_guard", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'IMAGE_TOO_LARGE' END AS reject_code FROM documents")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, "IMAGE_TOO_LARGE").alias("reject_code"))


def public_url(url: Column) -> Column:
    """A web address without user data whose host is neither local nor a private number."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#@]+)", 1))
    private = host.rlike(r"^(localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*)$")
    return url.rlike(r"^(?i)https?://") & ~url.rlike(r"^[a-zA-Z]+://[^/]*@") & (host != "") & ~private


@query("f13_public_url", "SELECT page_id, regexp_matches(url, '^[hH][tT][tT][pP][sS]?://') AND NOT regexp_matches(url, '^[a-zA-Z]+://[^/]*@') AND lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#@]+)', 1)) <> '' AND NOT regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#@]+)', 1)), '^(localhost|.*\\.local|127\\..*|10\\..*|192\\.168\\..*|169\\.254\\..*|172\\.(1[6-9]|2[0-9]|3[01])\\..*|0\\..*)$') AS public FROM pages")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", public_url(F.col("url")).alias("public"))


def safe_key(key: Column) -> Column:
    return ~F.startswith(key, F.lit("/")) & ~F.array_contains(F.split(key, "/"), "..")


@query("f14_safe_key", "SELECT page_id, NOT starts_with(k, '/') AND NOT list_contains(string_split(k, '/'), '..') AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN substr(url, 8) WHEN 1 THEN '/' || url ELSE 'a/../' || url END AS k FROM pages)")
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("page_id") % 3 == 0, F.expr("substr(url, 8)")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), "url")).otherwise(F.concat(F.lit("a/../"), "url"))
    return table(spark, sf_dir, "pages").select("page_id", safe_key(k).alias("safe"))


def upload_error(kind: Column, size: Column, name: Column, most: int = 20_000_000) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    wanted = F.regexp_replace(F.element_at(F.split(kind, "/"), -1), "jpeg", "jpg")
    return F.when(~kind.isin("image/jpeg", "image/png", "image/webp"), "UNSUPPORTED_TYPE").when((size <= 0) | (size > most), "BAD_SIZE").when(F.regexp_replace(ending, "jpeg", "jpg") != wanted, "EXTENSION_MISMATCH")


@query(
    "f15_upload_error",
    """SELECT doc_id, CASE WHEN kind NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'UNSUPPORTED_TYPE' WHEN n_chars <= 0 OR n_chars > 1500 THEN 'BAD_SIZE'
    WHEN replace(lower(regexp_extract(name, '\\.([^.]+)$', 1)), 'jpeg', 'jpg') <> replace(string_split(kind, '/')[-1], 'jpeg', 'jpg') THEN 'EXTENSION_MISMATCH' END AS error
    FROM (SELECT doc_id, n_chars, (['image/jpeg', 'image/png', 'image/webp', 'image/gif'])[doc_id % 4 + 1] AS kind, 'f' || doc_id || (['.JPEG', '.png', '.jpg'])[doc_id % 3 + 1] AS name FROM documents)""",
)
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import pick

    n = F.col("doc_id")
    kind, name = pick(("image/jpeg", "image/png", "image/webp", "image/gif"), n % 4), F.concat(F.lit("f"), n.cast("string"), pick((".JPEG", ".png", ".jpg"), n % 3))
    return table(spark, sf_dir, "documents").select("doc_id", upload_error(kind, F.col("n_chars"), name, 1500).alias("error"))


def content_type(data: Column) -> Column:
    """By the first bytes: JPEG, PNG, or RIFF with WEBP at 8."""
    first = F.hex(F.substring(data, 1, 12))
    return F.when(first.startswith("FFD8FF"), "image/jpeg").when(first.startswith("89504E470D0A1A0A"), "image/png").when(first.startswith("52494646") & (F.substring(first, 17, 8) == "57454250"), "image/webp")


@query("f16_magic_bytes", "SELECT doc_id, (['image/jpeg', 'image/png', 'image/webp', NULL])[doc_id % 4 + 1] AS content_type FROM documents")
def magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import pick

    head = pick(("FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "4749463839"), F.col("doc_id") % 4)
    return table(spark, sf_dir, "documents").select("doc_id", content_type(F.concat(F.unhex(head), F.col("text").cast("binary"))).alias("content_type"))


@query("f17_portrait", "SELECT p_partkey, (p_size * 3) * 4 = (p_size * 4 + p_partkey % 2) * 3 AS portrait FROM part")
def portrait(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 3, F.col("p_size") * 4 + F.col("p_partkey") % 2
    return table(spark, sf_dir, "part").select("p_partkey", (w * 4 == h * 3).alias("portrait"))


@query("f18_retention", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey % 7 <> 0")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 7 != 0)).select("o_orderkey")


@query(
    "f19_upload_completeness",
    """WITH asked AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 3 <> 0)
    SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'abandoned' WHEN a.size = d.n_chars THEN 'completed' ELSE 'size_mismatch' END AS state FROM documents d LEFT JOIN asked a ON a.doc_id = d.doc_id""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    asked = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).alias("size"))
    state = F.when(F.col("size").isNull(), "abandoned").when(F.col("size") == F.col("n_chars"), "completed").otherwise("size_mismatch")
    return docs.join(asked, "doc_id", "left").select("doc_id", state.alias("state"))


@query("f20_workflow_stage", f"WITH {ITEMS}, b AS (SELECT job_id, {BUCKET} AS bucket FROM items), c AS (SELECT job_id, min(list_position(['waiting', 'classifying', 'filtering', 'beautify_planning', 'beautifying', 'content_analysis', 'matching'], bucket)) FILTER (WHERE list_position(['waiting', 'classifying', 'filtering', 'beautify_planning', 'beautifying', 'content_analysis', 'matching'], bucket) > 0) AS p FROM b GROUP BY job_id) SELECT job_id, p::BIGINT AS first_open FROM c")
def workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*map(F.lit, ("waiting", "classifying", "filtering", "beautify_planning", "beautifying", "content_analysis", "matching")))
    at = F.array_position(order, F.coalesce(bucket(), F.lit("")))
    return items(spark, sf_dir).groupBy("job_id").agg(F.min(F.when(at > 0, at)).alias("first_open"))


@query("f21_route_label", f"WITH {ITEMS} SELECT image_id, CASE event_type WHEN 'view' THEN 'construction' WHEN 'purchase' THEN 'completed' ELSE 'other' END AS route FROM items")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit("view"), F.lit("construction"), F.lit("purchase"), F.lit("completed"))
    return items(spark, sf_dir).select("image_id", F.coalesce(known[F.col("event_type")], F.lit("other")).alias("route"))


@query("f22_model_context", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 30 END AS width, CASE WHEN p_size > 10 THEN p_size * 40 END AS height FROM part")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("p_size") > 10, F.struct((F.col("p_size") * 30).alias("width"), (F.col("p_size") * 40).alias("height")))
    return table(spark, sf_dir, "part").select("p_partkey", known.alias("c")).select("p_partkey", "c.width", "c.height")


@query("x43_portrait_crop", "WITH s AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 900 + 5 AS h FROM part), u AS (SELECT *, least(w // 3, h // 4) AS u FROM s) SELECT p_partkey, ((w - u * 3) // 2)::BIGINT AS x0, ((h - u * 4) // 2)::BIGINT AS y0, (u * 3)::BIGINT AS width, (u * 4)::BIGINT AS height, round(u * 3 * u * 4 / (w * h), 4) AS retained FROM u WHERE w >= 3 AND h >= 4")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("w"), (F.col("p_partkey") % 900 + 5).alias("h"))
    cut = sizes.withColumn("c", geometry.portrait_crop(F.col("w"), F.col("h"))).where("c IS NOT NULL")
    width, height = F.col("c.x1") - F.col("c.x0"), F.col("c.y1") - F.col("c.y0")
    return cut.select("p_partkey", "c.x0", "c.y0", width.alias("width"), height.alias("height"), F.round(width * height / (F.col("w") * F.col("h")), 4).alias("retained"))
