"""Queries of queues, dispatch, callbacks, storage keys and the geometry around pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, matching
from ..session import checkpointed
from .aggregates import GROUPED, mode_of
from .evidence import _INNER, _OUTER, SECRET, hmac_sha256
from .joins import query_vectors
from .registry import ITEMS, assets, items, pick, query, table
from .scalars import BOXES, boxes


@query(
    "x4_flattened_strings",
    "SELECT doc_id, (lang IS NOT NULL)::BIGINT + (source IS NOT NULL)::BIGINT + (text IS NOT NULL)::BIGINT AS n, sha256(concat_ws(chr(10), lang, source, text)) AS sha FROM documents",
)
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings of a JSON value, however deep, in their order."""
    nested = F.to_json(F.struct("lang", F.lit(1).alias("n"), F.struct(F.array("source", "text").alias("list")).alias("more")))
    return table(spark, sf_dir, "documents").select("doc_id", text.json_strings(nested).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("sha"))


@query(
    "x9_common_substring",
    """SELECT p_partkey AS id, list_max(flatten(list_transform(range(1, length(p_name) + 1), lambda i: list_transform(range(1, length(p_name) + 2 - i), lambda n: CASE WHEN contains(lower(p_brand || p_type), substr(p_name, i, n)) THEN n ELSE 0 END)))) AS size FROM part""",
)
def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.common_substring("p_name", F.lower(F.concat("p_brand", "p_type"))).alias("size"))


#: Queue and priority of a step's work.
QUEUES = {"view": ("metadata", 3), "click": ("vision", 5), "purchase": ("callback", 9)}


@query(
    "z1_queue_routing",
    f"WITH {ITEMS} SELECT CASE event_type WHEN 'view' THEN 'metadata' WHEN 'click' THEN 'vision' WHEN 'purchase' THEN 'callback' ELSE 'control' END AS queue, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 5 WHEN 'purchase' THEN 9 ELSE 0 END AS priority, count(*) AS n, min(image_id) AS first FROM items WHERE status NOT IN ('failed', 'cancelled', 'selected') GROUP BY 1, 2",
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits in each queue: open items by the queue and priority of their next step; unknown steps go to control."""
    queue, priority = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for step, (name, level) in QUEUES.items():
        queue, priority = queue.when(F.col("event_type") == step, name), priority.when(F.col("event_type") == step, level)
    open_items = items(spark, sf_dir).where(~F.col("status").isin("failed", "cancelled", "selected"))
    return open_items.groupBy(queue.otherwise("control").alias("queue"), priority.otherwise(0).alias("priority")).agg(F.count("*").alias("n"), F.min("image_id").alias("first"))


CHUNK = 5


@query(
    "z2_dispatch_chunks",
    f"""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE user_id % 11 <> 0)
    SELECT user_id AS job_id, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS images, user_id % 3 * 2 + count(*) AS cursor, any_value(total) > user_id % 3 * 2 + count(*) AS more
    FROM r WHERE n > user_id % 3 * 2 AND n <= user_id % 3 * 2 + {CHUNK} GROUP BY user_id""",
)
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next chunk of each job that isn't cancelled, behind its cursor; where more is left the job is due again."""
    rows = table(spark, sf_dir, "events").where("user_id % 11 <> 0").select(F.col("user_id").alias("job_id"), "event_id")
    at = F.col("job_id") % 3 * 2
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("event_id"))
    chunk = rows.withColumn("n", n).where(F.col("n") <= 4 + CHUNK).where((F.col("n") > at) & (F.col("n") <= at + CHUNK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), ",")
    sent = chunk.groupBy("job_id").agg(ids.alias("images"), F.count("*").alias("sent"))
    total = rows.groupBy("job_id").agg(F.count("*").alias("total"))
    return sent.join(total, "job_id").select("job_id", "images", (at + F.col("sent")).alias("cursor"), (F.col("total") > at + F.col("sent")).alias("more"))


@query(
    "z12_callback_outcomes",
    "SELECT event_id, CASE WHEN value > 20 THEN 'delivered' WHEN event_id % 3 + 1 < 3 THEN 'retry' ELSE 'failed' END AS state, CASE WHEN value <= 20 AND event_id % 3 + 1 < 3 THEN least(3600, 30 * 2 ** (event_id % 3))::BIGINT END AS retry_s FROM events",
)
def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a delivery after its attempt (1, 2, 3): delivered, tried again after a doubled wait of an hour at most, or given up."""
    attempts, good = F.col("event_id") % 3 + 1, F.col("value") > 20
    again = ~good & (attempts < 3)
    wait = F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), attempts - 1)).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(good, "delivered").when(again, "retry").otherwise("failed").alias("state"), F.when(again, wait).alias("retry_s"))


#: Periods of the recurring work in seconds.
PERIODS = {"content_features": 300, "group_prototypes": 600, "expired_images": 3600, "stalled_images": 60, "pending_callbacks": 120}
_PERIODS = ", ".join(f"('{name}', {seconds})" for name, seconds in PERIODS.items())


@query(
    "z13_due_schedules",
    f"SELECT name, (epoch_us(b) - epoch_us(a)) // (s * 1000000::BIGINT) AS ticks, epoch_us(a) + (epoch_us(b) - epoch_us(a)) // (s * 1000000::BIGINT) * s * 1000000 AS last_us FROM (SELECT min(ts) AS a, max(ts) AS b FROM events), (VALUES {_PERIODS}) p(name, s)",
)
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each recurring task has come due since the first event, and when last."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = table(spark, sf_dir, "events").agg(micros(F.min("ts")).alias("a"), micros(F.max("ts")).alias("b"))
    each = span.select("a", "b", F.explode(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))).alias("name", "s"))
    ticks = F.floor((F.col("b") - F.col("a")) / (F.col("s") * F.lit(1_000_000).cast("long")))
    return each.select("name", ticks.alias("ticks"), (F.col("a") + ticks * F.col("s") * F.lit(1_000_000).cast("long")).alias("last_us"))


@query(
    "s7_purged_keys",
    "SELECT user_id AS job_id, count(*) FILTER (WHERE event_id % 17 <> 0) AS deleted, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_id % 17 = 0) AS failed FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id",
)
def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to delete less those whose deletion failed: only the deleted ones count as purged, the failed ones are listed."""
    wanted = table(spark, sf_dir, "events").where("event_type = 'view' AND ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'").select(F.col("user_id").alias("job_id"), "event_id")
    failures = table(spark, sf_dir, "events").where("event_id % 17 = 0").select("event_id", F.lit(True).alias("bad"))
    told = wanted.join(failures, "event_id", "left")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("event_id")))), lambda i: i.cast("string")), ",")
    return told.groupBy("job_id").agg(F.count_if(F.col("bad").isNull()).alias("deleted"), F.nullif(ids, F.lit("")).alias("failed"))


@query(
    "s18_signed_links",
    f"SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '/' || event_type || '/' || event_id || '.jpg?expires=600&signature=' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(event_type || '/' || event_id || '.jpg600')))) END AS url FROM events",
)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are good for ten minutes; null where there is no object."""
    key = F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")))
    signature = hmac_sha256(SECRET, F.concat(key, F.lit("600")).cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/"), key, F.lit("?expires=600&signature="), signature).alias("url"))


_SIZES = "s AS (SELECT p_partkey AS id, 100 + p_size * 37 AS w, 90 + p_partkey % 2900 AS h, (p_partkey % 13 - 6) * 0.5 AS angle FROM part)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (100 + F.col("p_size") * 37).alias("w"), (90 + k % 2900).alias("h"), ((k % 13 - 6) * 0.5).alias("angle"))


@query(
    "i16_output_size",
    f"WITH {_SIZES}, f AS (SELECT *, CASE WHEN greatest(w, h) >= 2048 THEN 1.0::DOUBLE ELSE 2048::DOUBLE / greatest(w, h) END AS f FROM s) SELECT id, greatest(1, round_even(w * f, 0))::BIGINT AS width, greatest(1, round_even(h * f, 0))::BIGINT AS height FROM f",
)
def output_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose longer side is under 2048 are enlarged to it."""
    longer = F.greatest("w", "h")
    by = F.when(longer >= 2048, 1.0).otherwise(2048 / longer)
    to = lambda c: F.greatest(F.lit(1).cast("long"), F.rint(F.col(c) * by).cast("long"))
    return _sizes(spark, sf_dir).select("id", to("w").alias("width"), to("h").alias("height"))


@query("i17_rotation_inset", f"WITH {_SIZES} SELECT id, (ceil(round(greatest(w, h) * sin(radians(abs(angle))), 9)) + 2)::BIGINT AS inset FROM s")
def inset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut off at each side of a turned picture."""
    return _sizes(spark, sf_dir).select("id", (F.ceil(F.round(F.greatest("w", "h") * F.sin(F.radians(F.abs("angle"))), 9)) + 2).alias("inset"))


_LINES = "lines AS (SELECT p_partkey // 8 AS image_id, 60 + p_partkey % 50 AS dx, (p_partkey // 8) % 9 - 4 + p_partkey % 2 AS dy FROM part)"


@query(
    "i8_skew_vote",
    f"""WITH {_LINES}, a AS (SELECT image_id, sqrt(dx * dx + dy * dy) AS len, degrees(atan2(dy, dx)) AS angle FROM lines),
    c AS (SELECT image_id, len, CASE WHEN abs(angle) <= 45 THEN 0 WHEN angle < 0 THEN -90 ELSE 90 END - angle AS c FROM a),
    near AS (SELECT *, count(*) OVER p AS n, sum(len) OVER p AS total FROM c WHERE abs(c) <= 5 WINDOW p AS (PARTITION BY image_id)),
    votes AS (SELECT image_id, k / 2.0 AS center, round(sum(len), 6) AS votes FROM near, range(-10, 11) t(k) WHERE n >= 4 AND abs(c - k / 2.0) <= 0.75 GROUP BY 1, 2),
    best AS (SELECT image_id, arg_max(center, votes * 1000 - center / 1000) AS center FROM votes GROUP BY image_id),
    same AS (SELECT near.*, sum(len) OVER (PARTITION BY image_id ORDER BY c, len ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER q AS m, sum(len) OVER q AS weight, stddev_pop(c) OVER q AS sd FROM near JOIN best USING (image_id) WHERE abs(c - center) <= 0.75 WINDOW q AS (PARTITION BY image_id)),
    median AS (SELECT image_id, min(c) AS c FROM same WHERE m >= 4 AND weight >= 0.3 * total AND sd <= 0.6 AND round(run, 6) >= round(weight / 2, 6) GROUP BY image_id)
    SELECT image_id, round(-c, 6) AS turn FROM median WHERE abs(c) >= 0.5""",
)
def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select(F.floor(k / 8).alias("image_id"), (60 + k % 50).alias("dx"), (F.floor(k / 8) % 9 - 4 + k % 2).alias("dy"))
    return evidence.skew_votes(lines).select("image_id", (F.round("turn", 6) + F.lit(0.0)).alias("turn"))


@query(
    "i29_logo_boxes",
    f"""WITH {BOXES}, l AS (SELECT b.*, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h FROM boxes b JOIN part ON p_partkey = id WHERE contains(p_name, 'widget') AND id % 10 >= 3)
    SELECT id, greatest(0, round_even(x0 - greatest(w * 0.28::DOUBLE, h * 0.9::DOUBLE), 0))::INT AS x0, greatest(0, round_even(y0 - h * 0.1::DOUBLE, 0))::INT AS y0, least(80, x1)::INT AS x1, least(64, round_even(y1 + h * 0.35::DOUBLE, 0))::INT AS y1 FROM l""",
)
def logo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of logos around lines of text that name them: the sign stands to the left, a small line below."""
    named = table(spark, sf_dir, "part").where(F.contains("p_name", F.lit("widget")) & (F.col("p_partkey") % 10 >= 3)).select(F.col("p_partkey").alias("id"))
    b = boxes(spark, sf_dir).join(named, "id", "left_semi")
    w, h = F.greatest(F.lit(1), F.col("x1") - F.col("x0")), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    low = lambda c: F.greatest(F.lit(0), F.rint(c).cast("int"))
    x0, y0 = low(F.col("x0") - F.greatest(w * 0.28, h * 0.9)), low(F.col("y0") - h * 0.1)
    return b.select("id", x0.alias("x0"), y0.alias("y0"), F.least(F.lit(80), F.col("x1").cast("int")).alias("x1"), F.least(F.lit(64), F.rint(F.col("y1") + h * 0.35).cast("int")).alias("y1"))


@query("i31_stored_state", f"WITH {BOXES} SELECT id, x1 - x0 AS w, y1 - y0 AS h, '{{\"boxes\":[[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']]}}' AS state FROM boxes")
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes stored as JSON and read back."""
    state = F.to_json(F.struct(F.array(F.array(*(F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")))).alias("boxes")))
    back = F.from_json("state", "boxes array<array<long>>")["boxes"][0]
    return boxes(spark, sf_dir).select("id", state.alias("state")).select("id", (back[2] - back[0]).alias("w"), (back[3] - back[1]).alias("h"), "state")


THINGS = ("plank", "cotton", "dusk", "ember", "flint", "grove", "hinge")
_THINGS = "[" + ", ".join(f"'{t}'" for t in THINGS) + "]"


@query(
    "v9_group_candidates",
    f"""WITH {GROUPED}, cores AS (SELECT *, CASE WHEN group_id % 2 = 0 THEN 'supported' WHEN group_id % 3 = 0 THEN 'conflicted' ELSE 'fallback' END AS mode FROM grouped),
    chosen AS (SELECT query_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, mode ORDER BY similarity DESC, asset_id DESC) AS n FROM cores WHERE mode <> 'conflicted') WHERE n <= 2),
    shown AS (SELECT DISTINCT query_id, group_id, asset_id % 7 AS a, asset_id % 5 AS b, 0.5 + 0.1 * (asset_id % 4) AS c FROM ranked JOIN chosen USING (query_id, group_id) WHERE rn <= 3),
    merged AS (SELECT query_id, group_id, list_distinct(flatten(list([a, b]))) AS ys, avg(c) AS c FROM shown GROUP BY 1, 2),
    met AS (SELECT query_id, group_id, CASE WHEN len(ys) >= 2 THEN [query_id // 10 % 7, query_id // 20 % 7] ELSE ys END AS few, CASE WHEN len(ys) >= 2 THEN ys ELSE [query_id // 10 % 7, query_id // 20 % 7] END AS many, least(c, 0.7) AS c FROM merged),
    told AS (SELECT query_id, group_id, c, list_avg(list_transform(few, lambda x: CASE WHEN list_contains(many, x) THEN 1.0 ELSE 0.5 END)) AS s, list_avg(list_transform(few, lambda x: CASE WHEN list_contains(many, x) THEN 1.0 ELSE 0.0 END)) AS r FROM met),
    w AS (SELECT g.*, CASE WHEN r > 0 THEN s END AS f, coalesce(0.30 * c * r * 0.2, 0) AS w FROM cores g LEFT JOIN told USING (query_id, group_id)),
    x AS (SELECT *, CASE WHEN f IS NULL THEN similarity ELSE similarity * (1 - w) + f * w END AS final FROM w)
    SELECT query_id, group_id, asset_id, round(similarity, 4) AS similarity, support, round(f, 4) AS feature_score, round(final, 4) AS final_score, round(final + CASE WHEN mode = 'supported' THEN 0.06 * 0.8 ELSE 0 END, 4) AS ranking FROM x""",
)
def group_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by pictures, the two best of each kind by content too. An asset shows two things, a query asks for two."""
    asked, library = query_vectors(spark, sf_dir)
    scores = checkpointed(matching.best_scored(asked, library, support=0.25))
    thing = lambda i: pick(THINGS, i)
    n, q = F.col("asset_id"), F.col("query_id")
    contents = assets(spark, sf_dir).select("asset_id", F.array(thing(n % 7), thing(n % 5)).alias("objects"), (0.5 + 0.1 * (n % 4)).alias("confidence"))
    wanted = asked.select("query_id", F.array(thing(F.floor(q / 10) % 7), thing(F.floor(q / 20) % 7)).alias("objects"), F.lit(0.7).alias("confidence"))
    cores = scores.select("query_id", "group_id").distinct().select("query_id", "group_id", mode_of(F.col("group_id")).alias("mode"), F.lit(0.8).alias("core"))
    out = evidence.group_candidates(scores, cores, contents, wanted, refined=2, support=0.25)
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("similarity", "feature_score", "final_score", "ranking")})


@query(
    "k10_selected_standard",
    """WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN event_id % 9 END AS sel, (event_id + 2 * k) % 8 AS std, k = (event_id // 4) % 5 OR ((event_id // 4) % 5 = 3 AND k < 2) AS hit FROM events, range(3) t(k)),
    m AS (SELECT id, any_value(sel) AS sel, count(*) FILTER (WHERE hit AND std <> 6) AS n, max(std) FILTER (WHERE hit AND std <> 6) AS one, bool_or(hit AND std = 6) AS also FROM e GROUP BY id)
    SELECT id AS image_id, CASE WHEN sel < 7 THEN sel WHEN sel >= 7 OR n > 1 OR (n = 1 AND also) THEN NULL WHEN n = 1 THEN one ELSE 6 END AS selected, CASE WHEN sel >= 7 THEN 'foreign' WHEN sel IS NULL AND (n > 1 OR (n = 1 AND also)) THEN 'ambiguous' END AS error FROM m""",
)
def selected_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id")
    answers = events.select(n.alias("image_id"), F.when(n % 4 == 0, n % 9).alias("selected_id"))
    p, k = F.floor(n / 4) % 5, F.col("k")
    told = events.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(n.alias("image_id"), ((n + 2 * k) % 8).alias("standard_id"), ((k == p) | ((p == 3) & (k < 2))).alias("matched"))
    standards = spark.range(7).select(F.col("id").alias("standard_id"), (F.col("id") == 6).alias("fallback"))
    return evidence.standard_selection(answers, told, standards)


@query("x37_archive_names", "SELECT page_id, printf('%03d', 900 + page_id % 200) || '_' || CASE WHEN trim(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')) = '' THEN page_id::VARCHAR ELSE trim(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')) END || '.jpg' AS name FROM pages")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in an archive, from the last part of each address."""
    return table(spark, sf_dir, "pages").select("page_id", text.archive_name(900 + F.col("page_id") % 200, F.col("url"), F.col("page_id").cast("string")).alias("name"))


@query("v15_rebuilt_prototypes")
def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library with the prototypes of changed groups (a third of them) chosen anew and their versions raised; in the others the three smallest ids stay."""
    rows = assets(spark, sf_dir)
    changed = F.col("group_id") % 3 == 0
    anew = matching.prototypes(rows.where(changed), 5).select("asset_id", F.lit(True).alias("anew"))
    old = rows.where(~changed).groupBy("group_id").agg(F.slice(F.array_sort(F.collect_set("asset_id")), 1, 3).alias("old"))
    flagged = rows.select("asset_id", "group_id").join(anew, "asset_id", "left").join(old, "group_id", "left")
    kept = F.coalesce(F.array_contains("old", F.col("asset_id")), F.lit(False))
    return flagged.select("asset_id", "group_id", (F.coalesce("anew", F.lit(False)) | kept).alias("prototype"), F.when(changed, 2).otherwise(1).alias("version"))
