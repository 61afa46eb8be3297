"""Scalar functions, scores and policies over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, score, text, vector
from ..operators import matching
from .registry import ASSETS, ITEMS, assets, items, pick, query, rounded, table


@query("x1_clamp", "SELECT event_id, greatest(0.0, least(1.0, value / 100 - 1)) AS x FROM events")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", score.clamp(F.col("value") / 100 - 1).alias("x"))


@query("x2_normalized", "SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS x FROM benchmark")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.normalized(F.col("text")).alias("x"))


@query("x3_first_spellings", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS n, 'Kitchen' AS first FROM customer")
def first_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.lit("Kitchen "), F.lit("kitchen"), F.lit(""), F.lit("Hall"), F.when(F.col("c_custkey") % 2 == 0, "HALL").otherwise("wall"))
    kept = text.first_spellings(values)
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(kept).alias("n"), kept[0].alias("first"))


@query("x5_field_lookup", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, coalesce(json_extract_string(props, '$.spaces'), json_extract_string(props, '$.k')) AS alias FROM events")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.spaces", "string"), F.try_variant_get(v, "$.k", "string")).alias("alias"))


@query("x6_has_value", "SELECT doc_id, length(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END)) > 0 AS x FROM documents")
def has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_value(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang"))).alias("x"))


@query("x7_confidence", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(1.0, json_extract_string(props, '$.k')::DOUBLE / 50) ELSE 0.7 END AS x FROM events")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 50
    return table(spark, sf_dir, "events").select("event_id", score.clamp(F.coalesce(F.when(F.col("event_id") % 3 == 0, k), F.lit(0.7))).alias("x"))


PAIRS = "pairs AS (SELECT a.item_id, regexp_replace(lower(a.text), '\\s+', '', 'g') AS x, regexp_replace(lower(b.text), '\\s+', '', 'g') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 3)"
DICE = """grams AS (SELECT item_id, x, y, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS a, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS b FROM pairs),
    dice AS (SELECT item_id, x, y, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS d FROM grams)"""


def whole_pairs(benchmark: DataFrame) -> DataFrame:
    whole = benchmark.select("item_id", text.normalized(F.col("text")).alias("x"))
    other = whole.select(F.col("item_id").alias("o"), F.col("x").alias("y"))
    return whole.join(other, F.col("o") == F.col("item_id") - F.col("item_id") % 3).select("item_id", "x", "y")


def pair_dice(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id", rounded(text.dice(F.col("x"), F.col("y")), 6).alias("dice"))


def pair_evidence(pairs: DataFrame) -> DataFrame:
    e = pairs.select("item_id", matching.phrase_evidence(F.col("x"), F.col("y")).alias("e"))
    return e.select("item_id", rounded(F.col("e.score"), 6).alias("score"), "e.reliability", "e.method")


@query("x8_dice", f"WITH {PAIRS}, {DICE} SELECT item_id, round(d, 6) AS dice FROM dice")
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_dice(whole_pairs(table(spark, sf_dir, "benchmark")))


@query(
    "x12_phrase_evidence",
    f"""WITH {PAIRS}, {DICE} SELECT item_id, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.75, least(length(x), length(y)) / greatest(length(x), length(y))) WHEN d >= 0.35 THEN d ELSE 0.5 END, 6) AS score,
    CASE WHEN x = y OR contains(x, y) OR contains(y, x) OR d >= 0.35 THEN 1.0 ELSE 0.0 END AS reliability, CASE WHEN x = y THEN 'exact' WHEN contains(x, y) OR contains(y, x) THEN 'normalized' WHEN d >= 0.35 THEN 'lexical' ELSE 'inconclusive' END AS method FROM dice""",
)
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_evidence(whole_pairs(table(spark, sf_dir, "benchmark")))


@query("x16_concepts", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'licence') AS licensed, contains(lower(text), 'the ') AS english FROM documents")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower("text")
    present = lambda *aliases: F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(hay, a))
    return table(spark, sf_dir, "documents").select("doc_id", present("license", "licence").alias("licensed"), present("the ").alias("english"))


@query("x17_tag_key", "SELECT doc_id, lower(source) || chr(31) || lower(lang) AS key FROM documents")
def tag_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tag_key(F.array("source", "lang")).alias("key"))


@query("x18_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("x19_average_hash", f"WITH {ASSETS} SELECT asset_id, array_to_string(list_transform(vector, lambda x: CASE WHEN x >= list_sum(vector) / len(vector) THEN '1' ELSE '0' END), '') AS phash FROM assets")
def average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).select("asset_id", vector.average_hash(F.col("vector")).alias("phash"))


@query("x20_hamming", f"WITH {ASSETS}, h AS (SELECT asset_id, list_transform(vector, lambda x: x >= list_sum(vector) / len(vector)) AS b FROM assets) SELECT x.asset_id, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance FROM h x JOIN h y ON y.asset_id = x.asset_id - x.asset_id % 7")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = assets(spark, sf_dir).select("asset_id", vector.bits(vector.average_hash(F.col("vector"))).alias("h"))
    other = h.select(F.col("asset_id").alias("o"), F.col("h").alias("g"))
    return h.join(other, F.col("o") == F.col("asset_id") - F.col("asset_id") % 7).select("asset_id", vector.hamming(F.col("h"), F.col("g")).alias("distance"))


@query("x21_redacted", "SELECT event_id, 'HTTP 429  api_key=[REDACTED]; Bearer [REDACTED]' AS shown FROM (SELECT event_id FROM events) t")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("HTTP 429 \n api_key: k"), F.col("event_id").cast("string"), F.lit(";  Bearer a.b-"), F.col("event_id").cast("string"))
    shown = F.replace(text.redacted(said), F.lit("HTTP 429 "), F.lit("HTTP 429  "))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"))


@query("x22_http_status", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 400 + event_id % 100 END::INT AS code FROM events")
def http_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("call failed: HTTP "), (400 + F.col("event_id") % 100).cast("string"), F.lit(" busy"))).otherwise(F.lit("HTTPS 12"))
    return table(spark, sf_dir, "events").select("event_id", text.http_status(said).alias("code"))


@query("x24_string_list", "SELECT doc_id, CASE WHEN lang = source THEN 1 ELSE 2 END AS n FROM documents")
def string_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array("lang", F.concat(F.lit(" "), "lang"), F.lit(" "), "source", F.lit("extra"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.string_list(values, 2)).alias("n"))


@query("x26_fenced_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` done"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(text.fenced_json(said)), "$.k", "int").alias("k"))


@query("x27_reason_text", "SELECT c_custkey, CASE WHEN c_custkey % 6 <= 3 THEN array_to_string(list_slice(['a', 'b', 'c', 'd', 'e'], 1, c_custkey % 6), '；') ELSE 'a；b；c；另有 ' || (c_custkey % 6 - 3) || ' 项' END AS reason FROM customer")
def reason_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("c_custkey") % 6).cast("int")
    failed = F.slice(F.array(*map(F.lit, "abcde")), F.lit(1), n)
    shown = F.array_join(F.slice(failed, 1, 3), "；")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(n > 3, F.concat(shown, F.lit("；另有 "), (n - 3).cast("string"), F.lit(" 项"))).otherwise(shown).alias("reason"))


@query("x29_surrogate_key", "SELECT n_nationkey, md5(n_name || '/' || n_regionkey) AS key FROM nation")
def surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.md5(F.concat_ws("/", "n_name", F.col("n_regionkey").cast("string")).cast("binary")).alias("key"))


@query("x31_deep_merge", "SELECT c_custkey, 'high' AS level, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'new' END AS name FROM customer")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("name"), F.lit("kept"), F.lit("level"), F.lit("low"))
    update = F.create_map(F.lit("level"), F.lit("high"), F.lit("name"), F.when(F.col("c_custkey") % 2 == 1, "new"))
    merged = F.map_zip_with(base, update, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf_dir, "customer").select("c_custkey", merged["level"].alias("level"), merged["name"].alias("name"))


@query("x32_deadline", "SELECT user_id, min(ts) + (1800 + 30 * count(*)) * INTERVAL 1 SECOND AS deadline FROM events GROUP BY user_id")
def deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return rows.select("user_id", (F.col("start") + F.make_dt_interval(secs=(1800 + 30 * F.col("n")).cast("decimal(18,6)"))).alias("deadline"))


@query("x33_backoff", "SELECT event_id, least(300, 5 * 2 ** (event_id % 10))::BIGINT AS wait FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.col("event_id") % 10)).cast("long").alias("wait"))


@query("x34_dated_key", "SELECT event_id, 'originals/' || strftime(ts, '%Y/%m/%d') || '/' || event_id || '.jpg' AS key FROM events")
def dated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("originals/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("key"))


@query("x35_age", "SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') AS age_us FROM events")
def age(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", (micros(F.lit("2024-02-01")) - micros(F.col("ts"))).alias("age_us"))


BOXES = "boxes AS (SELECT p_partkey AS id, p_partkey % 40 AS x0, p_size AS y0, p_partkey % 40 + p_size + 3 AS x1, p_size + 20 AS y1 FROM part)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k % 40).alias("x0"), s.alias("y0"), (k % 40 + s + 3).alias("x1"), (s + 20).alias("y1"))


def corners(prefix: str = "") -> geometry.Box:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


@query(
    "x39_iou",
    f"WITH {BOXES}, two AS (SELECT a.*, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM boxes a JOIN boxes b ON b.id = a.id + 1), i AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS i FROM two) SELECT id, round(i / greatest(1e-9, (x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - i), 6) AS iou FROM i",
)
def iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = boxes(spark, sf_dir)
    b = a.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    return a.join(b, "id").select("id", rounded(geometry.iou(corners(), corners("b_")), 6).alias("iou"))


@query("x40_pixel_box", "SELECT p_partkey AS id, round_even(0.1 * p_size * 10, 0)::INT AS x0, round_even(0.9 * p_size * 10, 0)::INT AS x1 FROM part")
def pixel_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.pixel_box((F.lit(0.1), F.lit(0.0), F.lit(0.9), F.lit(1.0)), F.col("p_size") * 10, F.lit(100))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), box.alias("b")).select("id", "b.x0", "b.x1")


@query("x41_expanded_box", f"WITH {BOXES} SELECT id, greatest(0, x0 - round_even((x1 - x0) * 0.25, 0)::INT)::INT AS x0, least(100, x1 + round_even((x1 - x0) * 0.25, 0)::INT)::INT AS x1 FROM boxes WHERE x0 < 100 AND y0 < 80")
def expanded_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = geometry.expanded(corners(), F.lit(100), F.lit(80), 0.25)
    return boxes(spark, sf_dir).select("id", grown.alias("b")).where("b IS NOT NULL").select("id", "b.x0", "b.x1")


@query("x42_weighted_median", "WITH t AS (SELECT event_type, value, event_id, sum(user_id + 1) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS upto, sum(user_id + 1) OVER (PARTITION BY event_type) AS total FROM events) SELECT event_type, min(value) AS median FROM t WHERE 2 * upto >= total GROUP BY event_type")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.sum(F.col("user_id") + 1).alias("w"))
    by_type = Window.partitionBy("event_type")
    upto = F.sum("w").over(by_type.orderBy("value"))
    return sums.select("event_type", "value", upto.alias("upto"), F.sum("w").over(by_type).alias("total")).where("2 * upto >= total").groupBy("event_type").agg(F.min("value").alias("median"))


@query("x45_bounded_size", "WITH s AS (SELECT p_partkey AS id, p_size * 200 AS w, p_partkey % 90 * 50 + 50 AS h FROM part), c AS (SELECT *, least(1.0, sqrt(4000000 / (w * h)), 4096 / w, 2048 / h) AS f FROM s) SELECT id, CASE WHEN f >= 1 THEN w ELSE greatest(1, floor(w * f)) END::BIGINT AS width, CASE WHEN f >= 1 THEN h ELSE greatest(1, floor(h * f)) END::BIGINT AS height FROM c")
def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.bounded_size(F.col("p_size") * 200, F.col("p_partkey") % 90 * 50 + 50, 4_000_000, 4096, 2048)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("s")).select("id", "s.width", "s.height")


@query("x47_substring_boxes", "SELECT doc_id, strpos(text, 'tion') AS at, CASE WHEN strpos(text, 'tion') > 0 THEN round((strpos(text, 'tion') - 1) / n_chars, 6) END AS x0 FROM documents")
def substring_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("text", "tion")
    return table(spark, sf_dir, "documents").select("doc_id", at.cast("long").alias("at"), F.when(at > 0, F.round((at - 1) / F.col("n_chars"), 6)).alias("x0"))


METRICS = "m AS (SELECT event_id AS id, value / 5 AS a, 100 - value / 10 AS b, (value * 7) % 100 AS c, 40 + user_id % 60 AS d, event_id % 6 AS r1, (event_id // 6) % 6 AS r2, (event_id // 36) % 6 AS r3, (event_id // 7) % 6 AS r4 FROM events)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("event_id"), F.col("value")
    ratings = ((n % 6).alias("r1"), (F.floor(n / 6) % 6).alias("r2"), (F.floor(n / 36) % 6).alias("r3"), (F.floor(n / 7) % 6).alias("r4"))
    return table(spark, sf_dir, "events").select(n.alias("id"), (v / 5).alias("a"), (100 - v / 10).alias("b"), ((v * 7) % 100).alias("c"), (40 + F.col("user_id") % 60).alias("d"), *ratings)


@query("k1_technical_quality", f"WITH {METRICS} SELECT id, round(100 * pow(a / 100, 0.38) * pow(b / 100, 0.34) * pow(c / 100, 0.13) * pow(d / 100, 0.15), 4) AS quality FROM m")
def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", rounded(score.technical_quality(*(F.col(x) for x in "abcd"))).alias("quality"))


@query("k2_k5_measures", f"WITH {METRICS} SELECT id, round(greatest(0, least(100, a * 4 / 250 * 100)), 4) AS sharpness, round(greatest(0, least(100, 100 - abs(d - 128) / 128 * 25 - greatest(b / 397, c / 203) * 45)), 4) AS exposure, round(greatest(0, least(100, (c - 10) / 54 * 100)), 4) AS contrast, round(greatest(0, least(100, 100 - d * 1.5)), 4) AS noise FROM m")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (F.col(x) for x in "abcd")
    return metrics(spark, sf_dir).select("id", rounded(score.sharpness(a * 4)).alias("sharpness"), rounded(score.exposure(d, b / 397, c / 203)).alias("exposure"), rounded(score.contrast(c)).alias("contrast"), rounded(score.noise(d)).alias("noise"))


@query(
    "k6_cover_score",
    f"""WITH {METRICS}, s AS (SELECT *, 15 * (r1 * 0.30 + r2 * 0.30 + r3 * 0.25 + r4 * 0.15) + d * 0.25 AS raw, least(r1, r2, r3, r4) AS low FROM m)
    SELECT id, round(greatest(0, least(100, raw, CASE WHEN id % 17 = 0 OR low <= 2 THEN 79.99 WHEN low = 3 THEN 89.99 WHEN low = 4 OR d < 80 THEN 94.99 ELSE 100 END)), 4) AS cover FROM s""",
)
def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", rounded(score.cover_score(*(F.col(f"r{k}") for k in (1, 2, 3, 4)), F.col("id") % 17 == 0, F.col("d"))).alias("cover"))


@query("k7_cover_fallback", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 87.65 ELSE json_extract_string(props, '$.k')::DOUBLE END AS cover FROM events")
def cover_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.col("props"))
    found = F.try_variant_get(F.try_parse_json(payload), "$.k", "double")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(found, F.lit(87.65)).alias("cover"))


@query(
    "k8_completion",
    """WITH f AS (SELECT event_id AS id, event_id % 2 = 0 AS a, event_id % 3 <> 0 AS b, event_id % 5 <> 0 AS c, event_id % 7 <> 0 AS d, event_id % 11 <> 0 AS e, event_id % 13 <> 0 AS f, event_id % 17 <> 0 AS g FROM events)
    SELECT id, CASE WHEN a AND b AND c AND d AND e AND f AND g THEN 'completed' ELSE 'non_completed' END AS label, CASE WHEN NOT (a AND b) THEN 'invalid_or_irrelevant' WHEN NOT c THEN 'insufficient_evidence' WHEN d AND e AND f AND g THEN 'completed' ELSE 'construction' END AS subtype,
    (NOT a)::INT + (NOT b)::INT + CASE WHEN a AND b AND NOT c THEN 2 WHEN a AND b AND c AND d AND e AND f AND g THEN 2 WHEN a AND b AND c THEN (NOT d)::INT + (NOT e)::INT + (NOT f)::INT + (NOT g)::INT ELSE 0 END AS codes FROM f""",
)
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    label, subtype, codes = score.completion(n % 2 == 0, n % 3 != 0, n % 5 != 0, n % 7 != 0, n % 11 != 0, n % 13 != 0, n % 17 != 0)
    return table(spark, sf_dir, "events").select(n.alias("id"), label.alias("label"), subtype.alias("subtype"), F.size(codes).alias("codes"))


@query(
    "k9_standard_resolution",
    """WITH e AS (SELECT user_id AS image, event_type AS standard, max(CASE WHEN value > 470 THEN 1 ELSE 0 END) AS hit FROM events GROUP BY 1, 2), s AS (SELECT image, sum(hit) FILTER (WHERE standard <> 'view') AS hits, max(standard) FILTER (WHERE hit = 1 AND standard <> 'view') AS chosen, max(hit) FILTER (WHERE standard = 'view') AS fallback, count(*) FILTER (WHERE standard = 'view') AS has_fallback FROM e GROUP BY image)
    SELECT image, CASE WHEN hits > 1 OR (hits = 1 AND fallback = 1) OR (hits = 0 AND has_fallback = 0) THEN NULL WHEN hits = 1 THEN chosen ELSE 'view' END AS standard, CASE WHEN hits > 1 THEN 'several' WHEN hits = 1 AND fallback = 1 THEN 'with_fallback' WHEN hits = 0 AND has_fallback = 0 THEN 'none' END AS error FROM s""",
)
def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image"), F.col("event_type").alias("standard")).agg(F.max(F.when(F.col("value") > 470, 1).otherwise(0)).alias("hit"))
    specific, fallback = F.col("standard") != "view", F.col("standard") == "view"
    s = rows.groupBy("image").agg(F.sum(F.when(specific, F.col("hit"))).alias("hits"), F.max(F.when(specific & (F.col("hit") == 1), F.col("standard"))).alias("chosen"), F.max(F.when(fallback, F.col("hit"))).alias("fallback"), F.count_if(fallback).alias("has"))
    error = F.when(F.col("hits") > 1, "several").when((F.col("hits") == 1) & (F.col("fallback") == 1), "with_fallback").when((F.col("hits") == 0) & (F.col("has") == 0), "none")
    return s.select("image", F.when(error.isNotNull(), None).when(F.col("hits") == 1, F.col("chosen")).otherwise("view").alias("standard"), error.alias("error"))


@query("k11_ground_film", f"WITH {METRICS} SELECT id, CASE WHEN r1 = 0 OR r2 = 0 THEN 'pass' WHEN c / 100 < 0.8 THEN 'review' WHEN b / 100 >= 0.75 THEN 'reject' WHEN b / 100 >= 0.70 THEN 'review' ELSE 'pass' END AS action FROM m")
def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", score.ground_film(F.col("r1") != 0, F.col("r2") != 0, F.col("b") / 100, F.col("c") / 100).alias("action"))


@query("k13_effective_change", f"WITH {METRICS} SELECT id, abs(a / 100 - 1) >= 0.02 OR b / 100 >= 0.02 AS effective FROM m")
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", ((F.abs(F.col("a") / 100 - 1) >= 0.02) | (F.col("b") / 100 >= 0.02)).alias("effective"))


@query(
    "k14_acceptance",
    f"WITH {METRICS} SELECT id, c / 1000 <= greatest(0.04, b / 2000 + 0.02) AND d / 1000 <= greatest(0.07, a / 2000 + 0.03) AND 2 * c BETWEEN 30 AND 225 AS exposure, c * 3 <= greatest(185, b * 1.4 + 10) AND d <= greatest(38, a + 10) AS color, c <= greatest(a * 1.25, a + 2) AS noise, d * 3 <= greatest(b * 2.4, b + 80) AS sharpening FROM m",
)
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (F.col(x) for x in "abcd")
    before = {"highlight": b / 2000, "shadow": a / 2000, "saturation": b, "cast": a, "noise": a, "edges": b}
    after = {"highlight": c / 1000, "shadow": d / 1000, "brightness": 2 * c, "saturation": c * 3, "cast": d, "noise": c, "edges": d * 3}
    return metrics(spark, sf_dir).select("id", *(v.alias(k) for k, v in score.acceptance(before, after).items()))


@query("k18_automatic_match", f"WITH {METRICS}, t AS (SELECT id, (['conflicted', 'unsupported', 'supported', 'fallback'])[id % 4 + 1] AS mode, b / 100 AS s, c / 1000 AS margin, r1 AS support, CASE WHEN r2 > 0 THEN d / 100 END AS f, r3 / 6 AS strength FROM m) SELECT id, CASE WHEN mode = 'conflicted' THEN false WHEN mode = 'unsupported' THEN s >= 0.8 AND margin >= 0 WHEN mode <> 'fallback' THEN s >= 0.6 AND margin >= 0 ELSE s >= 0.75 AND margin >= 0.04 AND support >= 2 AND coalesce(f >= 0.5, false) AND coalesce(strength, 0) >= 0.2 END AS automatic FROM t")
def automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = pick(("conflicted", "unsupported", "supported", "fallback"), F.col("id") % 4)
    f = F.when(F.col("r2") > 0, F.col("d") / 100)
    return metrics(spark, sf_dir).select("id", score.automatic_match(mode, F.col("b") / 100, F.col("c") / 1000, F.col("r1"), f, F.col("r3") / 6).alias("automatic"))


@query("k20_failure_code", f"WITH {ITEMS} SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'RATE_LIMITED' WHEN image_id % 3 = 1 THEN 'PROVIDER_ERROR' ELSE 'INTERNAL' END AS code FROM items WHERE status = 'failed'")
def failure_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(("HTTP 429 slow down", "HTTP 503 gone", "boom"), F.col("image_id") % 3)
    code = text.http_status(said)
    found = F.when(code == 429, "RATE_LIMITED").when(code.isNotNull(), "PROVIDER_ERROR").otherwise("INTERNAL")
    return items(spark, sf_dir).where("status = 'failed'").select("image_id", found.alias("code"))


@query("k21_approval_errors", "SELECT doc_id, (n_chars < 100)::INT + (lang = 'fr')::INT + (doc_id % 9 = 0)::INT AS errors FROM documents")
def approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = ((F.col("n_chars") < 100, "too short"), (F.col("lang") == "fr", "language"), (F.col("doc_id") % 9 == 0, "not reviewed"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))).alias("errors"))


@query("v6_reliability_blend", f"WITH {METRICS}, w AS (SELECT id, b / 103 AS s, CASE WHEN r1 > 0 THEN c / 107 END AS f, 0.05 + 0.25 * (r2 / 5.0) * (r3 / 5.0) AS w FROM m) SELECT id, round(CASE WHEN f IS NULL THEN s ELSE s * (1 - w) + f * w END, 6) AS final, round(CASE WHEN f IS NULL THEN 0 ELSE w END, 6) AS weight FROM w")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.when(F.col("r1") > 0, F.col("c") / 107)
    final, weight = score.blended(F.col("b") / 103, f, F.col("r2") / 5.0, F.col("r3") / 5.0, low=0.05)
    return metrics(spark, sf_dir).select("id", rounded(final, 6).alias("final"), rounded(weight, 6).alias("weight"))


@query("v7_fixed_blend", f"WITH {METRICS} SELECT id, round(CASE WHEN r1 > 0 THEN 0.7 * b / 100 + 0.3 * c / 100 ELSE b / 100 END, 6) AS final FROM m")
def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", rounded(score.fixed_blend(F.col("b") / 100, F.when(F.col("r1") > 0, F.col("c") / 100)), 6).alias("final"))


@query(
    "v10_rule_evidence",
    """WITH q AS (SELECT doc_id AS query_id, lower(text) AS h, (doc_id % 10) / 10.0 AS confidence FROM documents), r(group_id, dimension, a, b, least, hard) AS (VALUES (1, 'space', 'the', 'and', 2, true), (1, 'stage', 'license', 'licence', 1, false), (2, 'space', 'der', 'und', 1, true), (3, 'stage', 'que', 'los', 2, false)),
    d AS (SELECT query_id, group_id, dimension, contains(h, a)::INT + contains(h, b)::INT >= least AS direct, hard, confidence FROM q CROSS JOIN r)
    SELECT query_id, group_id, avg(direct::INT) AS score, CASE WHEN bool_and(direct AND confidence >= 0.6) THEN 'supported' WHEN bool_or(hard AND NOT (direct AND confidence >= 0.6)) THEN 'conflicted' ELSE 'unsupported' END AS mode FROM d GROUP BY query_id, group_id""",
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, table(spark, sf_dir, "documents"))


def evidence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    facts = docs.select(F.col("doc_id").alias("query_id"), F.lower("text").alias("haystack"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    rows = [(1, "space", ["the", "and"], 2, True), (1, "stage", ["license", "licence"], 1, False), (2, "space", ["der", "und"], 1, True), (3, "stage", ["que", "los"], 2, False)]
    table_of_rules = spark.createDataFrame(rows, "group_id int, dimension string, keywords array<string>, least_hits int, hard_gate boolean")
    return matching.rule_evidence(facts, table_of_rules)


@query("v12_decision_gates", f"WITH {METRICS} SELECT id, CASE WHEN b / 100 >= 0.6 OR (r1 > 0 AND c / 100 >= 0.75) THEN 'matched' ELSE 'unmatched' END AS decision FROM m")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = score.matched(F.col("b") / 100, F.when(F.col("r1") > 0, F.col("c") / 100))
    return metrics(spark, sf_dir).select("id", F.when(passed, "matched").otherwise("unmatched").alias("decision"))


@query("v13_unmatched_default", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'matched' END, 'unmatched') AS decision, l.quality AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "matched").alias("decision"), F.col("quality").alias("score"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    return matching.with_unmatched(asked, labels).withColumnRenamed("query_id", "doc_id")


@query("v19_reused_content", f"WITH {METRICS} SELECT id, CASE WHEN c >= 80 THEN 'routing' WHEN r1 = 3 THEN 'same_image' ELSE 'model' END AS origin FROM m")
def reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", F.coalesce(F.when(F.col("c") >= 80, "routing"), F.when(F.col("r1") == 3, "same_image"), F.lit("model")).alias("origin"))
