"""Queries of content evidence, retouching policies, scans with children and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import retouch, score, text, vector
from ..operators import evidence, matching
from .registry import ASSETS, ITEMS, assets, items, pick, query, rounded, table
from .scalars import METRICS, metrics

ALIASES = {"license": ["license", "licence"], "german": [" der ", " und "], "french": [" que ", " les "], "english": [" the ", " and "]}
EXCLUSIVE = [("german", "english"), ("french", "english")]
_KNOWN = "list_filter(['english', 'french', 'german', 'license'], lambda c: CASE c WHEN 'license' THEN contains({0}, 'license') OR contains({0}, 'licence') WHEN 'german' THEN contains({0}, ' der ') OR contains({0}, ' und ') WHEN 'french' THEN contains({0}, ' que ') OR contains({0}, ' les ') ELSE contains({0}, ' the ') OR contains({0}, ' and ') END)"
_CONFLICT = "((list_contains(x, 'german') OR list_contains(x, 'french')) AND list_contains(y, 'english')) OR ((list_contains(y, 'german') OR list_contains(y, 'french')) AND list_contains(x, 'english'))"


@query("x10_concept_sets", f"SELECT doc_id, array_to_string({_KNOWN.format('lower(text)')}, ',') AS concepts FROM documents")
def concept_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(evidence.concepts(F.lower("text"), ALIASES), ",").alias("concepts"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("a"))
    return docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


@query(
    "x11_concept_conflicts",
    f"WITH c AS (SELECT a.doc_id, {_KNOWN.format('lower(a.text)')} AS x, {_KNOWN.format('lower(b.text)')} AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1) SELECT doc_id, {_CONFLICT} AS conflict FROM c",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (evidence.concepts(F.col(c), ALIASES) for c in "ab")
    return _neighbours(spark, sf_dir).select("doc_id", evidence.conflict(x, y, EXCLUSIVE).alias("conflict"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage's words in lists, and those of the passage before it."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    other = words.select((F.col("item_id") + 1).alias("item_id"), F.col("w").alias("v"))
    part = lambda c, a, b: F.slice(c, a, b - a + 1)
    joined = words.join(other, "item_id")
    return joined.select("item_id", part("w", 1, 4).alias("xs"), part("v", 1, 6).alias("ys"), part("w", 5, 9).alias("xt"), part("v", 7, 8).alias("yt"))


_SIDES = """w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    sides AS (SELECT a.item_id, a.w[1:4] AS xs, b.w[1:6] AS ys, a.w[5:9] AS xt, b.w[7:8] AS yt FROM w a JOIN w b ON b.item_id = a.item_id - 1),
    lists AS (SELECT item_id, 1 AS k, xs AS p, ys AS q FROM sides UNION ALL SELECT item_id, 2, yt, xt FROM sides),
    met AS (SELECT item_id, k, i, lower(p[i]) AS x, lower(unnest(q)) AS y FROM (SELECT item_id, k, p, q, unnest(range(1, len(p) + 1)) AS i FROM lists)),
    grams AS (SELECT *, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS a, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS b FROM met),
    alike AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS d FROM grams),
    judged AS (SELECT item_id, k, i, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.75, least(length(x), length(y)) / greatest(length(x), length(y))) WHEN d >= 0.35 THEN d ELSE 0.5 END::DOUBLE AS s,
      CASE WHEN x = y OR contains(x, y) OR contains(y, x) OR d >= 0.35 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM alike),
    best AS (SELECT item_id, k, i, max({'s': s, 'r': r}) AS e FROM judged GROUP BY ALL),
    listed AS (SELECT item_id, k, avg(e.s) AS s, avg(e.r) AS r FROM best GROUP BY ALL)"""


@query("x13_list_evidence", f"WITH {_SIDES} SELECT item_id, round(s, 6) AS score, round(r, 6) AS reliability FROM listed WHERE k = 1")
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lists(spark, sf_dir).select("item_id", evidence.list_evidence(F.col("xs"), F.col("ys")).alias("e"))
    return e.select("item_id", rounded(F.col("e.score"), 6).alias("score"), rounded(F.col("e.reliability"), 6).alias("reliability"))


def _maps(frame: DataFrame) -> DataFrame:
    left = F.create_map(F.lit("Wall "), F.col("xs"), F.lit("floor"), F.col("xt"), F.lit("door"), F.col("xs"))
    right = F.create_map(F.lit("wall"), F.col("ys"), F.lit("FLOOR"), F.col("yt"), F.lit("roof"), F.col("ys"))
    return frame.withColumn("e", evidence.mapping_evidence(left, right))


@query("x14_mapping_evidence", f"WITH {_SIDES} SELECT item_id, round(avg(s), 6) AS score, round(avg(r), 6) AS reliability FROM listed GROUP BY item_id")
def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(_lists(spark, sf_dir)).select("item_id", rounded(F.col("e.score"), 6).alias("score"), rounded(F.col("e.reliability"), 6).alias("reliability"))


@query(
    "v5_field_evidence",
    f"""WITH {_SIDES}, m AS (SELECT item_id, avg(s) AS s, avg(r) AS r FROM listed GROUP BY item_id),
    f AS (SELECT l.item_id, CASE WHEN l.item_id % 3 = 0 THEN NULL ELSE l.s END AS os, l.r AS orr, m.s AS ms, m.r AS mr, CASE WHEN l.item_id % 2 = 0 THEN 0.9 ELSE 0.7 END AS c FROM listed l JOIN m USING (item_id) WHERE l.k = 1),
    counted AS (SELECT *, CASE WHEN os IS NULL THEN 0 ELSE 0.10 * c * orr END AS ow, 0.10 * c * mr AS mw, CASE WHEN os IS NULL THEN 0.10 ELSE 0.20 END AS there FROM f)
    SELECT item_id, CASE WHEN ow + mw > 0 THEN round((ow * coalesce(os, 0) + mw * ms) / (ow + mw), 6) END AS score, round((ow + mw) / there, 6) AS reliability, round(there / 0.5, 6) AS coverage FROM counted""",
)
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _maps(_lists(spark, sf_dir)).withColumn("o", F.when(F.col("item_id") % 3 != 0, evidence.list_evidence(F.col("xs"), F.col("ys"))))
    found = evidence.field_evidence({"objects": F.col("o"), "features": F.col("e")}, F.when(F.col("item_id") % 2 == 0, F.lit(0.9)))
    return rows.select("item_id", *(rounded(c, 6).alias(n) for n, c in found.items()))


@query(
    "v8_candidate_score",
    f"""WITH {METRICS}, w AS (SELECT id, b / 103 AS s, CASE WHEN r1 > 0 THEN c / 107 END AS f, 0.30 * (r2 / 5.0) * (r3 / 5.0) AS w, d AS q FROM m),
    x AS (SELECT id, q, f, CASE WHEN f IS NULL THEN s ELSE s * (1 - w) + f * w END AS final FROM w)
    SELECT id, round(final, 6) AS final, final >= 0.6 OR coalesce(f >= 0.75, false) AS matched, round(final * q / 100, 6) AS weighted FROM x""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and content blended by the content's reliability and coverage, the gates, and the score by technical quality."""
    f = F.when(F.col("r1") > 0, F.col("c") / 107)
    final, _ = score.blended(F.col("b") / 103, f, F.col("r2") / 5.0, F.col("r3") / 5.0)
    return metrics(spark, sf_dir).select("id", rounded(final, 6).alias("final"), score.matched(final, f).alias("matched"), rounded(final * F.col("d") / 100, 6).alias("weighted"))


@query("v11_semantic_rank", f"WITH {METRICS} SELECT id, round(CASE r1 WHEN 0 THEN 2.0 WHEN 1 THEN b / 103 + 0.06 * least(1, c / 60) WHEN 2 THEN b / 103 ELSE b / 103 END, 6) AS rank FROM m")
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = pick(("exact", "supported", "unsupported", "conflicted", "fallback", "fallback"), F.col("r1"))
    return metrics(spark, sf_dir).select("id", rounded(evidence.semantic_rank(F.col("b") / 103, mode, F.col("c") / 60), 6).alias("rank"))


@query(
    "v2_clamped_cosine",
    f"WITH {ASSETS} SELECT a.asset_id, round(greatest(0, least(1, list_cosine_similarity(a.vector, b.vector))), 6) AS similarity FROM assets a JOIN assets b ON b.asset_id = a.asset_id + 1",
)
def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets(spark, sf_dir)
    other = rows.select((F.col("asset_id") - 1).alias("asset_id"), F.col("vector").alias("other"))
    similarity = vector.dot(F.col("vector"), F.col("other")) / (vector.norm(F.col("vector")) * vector.norm(F.col("other")))
    return rows.join(other, "asset_id").select("asset_id", rounded(score.clamp(similarity), 6).alias("similarity"))


@query(
    "v3_nearest_by_distance",
    f"""WITH {ASSETS}, d AS (SELECT a.asset_id AS query_id, b.asset_id, round(greatest(0, least(1, 1 - (1 - list_cosine_similarity(a.vector, b.vector)))), 6) AS similarity FROM assets a, assets b WHERE a.asset_id % 50 = 0 AND b.asset_id <> a.asset_id)
    SELECT query_id, asset_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS n FROM d) WHERE n <= 5""",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector: a stated query set against all rows, in blocks."""
    unit = matching.unit_vectors(assets(spark, sf_dir))
    asked = unit.where(F.col("asset_id") % 50 == 0).select(F.col("asset_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = matching.best_scored(asked, unit, top=6, by_group=False, larger=False, digits=6).where(F.col("query_id") != F.col("asset_id"))  # one of six may be the row itself
    return matching.nearest(found, 5).select("query_id", "asset_id", "similarity")


@query("l6_listed_candidates", f"WITH {METRICS}, r AS (SELECT id // 20 AS query_id, id, round(b / 103, 4) AS s, row_number() OVER (PARTITION BY id // 20 ORDER BY b / 103 DESC, id) AS n FROM m) SELECT query_id, string_agg(id || ':' || s, ',' ORDER BY n) AS listed FROM r WHERE n <= 10 GROUP BY query_id")
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of each query in one text, with scores of four digits."""
    rows = metrics(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("query_id"), "id", (F.col("b") / 103).alias("s"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "id"))), 1, 10)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(best, lambda e: F.concat(e["id"].cast("string"), F.lit(":"), F.round(-e["k"], 4).cast("string"))), ",").alias("listed"))


@query("x15_haystack", "SELECT doc_id, sha256(lower(lang) || chr(10) || lower(source) || chr(10) || lower(text)) AS sha FROM documents")
def haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.array_join(F.transform(F.flatten(F.array(F.array("lang"), F.array("source", "text"))), lambda v: F.lower(v)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(hay.cast("binary"), 256).alias("sha"))


@query("x25_string_list_map", "SELECT doc_id, 'lang=' || lang || CASE WHEN doc_id % 2 = 0 THEN ';source=' || source ELSE '' END AS x FROM documents")
def list_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of lists with trimmed keys, blank ones gone, and trimmed, distinct values."""
    raw = F.create_map(F.lit(" lang "), F.array(F.concat(F.lit(" "), "lang"), "lang", F.lit(" ")), F.lit(" "), F.array(F.lit("x")), F.lit("source"), F.when(F.col("doc_id") % 2 == 0, F.array("source", "source")).otherwise(F.array(F.lit(""))))
    kept = F.filter(F.map_entries(raw), lambda e: F.trim(e["key"]) != "")
    clean = F.filter(F.transform(kept, lambda e: F.struct(F.trim(e["key"]).alias("key"), text.string_list(e["value"], 100).alias("value"))), lambda e: F.size(e["value"]) > 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(clean, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";").alias("x"))


@query("x28_json_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.rule'), 'k' || json_extract_string(props, '$.k')) AS rule, replace(replace(props, '{', '['), '}', ']') AS flat, strpos(props, 'k') AS at FROM events")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.coalesce(F.get_json_object("props", "$.rule"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
    flat = F.replace(F.replace(F.col("props"), F.lit("{"), F.lit("[")), F.lit("}"), F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", rule.alias("rule"), flat.alias("flat"), F.instr("props", "k").cast("long").alias("at"))


@query("x30_json_array_text", "SELECT doc_id, left(lang || ' ' || source || ' ' || source, 120) AS x FROM documents")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.array("lang", "source", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.array_join(F.from_json(raw, "array<string>"), " "), F.lit(120)).alias("x"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a binary column in hexadecimal digits: the hash of the padded key and the hash of the other padded key and the message."""
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


SECRET = b"catalog callbacks"
_INNER, _OUTER = (bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(
    "x36_callback_signature",
    f"SELECT event_id, 'sha256=' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(event_id || '.' || props)))) AS signature FROM events",
)
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.col("event_id").cast("string"), F.lit("."), F.col("props")).cast("binary")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sha256="), hmac_sha256(SECRET, body)).alias("signature"))


@query("x38_label", "SELECT doc_id, left(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r=]+', '_', 'g'), 200) AS label FROM documents")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.label(F.col("text")).alias("label"))


@query("x44_retained_area", "WITH s AS (SELECT p_partkey AS id, 100 + p_size * 37 AS w, 90 + p_partkey % 700 AS h FROM part), u AS (SELECT *, least(w // 3, h // 4) AS u FROM s) SELECT id, round((u * 3) * (u * 4) / (w * h), 4) AS ratio, u * 3 <> w OR u * 4 <> h AS applied FROM u")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import geometry

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_size") * 37).alias("w"), (90 + F.col("p_partkey") % 700).alias("h"))
    rows = rows.withColumn("box", geometry.portrait_crop(F.col("w"), F.col("h")))
    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    return rows.select("id", F.round(w * h / (F.col("w") * F.col("h")), 4).alias("ratio"), ((w != F.col("w")) | (h != F.col("h"))).alias("applied"))


@query(
    "x46_scaled_boxes",
    """WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS x0, p_size AS y0, p_partkey % 40 + p_size + 3 AS x1, p_size + 20 AS y1 FROM part),
    s AS (SELECT id, greatest(0, least(64, round_even(x0 * 0.75, 0))) AS x0, greatest(0, least(48, round_even(y0 * 0.8, 0))) AS y0, greatest(0, least(64, round_even(x1 * 0.75, 0))) AS x1, greatest(0, least(48, round_even(y1 * 0.8, 0))) AS y1 FROM b)
    SELECT id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM s WHERE x1 > x0 AND y1 > y0""",
)
def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved to a picture of another size and held inside; those without area go."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (k % 40).alias("x0"), s.alias("y0"), (k % 40 + s + 3).alias("x1"), (s + 20).alias("y1"))
    held = lambda c, by, most: F.greatest(F.lit(0), F.least(F.lit(most), F.rint(F.col(c) * by).cast("int"))).alias(c)
    return rows.select("id", held("x0", 0.75, 64), held("y0", 0.8, 48), held("x1", 0.75, 64), held("y1", 0.8, 48)).where("x1 > x0 AND y1 > y0")


PLAN = {"brightness": ("a", 1 / 79, 0.7), "contrast": ("c", 1 / 103, 0.8), "color": ("c", 1 / 127, 0.7), "sharpness": ("b", 1 / 131, 0.6), "highlight_recovery": ("d", 1 / 499, 0.0), "shadow_lift": ("b", 1 / 397, 0.0), "local_tone": ("d", 1 / 307, 0.0), "denoise": ("a", 1 / 199, 0.0), "clarity": ("b", 1 / 293, 0.0), "white_balance": ("c", 1 / 311, 0.0)}
_PLAN = "p AS (SELECT id, " + ", ".join(f"{c} * {by!r} + {at!r} AS {n}" for n, (c, by, at) in PLAN.items()) + " FROM m)"


def _plan() -> retouch.Plan:
    return {n: F.col(c) * by + at for n, (c, by, at) in PLAN.items()}


@query(
    "k12_plan_clamps",
    f"""WITH {METRICS}, {_PLAN}, l AS (SELECT *, least(0.35, greatest(0.1, (brightness - 1) * 1.25)) AS least_recovery FROM p)
    SELECT id, round(CASE WHEN brightness >= 1.08 AND highlight_recovery < least_recovery THEN round(least_recovery, 3) ELSE highlight_recovery END, 5) AS highlight_recovery,
    round(least(contrast, CASE WHEN shadow_lift >= 0.18 OR local_tone >= 0.25 THEN 1.08 ELSE 1.5 END), 5) AS contrast, round(CASE WHEN denoise >= 0.25 THEN least(sharpness, 1.15) ELSE sharpness END, 5) AS sharpness,
    round(CASE WHEN denoise >= 0.25 THEN least(clarity, 0.18) ELSE clarity END, 5) AS clarity FROM l""",
)
def plan_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = retouch.clamped(_plan())
    return metrics(spark, sf_dir).select("id", *(rounded(held[n], 5).alias(n) for n in ("highlight_recovery", "contrast", "sharpness", "clarity")))


@query(
    "k15_preview_correction",
    f"""WITH {METRICS}, {_PLAN}, f AS (SELECT p.*, r1 = 0 AS e, r2 = 0 AS k, r3 = 0 AS n, r4 = 0 AS s FROM p JOIN m USING (id))
    SELECT id, round(CASE WHEN e THEN least(brightness, 1.03) ELSE brightness END, 5) AS brightness, round(CASE WHEN e THEN greatest(highlight_recovery, 0.22) ELSE highlight_recovery END, 5) AS highlight_recovery,
    round(CASE WHEN k THEN least(color, 1.05) ELSE color END, 5) AS color, round(CASE WHEN n THEN greatest(denoise, 0.12) ELSE denoise END, 5) AS denoise, round(CASE WHEN s THEN least(sharpness, 1.05) ELSE sharpness END, 5) AS sharpness,
    round(least(clarity, CASE WHEN s THEN 0.1 WHEN n THEN 0.12 ELSE 9 END), 5) AS clarity FROM f""",
)
def preview_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = {name: F.col(c) != 0 for name, c in (("exposure", "r1"), ("color", "r2"), ("noise", "r3"), ("sharpening", "r4"))}
    held = retouch.corrected(_plan(), passed)
    return metrics(spark, sf_dir).select("id", *(rounded(held[n], 5).alias(n) for n in ("brightness", "highlight_recovery", "color", "denoise", "sharpness", "clarity")))


@query("k22_acceptance_loop", f"WITH {METRICS} SELECT id, CASE WHEN r1 = 0 THEN 'neutral' WHEN r2 < 3 AND r3 < 3 THEN 'preview_fallback' WHEN r4 = 0 THEN 'final_fallback' WHEN r2 >= 3 THEN 'planned' ELSE 'corrected' END AS outcome FROM m")
def acceptance_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("id", retouch.outcome(F.col("r1") != 0, F.col("r2") >= 3, F.col("r3") >= 3, F.col("r4") != 0).alias("outcome"))


@query("k16_composed_filter", "SELECT n_nationkey AS id, CASE WHEN trim(r_name) = '' OR n_nationkey % 4 = 0 THEN n_name ELSE '[first] ' || r_name || chr(10) || '[then] ' || n_name END AS rule FROM nation JOIN region ON n_regionkey = r_regionkey")
def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of one class behind the rule for all, where there is one."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    general = F.when(F.col("n_nationkey") % 4 != 0, F.trim("r_name"))
    rule = F.when(F.coalesce(general, F.lit("")) == "", F.col("n_name")).otherwise(F.concat(F.lit("[first] "), general, F.lit("\n[then] "), "n_name"))
    return table(spark, sf_dir, "nation").join(F.broadcast(region), "n_regionkey").select(F.col("n_nationkey").alias("id"), rule.alias("rule"))


@query("k17_default_profile", "SELECT p_brand AS kind, min(p_partkey) AS profile, count(*) FILTER (WHERE p_size = 1) > 1 AS ambiguous FROM (SELECT *, min(CASE WHEN p_size = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand) AS best FROM part) WHERE (CASE WHEN p_size = 1 THEN 0 ELSE 1 END) = best GROUP BY p_brand")
def default_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's default profile (the first of those marked so, else the first of all), and whether more than one is marked."""
    first = F.min(F.struct(F.when(F.col("p_size") == 1, 0).otherwise(1).alias("rank"), "p_partkey"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind")).agg(first["p_partkey"].alias("profile"), (F.count_if(F.col("p_size") == 1) > 1).alias("ambiguous"))


@query("s1_item_with_satellites", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id = 17")
def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its key with what belongs to it: the key reaches both scans."""
    docs = table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("s2_config_record", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey = 7")
def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("s3_parent_and_children", "SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its turns in their order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), turns.alias("turns"))
    return rows.select("conv_id", "n", F.array_join(F.transform("turns", lambda t: t["t"]), ",").alias("turns"))


@query("s4_active_vectors", f"WITH {ASSETS} SELECT asset_id, group_id, len(vector) AS size FROM assets JOIN (SELECT DISTINCT n_nationkey AS group_id FROM nation WHERE n_regionkey <> 2) g USING (group_id) WHERE vector IS NOT NULL")
def active_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of active groups: a group is a nation outside region 2."""
    active = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("group_id")).distinct()
    return assets(spark, sf_dir).where("vector IS NOT NULL").join(F.broadcast(active), "group_id").select("asset_id", "group_id", F.size("vector").cast("long").alias("size"))


@query(
    "t9_upserted_match",
    "SELECT coalesce(l.doc_id, d.doc_id) AS image_id, CASE WHEN d.doc_id IS NOT NULL THEN d.lang ELSE 'kept' END AS decision, d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AS replaced FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d ON l.doc_id = d.doc_id",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New matches take the place of those of the same image; the others stay."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.lit(True).alias("was"))
    new = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("decision"))
    joined = old.join(new, "image_id", "full")
    return joined.select("image_id", F.coalesce("decision", F.lit("kept")).alias("decision"), (F.col("was").isNotNull() & F.col("decision").isNotNull()).alias("replaced"))


@query("t13_replaced_prototypes", f"WITH {ASSETS}, best AS (SELECT asset_id FROM (SELECT asset_id, row_number() OVER (PARTITION BY group_id ORDER BY asset_id) AS n FROM assets) WHERE n <= 3) SELECT a.asset_id, a.group_id, b.asset_id IS NOT NULL AS prototype, 1 + a.group_id % 2 AS version FROM assets a LEFT JOIN best b USING (asset_id)")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags cleared and set anew in one pass, and the group's version raised."""
    rows = assets(spark, sf_dir).select("asset_id", "group_id")
    best = rows.groupBy("group_id").agg(F.slice(F.array_sort(F.collect_list("asset_id")), 1, 3).alias("best"))
    return rows.join(best, "group_id").select("asset_id", "group_id", F.array_contains("best", F.col("asset_id")).alias("prototype"), (1 + F.col("group_id") % 2).alias("version"))


@query("z6_stage_timeouts", f"WITH {ITEMS} SELECT image_id, CASE WHEN analysis_status = 'processing' AND created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE THEN 'analysis' WHEN embedding_status = 'processing' AND created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY THEN 'embedding' END AS timed_out FROM items WHERE status NOT IN ('failed', 'cancelled', 'selected')")
def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage of each open item that has run for longer than it may, at a given time."""
    now = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
    late = lambda step, patience: (F.col(f"{step}_status") == "processing") & F.expr(f"created_at < {now} - INTERVAL {patience}")
    found = F.when(late("analysis", "30 MINUTES"), "analysis").when(late("embedding", "3 DAYS"), "embedding")
    return items(spark, sf_dir).where(~F.col("status").isin("failed", "cancelled", "selected")).select("image_id", found.alias("timed_out"))


@query("z4_fan_in", "SELECT user_id, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS complete, count(DISTINCT event_type) AS kinds FROM events WHERE event_id % 7 < 3 GROUP BY user_id")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items have had all stages, however often: the batch form of the stream's fan-in."""
    events = table(spark, sf_dir, "events")
    stages = events.select("event_type").distinct().agg(F.count("*").alias("all"))
    kinds = events.where("event_id % 7 < 3").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("kinds"))
    return kinds.join(F.broadcast(stages)).select("user_id", (F.col("kinds") == F.col("all")).alias("complete"), "kinds")
