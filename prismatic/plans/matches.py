"""The whole library match: rules of tags against contents, exact copies, group scores, content evidence, decision and tags in one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.library_rules import CONCEPTS, HARD, TAG_RULES
from ..operators import tag_rules
from .joins import query_vectors
from .registry import assets, query, table

#: All names of concepts, and all keywords, that contents are put together from.
NAMES = [n for names in CONCEPTS.values() for n in names.split()]
KEYWORDS = [k for r in TAG_RULES.values() for k in r.keywords]
#: Fields of a content: words of these lists at the key times a factor.
FIELDS = {"space": ((NAMES, 1),), "scene": ((NAMES, 5), (NAMES, 11)), "objects": ((NAMES, 3), (KEYWORDS, 1)), "ocr_text": ((KEYWORDS, 7),)}


def word(words: list[str], key: Column, factor: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(key * factor, F.lit(len(words))) + 1).cast("int"))


def contents_of(rows: DataFrame, key: str) -> DataFrame:
    """query_id, fields and confidence of a content that follows from a key."""
    k = F.col(key)
    fields = F.create_map(*(x for name, of in FIELDS.items() for x in (F.lit(name), F.array(*(word(w, k, f) for w, f in of)))))
    return rows.select(k.alias("query_id"), fields.alias("fields"), (k % 10 / 10.0).alias("confidence"))


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]" + ("" if words else "::VARCHAR[]")


def _lists(concepts) -> str:
    return "[" + ", ".join(_quoted(CONCEPTS[c].split()) for c in concepts) + "]" + ("" if concepts else "::VARCHAR[][]")


_RULES = ",\n".join(
    f"('{t}', '{r.dimension}', {str(r.dimension in HARD).lower()}, {_quoted(r.fields)}, {_quoted(r.keywords)}, {_lists(r.required)}, {_lists(r.supporting)}, {_lists(r.forbidden)})" for t, r in TAG_RULES.items()
)
_FIELDS = ", ".join(" || chr(10) || ".join(f"({_quoted(w)})[doc_id * {f} % {len(w)} + 1]" for w, f in of) + f" AS {name}" for name, of in FIELDS.items())
_HAYSTACK = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN list_contains(fields, '{name}') THEN {name} END" for name in FIELDS) + ")"
_THERE = "len(list_filter({0}, lambda names: len(list_filter(names, lambda n: contains(text, n))) > 0))"
TAGGED = f"""c AS (SELECT doc_id, {_FIELDS} FROM documents), r(tag, dimension, hard, fields, keywords, required, supporting, forbidden) AS (VALUES {_RULES}),
    h AS (SELECT doc_id, r.*, {_HAYSTACK} AS text FROM c CROSS JOIN r),
    n AS (SELECT *, len(list_distinct(list_filter(keywords, lambda k: contains(text, k)))) AS hits, {_THERE.format('required')} AS must, {_THERE.format('supporting')} AS may, {_THERE.format('forbidden')} AS mustnot FROM h),
    tagged AS (SELECT doc_id, tag, dimension, hard, hits, CASE WHEN mustnot > 0 THEN 0.0 WHEN hits >= 1 THEN 1.0 ELSE must / len(required) * CASE WHEN len(supporting) > 0 THEN 0.85 ELSE 1.0 END + CASE WHEN len(supporting) > 0 THEN may / len(supporting) * 0.15 ELSE 0.0 END END AS score,
      (hits >= 1 OR must = len(required)) AND mustnot = 0 AS passed FROM n)"""


@query("v10_tag_rules", f"WITH {TAGGED} SELECT doc_id AS query_id, tag, dimension, hits, round(score, 6) AS score, passed FROM tagged")
def tag_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each content says about every tag: keywords, and required, supporting and forbidden concepts."""
    found = tag_rules.tag_evidence(contents_of(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"))
    return found.select("query_id", "tag", "dimension", F.size("keywords").cast("long").alias("hits"), F.round("score", 6).alias("score"), "passed")


_TAGS = _quoted(list(TAG_RULES))

def tag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    tags = F.array(word(list(TAG_RULES), label, 7), word(list(TAG_RULES), label, 13), F.lit("own"))
    return table(spark, sf_dir, "embeddings").select(label.alias("group_id"), F.when(label % 5 == 4, F.array(F.lit("own"))).otherwise(tags).alias("tags")).distinct()


@query(
    "v10_core_evidence",
    f"""WITH {TAGGED}, g AS (SELECT group_id, unnest(CASE WHEN group_id % 5 = 4 THEN ['own'] ELSE [({_TAGS})[group_id * 7 % {len(TAG_RULES)} + 1], ({_TAGS})[group_id * 13 % {len(TAG_RULES)} + 1], 'own'] END) AS tag FROM (SELECT DISTINCT label::BIGINT AS group_id FROM embeddings)),
    pairs AS (SELECT doc_id, group_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 = 0), (SELECT DISTINCT group_id FROM g)),
    d AS (SELECT doc_id, group_id, dimension, max(score) AS score, bool_or(passed AND doc_id % 10 / 10.0 >= 0.6) AS passed, bool_or(hard) AS hard FROM tagged JOIN g USING (tag) WHERE doc_id % 10 = 0 GROUP BY ALL),
    m AS (SELECT doc_id, group_id, avg(score) AS core, CASE WHEN bool_and(passed) THEN 'supported' WHEN bool_or(hard AND NOT passed) THEN 'conflicted' ELSE 'unsupported' END AS mode FROM d GROUP BY ALL)
    SELECT doc_id AS query_id, group_id, coalesce(mode, 'fallback') AS mode, round(core, 6) AS core FROM pairs LEFT JOIN m USING (doc_id, group_id)""",
)
def core_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of every group for the contents of the query set."""
    docs = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 10 = 0")
    contents, groups = contents_of(docs, "doc_id"), tag_groups(spark, sf_dir)
    pairs = contents.select("query_id").crossJoin(F.broadcast(groups.select("group_id")))  # a stated query set against all groups, of which there are as many as labels
    return tag_rules.core_evidence(pairs, tag_rules.tag_evidence(contents), contents, groups).select("query_id", "group_id", "mode", F.round("core", 6).alias("core"))


@query("v17_match_with_evidence")
def match_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set against the library: exact copies, groups by pictures, their tags' rules, content, decision and the tags that are taken over."""
    asked, library = query_vectors(spark, sf_dir)
    n, q = F.col("asset_id"), F.col("query_id")
    sha = lambda key, own: F.when(key % 7 == 0, F.concat(F.lit("own"), key.cast("string"))).when(own, F.concat(F.lit("s"), (key % 400).cast("string"))).otherwise(F.concat(F.lit("s"), (key % 40).cast("string")))
    queries = asked.select("query_id", "query_vector", sha(q, q % 30 != 0).alias("sha"))
    contents = contents_of(asked, "query_id").withColumn("objects", F.array(word(NAMES, q, 3), word(KEYWORDS, q, 1)))
    shown = assets(spark, sf_dir).select("asset_id", F.array(word(NAMES, n, 3), word(KEYWORDS, n, 2)).alias("objects"), (0.5 + 0.1 * (n % 4)).alias("confidence"))
    found = tag_rules.library_match(queries, contents, library.withColumn("group_id", F.col("group_id").cast("long")).withColumn("sha", sha(n, F.lit(False))), shown, tag_groups(spark, sf_dir), auto=0.35, refined=4, support=0.25)
    rounded = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("similarity", "feature_score", "final_score", "margin")]
    return found.select("query_id", "decision", "matched_asset_id", "matched_group_id", F.array_join("tags", "|").alias("tags"), *rounded, "collapsed", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))
