"""What a picture shows against the rules of a group's tags, and the whole library match over it.

Rules are a table of configuration, so what each of them finds in a content is an expression of functions over the
content's row; groups meet these findings in a join by tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.library_rules import CONCEPTS, HARD, LEAST_CONFIDENCE, SUPPORTING_SHARE, TAG_RULES, TagRule
from ..session import checkpointed
from . import evidence, matching

def haystack(fields: Column, names: tuple[str, ...]) -> Column:
    """All strings of the named fields of a map from fields to lists, each on a line, in lower case."""
    lists = [F.coalesce(fields[n], F.array().cast("array<string>")) for n in names]
    return F.lower(F.array_join(F.flatten(F.array(*lists)), "\n"))


def _standing(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The keys of which a name stands in the text."""
    if not names:
        return F.array().cast("array<string>")
    listed = F.array(*(F.struct(F.lit(key).alias("key"), F.array(*(F.lit(w.strip().lower()) for w in words if w.strip())).cast("array<string>").alias("names")) for key, words in names.items()))
    return F.transform(F.filter(listed, lambda e: F.exists(e["names"], lambda n: F.contains(text, n))), lambda e: e["key"])


def tag_evidence(contents: DataFrame, rules: dict[str, TagRule] = TAG_RULES, concepts: dict[str, str] = CONCEPTS) -> DataFrame:
    """query_id and, for each tag with a rule, what the content says: keywords, required, missing, supporting, forbidden, score, passed. contents: query_id, fields (map of lists).

    Enough keywords say the tag outright (score 1), so do all required concepts; a forbidden concept rules it out (score 0). Else the score is the required concepts'
    part, of which supporting ones have a share. A query_id is one content; null fields are empty ones.
    """
    fields = F.coalesce(F.col("fields"), F.create_map().cast("map<string,array<string>>"))
    texts = {names: f"_h{k}" for k, names in enumerate(dict.fromkeys(r.fields for r in rules.values()))}
    rows = contents.select("query_id", *(haystack(fields, names).alias(c) for names, c in texts.items()))
    found = []
    for tag, r in rules.items():
        text = F.col(texts[r.fields])
        named = {c: tuple(concepts.get(c, "").split()) for c in (*r.required, *r.supporting, *r.forbidden)}
        hits = _standing(text, {k: (k,) for k in r.keywords})
        of = lambda which: _standing(text, {c: named[c] for c in which})  # noqa: B023, E731
        required, supporting, forbidden = of(r.required), of(r.supporting), of(r.forbidden)
        direct = (F.size(hits) >= r.least_hits) if r.keywords else F.lit(False)
        whole = (F.size(required) == len(r.required)) if r.required else F.lit(False)
        parts = F.lit(0.0)
        if r.required:
            parts = F.size(required) / len(r.required) * (1 - SUPPORTING_SHARE if r.supporting else 1.0)
            if r.supporting:
                parts = parts + F.size(supporting) / len(r.supporting) * SUPPORTING_SHARE
        ruled_out = F.size(forbidden) > 0
        missing = F.array_except(F.array(*map(F.lit, r.required)), required) if r.required else F.array().cast("array<string>")
        hard = r.hard if r.hard is not None else r.dimension in HARD
        score = F.when(ruled_out, 0.0).when(direct, 1.0).otherwise(parts)
        columns = {"tag": F.lit(tag), "dimension": F.lit(r.dimension), "hard": F.lit(hard), "keywords": hits, "required": required, "missing": missing, "supporting": supporting, "forbidden": forbidden, "score": score.cast("double"), "passed": (direct | whole) & ~ruled_out}
        found.append(F.struct(*(c.alias(n) for n, c in columns.items())))
    return rows.select("query_id", F.inline(F.array(*found)))


def core_evidence(pairs: DataFrame, found: DataFrame, contents: DataFrame, groups: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """query_id, group_id, mode and core (the score) of pairs of a query and a group; groups: group_id, tags; found: as of tag_evidence; contents: query_id, confidence.

    A dimension of the group's tags passes if one of them does and the content is sure enough. All pass: supported; a hard one fails:
    conflicted; else unsupported. A group without tags that have rules: fallback; a query without content: rejected.
    """
    tags = groups.select("group_id", F.explode("tags").alias("tag"))
    ruled = tags.join(F.broadcast(tags.sparkSession.createDataFrame([(t, r.dimension) for t, r in TAG_RULES.items()], "tag string, dimension string")), "tag")
    sure = contents.select("query_id", (F.coalesce("confidence", F.lit(0.0)) >= least_confidence).alias("sure"))
    each = pairs.select("query_id", "group_id").join(ruled, "group_id").join(found.drop("dimension"), ["query_id", "tag"], "left")
    dims = each.groupBy("query_id", "group_id", "dimension").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.bool_or(F.coalesce("passed", F.lit(False))).alias("passed"), F.bool_or(F.coalesce("hard", F.lit(True))).alias("hard"))
    dims = dims.join(sure, "query_id", "left").withColumn("passed", F.col("passed") & F.coalesce("sure", F.lit(False)))
    told = dims.groupBy("query_id", "group_id").agg(F.avg("score").alias("core"), F.bool_and("passed").alias("all"), F.bool_or(F.col("hard") & ~F.col("passed")).alias("gate"), F.bool_or(F.col("sure").isNull()).alias("absent"))
    mode = F.when(F.col("core").isNull(), "fallback").when(F.col("absent"), "rejected").when(F.col("all"), "supported").when(F.col("gate"), "conflicted").otherwise("unsupported")
    return pairs.select("query_id", "group_id").join(told, ["query_id", "group_id"], "left").select("query_id", "group_id", mode.alias("mode"), "core")


def library_match(queries: DataFrame, contents: DataFrame, library: DataFrame, shown: DataFrame, groups: DataFrame, auto: float = 0.60, feature_auto: float = 0.75, refined: int = 16, support: float = 0.78) -> DataFrame:
    """A row per query: decision, matched asset and group, tags, scores, margin, collapsed, and up to ten candidates, best first.

    queries: query_id, query_vector, sha; contents: query_id, fields, objects, confidence; library: asset_id, group_id,
    vector, sha; shown: asset_id, objects, confidence; groups: group_id, tags.

    An asset with the query's own content decides by itself, with scores of 1. Else groups are scored by pictures, their tags' rules
    are held against the content, and the best of each kind meet what their pictures show. Candidates of one group with one content are one. The best by
    final score is taken if its final or its feature score is high enough, with all tags of its group; a
    query without any candidate is unmatched, without scores. Null contents are never exact.
    """
    exact = queries.where(F.col("sha").isNotNull()).select("query_id", "sha").join(library.select("asset_id", "group_id", "sha"), "sha")
    exact = exact.select("query_id", "group_id", "asset_id", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("feature_score"), F.lit(1.0).alias("final_score"), F.lit("exact").alias("mode"), "sha")
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    scores = checkpointed(matching.best_scored(rest.select("query_id", "query_vector"), library, support=support))
    cores = checkpointed(core_evidence(scores.select("query_id", "group_id").distinct(), tag_evidence(contents), contents, groups))
    asked = contents.select("query_id", "objects", "confidence")
    found = evidence.group_candidates(scores, cores, shown, asked, refined=refined, support=support).join(cores.select("query_id", "group_id", "mode"), ["query_id", "group_id"])
    found = found.join(library.select("asset_id", "sha"), "asset_id").select(*exact.columns)
    together = exact.unionByName(found).withColumn("same", F.coalesce(F.col("sha").cast("string"), F.concat(F.lit("asset:"), F.col("asset_id").cast("string"))))
    many = together.groupBy("query_id", "group_id", "same").agg(F.count("*").alias("n")).groupBy("query_id").agg((F.max("n") > 1).alias("collapsed"))
    one = matching.collapsed(together, "query_id", "group_id", "same").drop("same")
    # Candidates of one group: the best stands for it.
    best = matching.collapsed(one, "query_id", "group_id")
    decided = matching.decided(best, auto, feature_auto)
    labelled = decided.join(many, "query_id").join(groups.select(F.col("group_id").alias("matched_group_id"), "tags"), "matched_group_id", "left")
    out = queries.select("query_id").join(labelled, "query_id", "left")
    return out.select(
        "query_id", F.coalesce("decision", F.lit("unmatched")).alias("decision"), "matched_asset_id", "matched_group_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "similarity", "feature_score", "final_score", "margin", F.coalesce("collapsed", F.lit(False)).alias("collapsed"), F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"),
    )
