"""How far two content analyses agree: evidence of phrases, lists and mappings, and their blend over fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score, text
from . import matching
from .matching import phrase_evidence

#: What a field counts, and the confidence of an analysis that states none.
FIELD_WEIGHTS = {"scene": 0.15, "space": 0.15, "objects": 0.10, "features": 0.10}
UNSTATED_CONFIDENCE = 0.7


def concepts(phrase: Column, aliases: dict[str, list[str]]) -> Column:
    """The concepts of which an alias stands in the phrase, sorted."""
    found = [F.when(F.exists(F.array(*map(F.lit, names)), lambda a: F.contains(phrase, a)), F.lit(concept)) for concept, names in sorted(aliases.items())]
    return F.array_compact(F.array(*found))


def conflict(a: Column, b: Column, exclusive: list[tuple[str, str]]) -> Column:
    """Whether one side has a concept that excludes one of the other side's."""
    pairs = [F.array_contains(x, one) & F.array_contains(y, other) for one, other in exclusive for x, y in ((a, b), (b, a))]
    found = pairs[0]
    for p in pairs[1:]:
        found = found | p
    return found


def known_phrases(a: Column, b: Column, aliases: dict[str, list[str]], exclusive: list[tuple[str, str]]) -> Column:
    """Phrase evidence where concepts decide before letters do: shared ones count by their part of all, exclusive ones as none."""
    x, y = concepts(a, aliases), concepts(b, aliases)
    shared = F.size(F.array_intersect(x, y))
    made = lambda s, m: F.struct(s.cast("double").alias("score"), F.lit(1.0).alias("reliability"), F.lit(m).alias("method"))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), None)
        .when(a == b, made(F.lit(1.0), "exact"))
        .when(both & (shared > 0), made(shared / F.size(F.array_union(x, y)), "canonical"))
        .when(both & conflict(x, y, exclusive), made(F.lit(0.0), "canonical_conflict"))
        .otherwise(phrase_evidence(a, b))
    )


def _mean(evidence: Column) -> Column:
    """struct(score, reliability) over an array of evidence, null where there is none."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("score"), F.lit(0.0).alias("reliability"))
    add = lambda s, e: F.struct((s["n"] + 1).alias("n"), (s["score"] + e["score"]).alias("score"), (s["reliability"] + e["reliability"]).alias("reliability"))
    return F.aggregate(evidence, start, add, lambda s: F.when(s["n"] > 0, F.struct((s["score"] / s["n"]).alias("score"), (s["reliability"] / s["n"]).alias("reliability"))))


def list_evidence(xs: Column, ys: Column) -> Column:
    """struct(score, reliability) of two lists of phrases: the mean, over the shorter one, of each phrase's best evidence in the longer one."""
    clean = lambda values: F.filter(F.transform(values, text.normalized), lambda v: v != "")

    def of(sides: Column) -> Column:
        return _mean(F.filter(F.transform(sides["short"], lambda v: F.array_max(F.transform(sides["long"], lambda w: phrase_evidence(v, w)))), lambda e: e.isNotNull()))

    def ordered(sides: Column) -> Column:
        x, y = sides["x"], sides["y"]
        first = F.size(x) <= F.size(y)
        return F.struct(F.when(first, x).otherwise(y).alias("short"), F.when(first, y).otherwise(x).alias("long"))

    return text.let(text.let(F.struct(clean(xs).alias("x"), clean(ys).alias("y")), ordered), of)


def mapping_evidence(x: Column, y: Column) -> Column:
    """struct(score, reliability) of two maps of lists: the mean of the evidence of keys that both have, however they are spelt. Of keys spelt in several ways the last counts."""
    spelt = lambda m: F.filter(F.transform(F.map_entries(m), lambda e: F.struct(text.normalized(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    keys = lambda entries: F.transform(entries, lambda e: e["key"])
    last = lambda entries, key: F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"]

    def of(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        return _mean(F.filter(F.transform(F.array_intersect(keys(a), keys(b)), lambda k: list_evidence(last(a, k), last(b, k))), lambda e: e.isNotNull()))

    return text.let(F.struct(spelt(x).alias("a"), spelt(y).alias("b")), of)


def field_evidence(fields: dict[str, Column], confidence: Column, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """score, reliability and coverage over fields' evidence (struct(score, reliability) or null); without anything to compare the score is null."""
    weights = FIELD_WEIGHTS if weights is None else weights
    total = sum(weights.values())
    sure = score.clamp(F.coalesce(confidence, F.lit(UNSTATED_CONFIDENCE)))
    there = sum((F.when(e.isNotNull(), weights[n]).otherwise(0.0) for n, e in fields.items()), F.lit(0.0))
    counts = {n: F.coalesce(weights[n] * sure * e["reliability"], F.lit(0.0)) for n, e in fields.items()}
    weight = sum(counts.values(), F.lit(0.0))
    summed = sum((c * F.coalesce(fields[n]["score"], F.lit(0.0)) for n, c in counts.items()), F.lit(0.0))
    return {
        "score": F.when(weight > 0, score.clamp(summed / weight)),
        "reliability": F.when(weight > 0, score.clamp(weight / there)).otherwise(0.0),
        "coverage": score.clamp(there / total),
    }


def semantic_rank(final: Column, mode: Column, evidence: Column, bonus: float = 0.06) -> Column:
    """What candidates are ranked by: exact ones first, supported ones with a bonus for their core evidence."""
    return F.when(mode == "exact", 2.0).when(mode == "supported", final + bonus * score.clamp(F.coalesce(evidence, F.lit(0.0)))).otherwise(final)


def _agreed_turn(lines: Column, most_degrees: int, window: float) -> Column:
    """The turn that an array of lines (c, len: the correction that each wants, and its length) agrees on, or null."""
    of = lambda values: F.aggregate(values, F.lit(0.0), lambda s, e: s + e["len"])
    about = lambda values, center: F.filter(values, lambda e: F.abs(e["c"] - center) <= window)
    centers = F.array(*(F.lit(step / 2) for step in range(-2 * most_degrees, 2 * most_degrees + 1)))

    def votes(near: Column) -> Column:
        each = F.transform(centers, lambda k: text.let(about(near, k), lambda same: F.struct(F.when(F.size(same) > 0, F.round(of(same), 6)).alias("votes"), (-k).alias("against"))))
        return F.struct(near.alias("near"), (-F.array_max(each)["against"]).alias("center"))

    def told(s: Column) -> Column:
        same, weight = s["same"], s["weight"]
        mean = F.aggregate(same, F.lit(0.0), lambda x, e: x + e["c"]) / F.size(same)
        spread = text.let(mean, lambda m: F.sqrt(F.aggregate(same, F.lit(0.0), lambda x, e: x + (e["c"] - m) * (e["c"] - m)) / F.size(same)))
        start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("at"))
        half = F.round(weight / 2, 6)
        median = F.aggregate(same, start, lambda x, e: F.struct((x["run"] + e["len"]).alias("run"), F.when(x["at"].isNull() & (F.round(x["run"] + e["len"], 6) >= half), e["c"]).otherwise(x["at"]).alias("at")))["at"]
        agreed = (F.size(same) >= 4) & (weight >= 0.3 * s["total"])
        turn = text.let(-median, lambda t: F.when(F.abs(t) >= 0.5, t))
        return F.when(agreed, F.when(spread <= 0.6, turn))

    def winner(v: Column) -> Column:
        return text.let(about(v["near"], v["center"]), lambda same: text.let(F.struct(same.alias("same"), of(same).alias("weight"), of(v["near"]).alias("total")), told))

    near = F.filter(lines, lambda e: F.abs(e["c"]) <= most_degrees)
    return text.let(near, lambda x: F.when(F.size(x) >= 4, text.let(votes(x), winner)))


def skew_votes(lines: DataFrame, most_degrees: int = 5, window: float = 0.75, small_degrees: int | None = None) -> DataFrame:
    """image_id and turn of pictures that lines (image_id, dx, dy) agree are askew.

    Each line votes with its length for the corrections near its own, in steps of half a degree. Four
    lines and three tenths of the length must be near the winner and differ little; the turn is their
    weighted median, if it is half a degree or more. Ties go to the smaller correction. Lines that want at most
    small_degrees, if it is given, are asked first, and all only where those don't agree.
    A picture's lines meet once, in one array, so what finds the lines runs once.
    """
    angle = F.pmod(F.degrees(F.atan2("dy", "dx")) + 90, F.lit(180.0)) - 90
    upright = F.when(F.abs("angle") <= 45, 0).when(F.col("angle") < 0, -90).otherwise(90)
    near = lines.select("image_id", F.hypot("dx", "dy").alias("len"), angle.alias("angle")).select("image_id", "len", (upright - F.col("angle")).alias("c"))
    each = near.where((F.abs("c") <= most_degrees) & F.col("image_id").isNotNull()).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "len"))).alias("of"))
    turn = _agreed_turn(F.col("of"), most_degrees, window)
    if small_degrees is not None and small_degrees < most_degrees:
        turn = F.coalesce(_agreed_turn(F.col("of"), small_degrees, window), turn)
    return each.select("image_id", turn.alias("turn")).where(F.col("turn").isNotNull())


def group_candidates(scores: DataFrame, cores: DataFrame, contents: DataFrame, asked: DataFrame, refined: int = 16, best_of: int = 3, support: float = 0.78) -> DataFrame:
    """query_id, group_id, asset_id, similarity, support, feature_score, final_score, ranking: groups by their pictures, and the best of each kind by their content too.

    scores: query_id, asset_id, group_id, similarity; cores: query_id, group_id, mode, core (the evidence
    of the group's rules); contents: asset_id, objects, confidence; asked: query_id, objects, confidence.
    Only the `refined` best groups of each query that its rules support, and as many of those without
    rules that tell, meet its content: what the group's `best_of` best pictures show, equal contents once.
    Other groups have no feature score and the picture's score as their final one.
    """
    order = Window.partitionBy("query_id", "group_id").orderBy(F.desc("similarity"), F.desc("asset_id"))
    groups = matching.group_scores(scores, support=support).join(cores, ["query_id", "group_id"])
    kind = Window.partitionBy("query_id", "mode").orderBy(F.desc("similarity"), F.desc("asset_id"))
    chosen = groups.where(F.col("mode").isin("supported", "fallback")).withColumn("n", F.row_number().over(kind)).where(F.col("n") <= refined).select("query_id", "group_id")
    top = scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= best_of).join(chosen, ["query_id", "group_id"], "left_semi")
    shown = top.select("query_id", "group_id", "asset_id", "n").join(contents, "asset_id").groupBy("query_id", "group_id", "objects", "confidence").agg(F.min("n").alias("n"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "objects"))), lambda e: e["objects"]))
    merged = shown.groupBy("query_id", "group_id").agg(text.string_list(listed, (1 << 31) - 1).alias("ys"), F.avg("confidence").alias("of_group"))
    met = merged.join(asked.select("query_id", F.col("objects").alias("xs"), F.col("confidence").alias("of_query")), "query_id")
    found = field_evidence({"objects": list_evidence(F.col("xs"), F.col("ys"))}, F.least("of_query", "of_group"))
    told = met.select("query_id", "group_id", found["score"].alias("feature_score"), found["reliability"].alias("reliability"), found["coverage"].alias("coverage"))
    rows = groups.join(told, ["query_id", "group_id"], "left")
    final, _ = score.blended(F.col("similarity"), F.col("feature_score"), F.coalesce("reliability", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0)))
    rows = rows.withColumn("final_score", final)
    return rows.withColumn("ranking", semantic_rank(F.col("final_score"), F.col("mode"), F.col("core"))).select("query_id", "group_id", "asset_id", "similarity", "support", "feature_score", "final_score", "ranking")


def standard_selection(answers: DataFrame, evaluations: DataFrame, standards: DataFrame) -> DataFrame:
    """image_id, selected, error: which standard (small table: standard_id, fallback) each answer comes to.

    answers: image_id, selected_id; evaluations: image_id, standard_id, matched. A named standard goes
    before all, but must be one of those given. Without it the only match counts, then the fallback. Two
    matches, a match beside a matched fallback, nothing to take, or two fallbacks are errors, without a
    selection.
    """
    known = standards.agg(F.collect_set("standard_id").alias("known"), F.max(F.when(F.col("fallback"), F.col("standard_id"))).alias("fallback"), F.count_if("fallback").alias("fallbacks"))
    of = evaluations.crossJoin(F.broadcast(known.select("fallback")))
    specific = F.col("matched") & ~F.col("standard_id").eqNullSafe(F.col("fallback"))
    hits = of.groupBy("image_id").agg(
        F.count_if(specific).alias("hits"), F.max(F.when(specific, F.col("standard_id"))).alias("hit"), F.coalesce(F.bool_or(F.col("matched") & (F.col("standard_id") == F.col("fallback"))), F.lit(False)).alias("also")
    )
    rows = answers.join(hits, "image_id", "left").crossJoin(F.broadcast(known)).withColumns({"hits": F.coalesce("hits", F.lit(0)), "also": F.coalesce("also", F.lit(False))})
    named = F.col("selected_id").isNotNull()
    error = (
        F.when(F.col("fallbacks") > 1, "fallbacks")
        .when(named & ~F.array_contains("known", F.col("selected_id")), "foreign")
        .when(named, None)
        .when((F.col("hits") > 1) | ((F.col("hits") == 1) & F.col("also")), "ambiguous")
        .when((F.col("hits") == 0) & F.col("fallback").isNull(), "none")
    )
    taken = F.coalesce("selected_id", F.when(F.col("hits") == 1, F.col("hit")).otherwise(F.col("fallback")))
    return rows.withColumn("error", error).select("image_id", F.when(F.col("error").isNull(), taken).alias("selected"), "error")
