"""Scores and policies as column arithmetic; every threshold is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(high)), x.cast("double")))


def technical_quality(sharpness: Column, exposure: Column, contrast: Column, noise: Column) -> Column:
    """The weighted geometric mean of four measures of 0 to 100."""
    parts = ((sharpness, 0.38), (exposure, 0.34), (contrast, 0.13), (noise, 0.15))
    return clamp(100.0 * reduce(lambda a, b: a * b, (F.pow(x.cast("double") / 100.0, F.lit(w)) for x, w in parts)), 100)


def sharpness(edge_variance: Column, reference: float = 250.0) -> Column:
    return clamp(edge_variance / reference * 100.0, 100)


def exposure(brightness: Column, shadow: Column, highlight: Column, brightness_penalty: float = 25.0, clipping_penalty: float = 45.0) -> Column:
    return clamp(100.0 - F.abs(brightness - 128.0) / 128.0 * brightness_penalty - F.greatest(shadow, highlight) * clipping_penalty, 100)


def contrast(stddev: Column, low: float = 10.0, high: float = 64.0) -> Column:
    return clamp((stddev - low) / (high - low) * 100.0, 100)


def noise(residual: Column, penalty: float = 1.5) -> Column:
    return clamp(100.0 - residual * penalty, 100)


def cover_score(completeness: Column, composition: Column, appeal: Column, representative: Column, hard_fail: Column, technical: Column) -> Column:
    """Three quarters of the rubric and one of the technical score, capped by the lowest rating."""
    technical = clamp(technical, 100)
    rubric = 20.0 * (completeness * 0.30 + composition * 0.30 + appeal * 0.25 + representative * 0.15)
    raw = rubric * 0.75 + technical * 0.25
    lowest = F.least(completeness, composition, appeal, representative)
    cap = F.when(hard_fail | (lowest <= 2), 79.99).when(lowest == 3, 89.99).when((lowest == 4) | (technical < 80), 94.99).otherwise(100.0)
    return clamp(F.least(raw, cap), 100)


def blended(similarity: Column, feature: Column, reliability: Column, coverage: Column, low: float = 0.0, high: float = 0.30) -> tuple[Column, Column]:
    """The final score and the weight of content in it; without a content score it is the image's."""
    weight = F.when(feature.isNull(), 0.0).otherwise(low + (max(low, high) - low) * clamp(reliability) * clamp(coverage))
    return clamp(clamp(similarity) * (1.0 - weight) + F.coalesce(clamp(feature), F.lit(0.0)) * weight), weight


def fixed_blend(similarity: Column, feature: Column, image_weight: float = 0.70, feature_weight: float = 0.30) -> Column:
    total = image_weight + feature_weight
    if total <= 0:
        return clamp(similarity)
    return F.when(feature.isNull(), clamp(similarity)).otherwise(clamp((similarity * image_weight + feature * feature_weight) / total))


def matched(final: Column, feature: Column, auto: float = 0.60, feature_auto: float = 0.75) -> Column:
    return (final >= auto) | F.coalesce(feature >= feature_auto, F.lit(False))


def terminal_status(total: Column, failed: Column) -> Column:
    return F.when((total > 0) & (failed >= total), "failed").when(failed > 0, "partial_failed").otherwise("completed")


def ground_film(detected: Column, brand: Column, coverage: Column, confidence: Column, least_confidence: float = 0.8, reject_from: float = 0.75, margin: float = 0.05) -> Column:
    """reject, review or pass."""
    return (
        F.when(~detected | ~brand, "pass")
        .when(confidence < least_confidence, "review")
        .when(coverage >= reject_from, "reject")
        .when(coverage >= max(0.0, reject_from - margin), "review")
        .otherwise("pass")
    )


def completion(real: Column, indoor: Column, assessable: Column, clean: Column, finished: Column, evidence: Column, usable: Column) -> tuple[Column, Column, Column]:
    """Label, subtype and reason codes from seven facts."""
    valid, ready = real & indoor, clean & finished & evidence & usable
    label = F.when(valid & assessable & ready, "completed").otherwise("non_completed")
    subtype = F.when(~valid, "invalid_or_irrelevant").when(~assessable, "insufficient_evidence").when(ready, "completed").otherwise("construction")
    building = valid & assessable & ~ready
    codes = (
        (~real, "NOT_REAL_PHOTO"),
        (~indoor, "NOT_INDOOR_SPACE"),
        (valid & ~assessable, "IMAGE_NOT_ASSESSABLE"),
        (valid & ~assessable, "INSUFFICIENT_VIEW_SCOPE"),
        (valid & assessable & ready, "HARD_FINISH_COMPLETE"),
        (valid & assessable & ready, "FINISHED_SPACE_VISIBLE"),
        (building & ~clean, "VISIBLE_CONSTRUCTION"),
        (building & ~finished, "HARD_FINISH_INCOMPLETE"),
        (building & ~evidence, "FINISHED_SPACE_EVIDENCE_MISSING"),
        (building & ~usable, "NOT_USABLE_OR_DISPLAY_READY"),
    )
    return label, subtype, F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in codes)))


def acceptance(before: dict[str, Column], after: dict[str, Column]) -> dict[str, Column]:
    """Whether exposure, colour, noise and sharpening of a retouched picture are acceptable."""
    return {
        "exposure": (after["highlight"] <= F.greatest(F.lit(0.04), before["highlight"] + 0.02)) & (after["shadow"] <= F.greatest(F.lit(0.07), before["shadow"] + 0.03)) & after["brightness"].between(30, 225),
        "color": (after["saturation"] <= F.greatest(F.lit(185.0), before["saturation"] * 1.4 + 10)) & (after["cast"] <= F.greatest(F.lit(38.0), before["cast"] + 10)),
        "noise": after["noise"] <= F.greatest(before["noise"] * 1.25, before["noise"] + 2),
        "sharpening": after["edges"] <= F.greatest(before["edges"] * 2.4, before["edges"] + 80),
    }


def automatic_match(mode: Column, score: Column, margin: Column, support: Column, feature: Column, strength: Column, auto: float = 0.60, unsupported: float = 0.80, fallback: float = 0.75, least_margin: float = 0.0, fallback_margin: float = 0.04, fallback_support: int = 2, fallback_feature: float = 0.5, fallback_strength: float = 0.2) -> Column:
    """Whether a calibrated decision may be automatic, by the mode of its evidence."""
    gated = (score >= fallback) & (margin >= fallback_margin) & (support >= fallback_support) & F.coalesce(feature >= fallback_feature, F.lit(False)) & (F.coalesce(strength, F.lit(0.0)) >= fallback_strength)
    return F.when(mode == "conflicted", False).when(mode == "unsupported", (score >= unsupported) & (margin >= least_margin)).when(mode != "fallback", (score >= auto) & (margin >= least_margin)).otherwise(gated)
