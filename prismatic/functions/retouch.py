"""Policies for retouching plans: clamps before, one correction after a preview, and the way back to neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The neutral plan.
NEUTRAL = {"brightness": 1.0, "contrast": 1.0, "color": 1.0, "sharpness": 1.0, "highlight_recovery": 0.0, "shadow_lift": 0.0, "local_tone": 0.0, "denoise": 0.0, "clarity": 0.0, "white_balance": 0.0}

Plan = dict[str, Column]


def clamped(plan: Plan) -> Plan:
    """The plan with what would harm the picture held back: highlights protected where it gets brighter, contrast where shadows or local tone are lifted, sharpness where noise is smoothed."""
    recovery = F.least(F.lit(0.35), F.greatest(F.lit(0.1), (plan["brightness"] - 1) * 1.25))
    protects = (plan["brightness"] >= 1.08) & (plan["highlight_recovery"] < recovery)
    limit = F.when((plan["shadow_lift"] >= 0.18) | (plan["local_tone"] >= 0.25), 1.08).otherwise(1.5)
    smooth = plan["denoise"] >= 0.25
    return plan | {
        "highlight_recovery": F.when(protects, F.round(recovery, 3)).otherwise(plan["highlight_recovery"]),
        "contrast": F.least(plan["contrast"], limit),
        "sharpness": F.when(smooth, F.least(plan["sharpness"], F.lit(1.15))).otherwise(plan["sharpness"]),
        "clarity": F.when(smooth, F.least(plan["clarity"], F.lit(0.18))).otherwise(plan["clarity"]),
    }


def corrected(plan: Plan, passed: dict[str, Column]) -> Plan:
    """The plan after a preview: each failed check bounds what can have caused it."""
    failed = {name: ~ok for name, ok in passed.items()}
    cap = lambda when, name, most: F.when(when, F.least(plan[name], F.lit(most))).otherwise(plan[name])
    raise_to = lambda when, name, least: F.when(when, F.greatest(plan[name], F.lit(least))).otherwise(plan[name])
    smoother = F.when(failed["noise"], F.least(plan["clarity"], F.lit(0.12))).otherwise(plan["clarity"])
    return plan | {
        "brightness": cap(failed["exposure"], "brightness", 1.03),
        "highlight_recovery": raise_to(failed["exposure"], "highlight_recovery", 0.22),
        "color": cap(failed["color"], "color", 1.05),
        "white_balance": cap(failed["color"], "white_balance", 0.2),
        "denoise": raise_to(failed["noise"], "denoise", 0.12),
        "sharpness": cap(failed["sharpening"], "sharpness", 1.05),
        "clarity": F.when(failed["sharpening"], F.least(smoother, F.lit(0.1))).otherwise(smoother),
    }


def outcome(needed: Column, preview: Column, again: Column, final: Column) -> Column:
    """neutral (none asked for), planned or corrected, or the fallback to neutral after a second preview or the final check failed."""
    return F.when(~needed, "neutral").when(~preview & ~again, "preview_fallback").when(~final, "final_fallback").when(preview, "planned").otherwise("corrected")
