"""Instructions in plain language compiled to a configuration: ordered rules over a text column, each a set of words that must stand in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """value, if one of the words stands in the text and none of `without` does."""

    value: object
    words: tuple[str, ...]
    without: tuple[str, ...] = ()


#: 本店 stands for the brand and 小标 for its mascot: names of one's own go in their place.
#: The words of each rule; of a field's rules the first that holds counts, else its default.
NAMED = {"watermark": ("水印",), "logo": ("LOGO", "标志"), "ground": ("地膜", "保护膜")}
ALLOWED = Rule(True, ("允许通过", "允许筛选", "不作为不合格", "放行"))
AFTERWARDS = (Rule("keep", ("保留水印", "不去除水印", "无需去除")), Rule("remove", ("去除", "消除", "移除")))
LOGO_ACTIONS = (Rule("mosaic", ("马赛克",), ("小标",)), Rule("overlay_asset", ("小标", "图标遮挡", "图标覆盖")))
ANY_BRAND = Rule("任意第三方品牌Logo识别尚未配置训练模型", ("任意品牌", "所有品牌", "第三方品牌"))
BAD_SHARE = "地膜占比阈值必须在5%到98%之间"
LEAST_SHARE, LARGEST_SHARE, USUAL_SHARE = 0.05, 0.98, 0.75
#: Sentences of the description.
SENTENCES = {
    "allowed": "左下角拍摄水印允许通过筛选",
    "not allowed": "按普通规则审核水印",
    "removed": "通过后去除左下角水印",
    "not removed": "不执行水印去除",
    "covered": "保留“本店”，仅使用小标图标遮挡APP字样",
    "mosaic": "目标Logo使用马赛克遮挡",
    "no logo": "不处理Logo",
    "no share": "不执行品牌地膜占比筛选",
}
SHARE_SENTENCE = ("本店品牌地膜占比达到", "判定不合格")


def stands(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def holds(text: Column, rule: Rule) -> Column:
    return stands(text, rule.words) & ~stands(text, rule.without)


def first_of(text: Column, rules: tuple[Rule, ...], default: object) -> Column:
    out = F.when(holds(text, rules[0]), F.lit(rules[0].value))
    for r in rules[1:]:
        out = out.when(holds(text, r), F.lit(r.value))
    return out.otherwise(F.lit(default))


def compiled(instruction: Column) -> Column:
    """watermark, logo, ground (structs), description and unsupported (what the text asks for that there is no way to do) of an instruction.

    The last percentage is the share of a picture from which ground film is rejected; one out of bounds is unsupported and leaves the usual
    share. What a text doesn't name is off. A null text is an empty one.
    """
    text = F.trim(F.coalesce(instruction, F.lit("")))
    shares = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1))
    share = F.try_element_at(F.transform(shares, lambda s: s.cast("double")), F.lit(-1)) / 100
    told = F.size(shares) > 0
    fits = F.coalesce(share.between(LEAST_SHARE, LARGEST_SHARE), F.lit(False))
    threshold = F.when(fits, share).otherwise(F.lit(USUAL_SHARE))
    marked = stands(text, NAMED["watermark"])
    allowed = F.when(marked, holds(text, ALLOWED)).otherwise(F.lit(True))
    after = F.when(marked, first_of(text, AFTERWARDS, "remove")).otherwise(F.lit("remove"))
    with_logo = stands(F.upper(text), NAMED["logo"])
    action = F.when(with_logo, first_of(text, LOGO_ACTIONS, "overlay_asset")).otherwise(F.lit("overlay_asset"))
    film = stands(text, NAMED["ground"])
    says = {k: F.lit(v) for k, v in SENTENCES.items()}
    percent = F.concat(F.lit(SHARE_SENTENCE[0]), F.rint(threshold * 100).cast("int").cast("string"), F.lit("%"), F.lit(SHARE_SENTENCE[1]))
    sentences = (
        F.when(allowed, says["allowed"]).otherwise(says["not allowed"]),
        F.when(marked & (after == "remove"), says["removed"]).otherwise(says["not removed"]),
        F.when(~with_logo, says["no logo"]).when(action == "overlay_asset", says["covered"]).otherwise(says["mosaic"]),
        F.when(film, percent).otherwise(says["no share"]),
    )
    return F.struct(
        F.struct(marked.alias("enabled"), allowed.alias("allow_during_filter"), after.alias("post_action")).alias("watermark"),
        F.struct(with_logo.alias("enabled"), action.alias("action")).alias("logo"),
        F.struct(film.alias("enabled"), threshold.alias("reject_coverage_gte")).alias("ground"),
        F.concat_ws("；", *sentences).alias("description"),
        F.array_compact(F.array(F.when(told & ~fits, F.lit(BAD_SHARE)), F.when(holds(text, ANY_BRAND), F.lit(ANY_BRAND.value)))).alias("unsupported"),
    )
