"""Instructions against what they say, and answers against a contract."""

import json

import pytest
from pyspark.sql import functions as F

from prismatic.functions.instructions import compiled
from prismatic.operators.contracts import Node, checked, json_schema, violations
from prismatic.plans.policies import ANSWER


def config(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(compiled(F.col("t")).alias("c")).first()["c"]


def test_the_confirmed_instruction(spark):
    c = config(spark, "图片左下角水印允许通过筛选，通过后自动去除。\n保留本店文字，仅使用小标图标遮挡APP。\n本店APP品牌地膜占整张图片大于等于75%时判定不合格。")
    assert c["unsupported"] == [] and c["watermark"].asDict() == {"enabled": True, "allow_during_filter": True, "post_action": "remove"}
    assert c["logo"]["action"] == "overlay_asset" and c["ground"].asDict() == {"enabled": True, "reject_coverage_gte": 0.75}
    assert c["description"].split("；")[3] == "本店品牌地膜占比达到75%判定不合格"


@pytest.mark.parametrize(
    ("text", "watermark", "logo", "ground", "unsupported"),
    [
        (None, (False, True, "remove"), (False, "overlay_asset"), (False, 0.75), 0),
        ("", (False, True, "remove"), (False, "overlay_asset"), (False, 0.75), 0),
        ("水印", (True, False, "remove"), (False, "overlay_asset"), (False, 0.75), 0),
        ("保留水印，不要去除", (True, False, "keep"), (False, "overlay_asset"), (False, 0.75), 0),
        ("水印放行并消除", (True, True, "remove"), (False, "overlay_asset"), (False, 0.75), 0),
        ("去除", (False, True, "remove"), (False, "overlay_asset"), (False, 0.75), 0),
        ("logo马赛克", (False, True, "remove"), (True, "mosaic"), (False, 0.75), 0),
        ("标志用马赛克或小标", (False, True, "remove"), (True, "overlay_asset"), (False, 0.75), 0),
        ("保护膜 60% 到 80.5 %", (False, True, "remove"), (False, "overlay_asset"), (True, 0.805), 0),
        ("地膜99%", (False, True, "remove"), (False, "overlay_asset"), (True, 0.75), 1),
        ("地膜4%，所有品牌", (False, True, "remove"), (False, "overlay_asset"), (True, 0.75), 2),
    ],
)
def test_single_rules(spark, text, watermark, logo, ground, unsupported):
    c = config(spark, text)
    assert tuple(c["watermark"]) == watermark and tuple(c["logo"]) == logo and len(c["unsupported"]) == unsupported
    assert c["ground"]["enabled"] == ground[0] and c["ground"]["reject_coverage_gte"] == pytest.approx(ground[1])


GOOD = {"decision": "pass", "score": 5, "item": {"id": 1, "name": "n"}, "tags": ["a"], "note": None}


@pytest.mark.parametrize(
    ("change", "faults"),
    [
        ({}, []),
        ({"score": 5.5, "note": "x"}, []),
        ({"score": True}, [("$.score", "type")]),
        ({"score": -1}, [("$.score", "range")]),
        ({"item": {"id": 1.0, "name": ""}}, [("$.item.name", "range")]),
        ({"item": {"id": 1.5}}, [("$.item.id", "type"), ("$.item.name", "missing")]),
        ({"item": None}, [("$.item", "type")]),
        ({"tags": ["a", 1, None, "b"]}, [("$.tags", "range"), ("$.tags[1]", "type"), ("$.tags[2]", "type")]),
        ({"extra": 1, "decision": "no"}, [("$.decision", "range"), ("$.extra", "unknown")]),
    ],
)
def test_faults_by_path(change, faults):
    assert sorted(violations(GOOD | change, ANSWER)) == faults


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "{"), (3, None), (4, "[]"), (5, '{"score": NaN}'), (6, "[" * 100_000)], "id int, answer string")
    found = {r["id"]: [tuple(f) for f in r["faults"]] for r in checked(rows, "answer", ANSWER).collect()}
    assert found == {1: [], 2: [("$", "json")], 3: [("$", "json")], 4: [("$", "type")], 5: [("$", "json")], 6: [("$", "json")]}


def test_the_schema_is_strict():
    schema = json_schema(ANSWER)
    assert schema["additionalProperties"] is False and schema["required"] == list(ANSWER.fields) and schema["properties"]["note"]["type"] == ["string", "null"]
    assert json_schema(Node("array", item=Node("string", least=1), most=3)) == {"type": "array", "maxItems": 3, "items": {"type": "string", "minLength": 1}}
