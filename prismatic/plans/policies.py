"""Queries of instructions in plain language and of contracts that answers must fulfil."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instructions as rules
from ..operators import contracts
from ..operators.contracts import Node
from .registry import query, table

#: Parts that instructions are put together from, each with the divisor and remainder of the key that it goes with.
PARTS = (
    ("左下角水印", 3, (0, 1)),
    ("允许通过筛选，", 4, (0,)),
    ("放行，", 5, (2,)),
    ("保留水印；", 7, (1,)),
    ("自动去除。", 2, (0,)),
    ("保留本店文字，", 6, (3,)),
    ("Logo", 4, (0, 3)),
    ("使用马赛克", 5, (0, 1)),
    ("使用小标图标遮挡APP。", 3, (2,)),
    ("支持所有品牌。", 11, (4,)),
)


def _instruction_sql() -> str:
    parts = [f"CASE WHEN p_partkey % {d} IN ({', '.join(map(str, r))}) THEN '{w}' ELSE '' END" for w, d, r in PARTS]
    return " || ".join([*parts, "CASE WHEN p_partkey % 3 <> 1 THEN '地膜占比大于等于' || (p_partkey * 7 % 110) || CASE WHEN p_partkey % 4 = 1 THEN '.5' ELSE '' END || '%时不合格' ELSE '' END"])


def _any(words: tuple[str, ...], of: str = "t") -> str:
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"


_SHARE = "CASE WHEN len(shares) > 0 THEN shares[-1]::DOUBLE / 100 END"
_S = rules.SENTENCES


@query(
    "k19_compiled_instructions",
    f"""WITH i AS (SELECT p_partkey AS id, {_instruction_sql()} AS t FROM part),
    s AS (SELECT *, regexp_extract_all(t, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS shares FROM i),
    c AS (SELECT id, t, {_SHARE} AS share, coalesce({_SHARE} BETWEEN 0.05 AND 0.98, false) AS fits, contains(t, '水印') AS marked, {_any(('LOGO', '标志'), 'upper(t)')} AS with_logo, {_any(('地膜', '保护膜'))} AS film FROM s),
    f AS (SELECT *, CASE WHEN fits THEN share ELSE 0.75 END AS threshold, NOT marked OR {_any(rules.ALLOWED.words)} AS allowed,
      CASE WHEN marked AND {_any(rules.AFTERWARDS[0].words)} THEN 'keep' ELSE 'remove' END AS after,
      CASE WHEN with_logo AND contains(t, '马赛克') AND NOT contains(t, '小标') THEN 'mosaic' ELSE 'overlay_asset' END AS action FROM c)
    SELECT id, marked AS watermark, allowed, after, with_logo AS logo, action, film, threshold,
      concat_ws('；', CASE WHEN allowed THEN '{_S["allowed"]}' ELSE '{_S["not allowed"]}' END, CASE WHEN marked AND after = 'remove' THEN '{_S["removed"]}' ELSE '{_S["not removed"]}' END,
        CASE WHEN NOT with_logo THEN '{_S["no logo"]}' WHEN action = 'mosaic' THEN '{_S["mosaic"]}' ELSE '{_S["covered"]}' END,
        CASE WHEN film THEN '{rules.SHARE_SENTENCE[0]}' || round_even(threshold * 100, 0)::INTEGER || '%{rules.SHARE_SENTENCE[1]}' ELSE '{_S["no share"]}' END) AS description,
      (share IS NOT NULL AND NOT fits)::BIGINT + {_any(rules.ANY_BRAND.words)}::BIGINT AS unsupported FROM f""",
)
def compiled_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions put together by the key of each part, and the configuration that each compiles to."""
    k = F.col("p_partkey")
    words = [F.when((k % d).isin(*r), F.lit(w)).otherwise("") for w, d, r in PARTS]
    share = F.when(k % 3 != 1, F.concat(F.lit("地膜占比大于等于"), (k * 7 % 110).cast("string"), F.when(k % 4 == 1, ".5").otherwise(""), F.lit("%时不合格"))).otherwise("")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), rules.compiled(F.concat(*words, share)).alias("c"))
    c = F.col("c")
    fields = {"watermark": c["watermark"]["enabled"], "allowed": c["watermark"]["allow_during_filter"], "after": c["watermark"]["post_action"], "logo": c["logo"]["enabled"], "action": c["logo"]["action"], "film": c["ground"]["enabled"]}
    return rows.select("id", *(v.alias(n) for n, v in fields.items()), c["ground"]["reject_coverage_gte"].alias("threshold"), c["description"].alias("description"), F.size(c["unsupported"]).cast("long").alias("unsupported"))


#: What an answer must be like.
ANSWER = Node(
    "object",
    {
        "decision": Node("string", among=("pass", "reject")),
        "score": Node("number", least=0, most=100),
        "item": Node("object", {"id": Node("integer"), "name": Node("string", least=1, most=20)}),
        "tags": Node("array", item=Node("string"), most=3),
        "note": Node("string", nullable=True),
    },
)
_ANSWER = """CASE WHEN event_id % 23 = 0 THEN '{"decision": ' ELSE '{"decision":"' || CASE WHEN event_id % 13 = 0 THEN 'maybe' ELSE 'pass' END || '","score":' || CASE WHEN event_id % 11 = 0 THEN '"high"' ELSE (event_id % 120)::VARCHAR END
  || ',"item":{"id":' || event_id || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"name":"n"' END || CASE WHEN event_id % 5 = 0 THEN ',"more":1' ELSE '' END || '},"tags":["a",' || CASE WHEN event_id % 17 = 0 THEN '1' ELSE '"b"' END || ']'
  || CASE WHEN event_id % 19 = 0 THEN '' ELSE ',"note":null' END || '}' END"""


@query(
    "m6_contract_faults",
    f"""WITH a AS (SELECT event_id, {_ANSWER} AS answer FROM events), v AS (SELECT *, json_valid(answer) AS good FROM a),
    j AS (SELECT event_id, good, CASE WHEN good THEN answer::JSON END AS j FROM v)
    SELECT event_id, (NOT good)::BIGINT AS json,
      coalesce(len(list_filter(['decision', 'score', 'item', 'tags', 'note'], lambda f: NOT list_contains(json_keys(j), f))) + len(list_filter(['id', 'name'], lambda f: NOT list_contains(json_keys(j, '$.item'), f))), 0)::BIGINT AS missing,
      coalesce(len(list_filter(json_keys(j, '$.item'), lambda f: f NOT IN ('id', 'name'))), 0)::BIGINT AS unknown,
      coalesce((json_type(j, '$.score') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))::BIGINT + len(list_filter(json_type(j, ['$.tags[0]', '$.tags[1]']), lambda t: t <> 'VARCHAR')), 0)::BIGINT AS type,
      coalesce((json_extract_string(j, '$.decision') NOT IN ('pass', 'reject'))::BIGINT + (CASE WHEN json_type(j, '$.score') = 'VARCHAR' THEN 0 ELSE (json_extract(j, '$.score')::DOUBLE > 100)::BIGINT END), 0)::BIGINT AS range
    FROM j""",
)
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of fault is in an answer that is recorded for each event."""
    n = F.col("event_id")
    lit = lambda x: F.lit(x)
    whole = F.concat(
        lit('{"decision":"'), F.when(n % 13 == 0, "maybe").otherwise("pass"), lit('","score":'), F.when(n % 11 == 0, lit('"high"')).otherwise((n % 120).cast("string")),
        lit(',"item":{"id":'), n.cast("string"), F.when(n % 7 == 0, "").otherwise(',"name":"n"'), F.when(n % 5 == 0, ',"more":1').otherwise(""), lit('},"tags":["a",'), F.when(n % 17 == 0, "1").otherwise('"b"'), lit("]"),
        F.when(n % 19 == 0, "").otherwise(',"note":null'), lit("}"),
    )
    answers = table(spark, sf_dir, "events").select("event_id", F.when(n % 23 == 0, lit('{"decision": ')).otherwise(whole).alias("answer"))
    found = contracts.checked(answers, "answer", ANSWER)
    return found.select("event_id", *(c.alias(name) for name, c in contracts.fault_counts(F.col("faults")).items()))
