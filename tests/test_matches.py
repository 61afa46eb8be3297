"""Tag rules and the whole library match against loops over plain lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.functions.library_rules import CONCEPTS, HARD, TAG_RULES, TagRule
from prismatic.operators import matching, tag_rules

THINGS = ("plank", "cotton", "dusk", "ember", "flint", "grove", "hinge")


def findings(fields):
    out = {}
    for tag, r in TAG_RULES.items():
        text = "\n".join(v for name in r.fields for v in fields.get(name, [])).lower()
        there = lambda c: any(n in text for n in CONCEPTS[c].split())  # noqa: B023, E731
        hits = [k for k in r.keywords if k in text]
        must, may, mustnot = ([c for c in x if there(c)] for x in (r.required, r.supporting, r.forbidden))
        score = len(must) / len(r.required) * (0.85 if r.supporting else 1.0) + (len(may) / len(r.supporting) * 0.15 if r.supporting else 0)
        score = 0.0 if mustnot else 1.0 if hits else score
        out[tag] = (set(hits), score, (bool(hits) or len(must) == len(r.required)) and not mustnot)
    return out


def contents(seed, n):
    rng = random.Random(seed)
    words = [w for names in CONCEPTS.values() for w in names.split()] + [k for r in TAG_RULES.values() for k in r.keywords]
    return {q: {name: rng.choices(words, k=rng.randrange(0, 4)) for name in ("space", "scene", "subjects", "objects", "condition", "features", "content_type", "ocr_text")} for q in range(n)}


KIND = "query_id long, fields map<string,array<string>>, objects array<string>, confidence double"


def test_what_contents_say_about_tags(spark):
    fields = contents(1, 40)
    rows = [(q, f, [], 0.5) for q, f in fields.items()] + [(100, None, None, None), (101, {"scene": None}, [], 0.1)]
    found = tag_rules.tag_evidence(spark.createDataFrame(rows, KIND)).collect()
    assert len(found) == len(rows) * len(TAG_RULES)
    for r in found:
        hits, score, passed = findings(fields.get(r["query_id"], {}))[r["tag"]]
        assert (set(r["keywords"]), r["passed"]) == (hits, passed) and r["score"] == pytest.approx(score)
        assert set(r["missing"]) == set(TAG_RULES[r["tag"]].required) - set(r["required"])


def test_a_rule_of_ones_own(spark):
    rules = {"x": TagRule("stage", ("scene",), ("Two", "one"), (), least_hits=2, hard=True), "y": TagRule("stage", ("scene",), (), ("none",))}
    found = {(r["query_id"], r["tag"]): r for r in tag_rules.tag_evidence(spark.createDataFrame([(1, {"scene": ["ONE two"]}, [], 1.0), (2, {"scene": ["one one"]}, [], 1.0)], KIND), rules, {}).collect()}
    assert found[1, "x"]["passed"] and not found[2, "x"]["passed"] and found[2, "x"]["score"] == 0 and found[1, "x"]["hard"] and not found[1, "y"]["passed"]


def mode_of(fields, confidence, tags):
    dims = {}
    for t in tags:
        if t in TAG_RULES:
            dims.setdefault(TAG_RULES[t].dimension, []).append(t)
    if not dims:
        return "fallback", None
    if fields is None:
        return "rejected", 0.0
    told = findings(fields)
    score = {d: max(told[t][1] for t in ts) for d, ts in dims.items()}
    passed = {d: any(told[t][2] for t in ts) and confidence >= 0.6 for d, ts in dims.items()}
    mode = "supported" if all(passed.values()) else "conflicted" if any(not p and d in HARD for d, p in passed.items()) else "unsupported"
    return mode, sum(score.values()) / len(score)


def plain_match(queries, fields, asked, library, shown, groups, auto, refined, support):
    out = {}
    for q, (vector, sha) in queries.items():
        found = [(1.0, 1.0, a, g, s) for a, (g, _, s) in library.items() if sha is not None and s == sha]
        found = [{"group": g, "asset": a, "sim": 1.0, "feature": 1.0, "final": 1.0, "sha": s} for _, _, a, g, s in found]
        if not found:
            sims = {a: min(1.0, max(0.0, float(np.dot(vector, v)))) for a, (_, v, _) in library.items()}
            rows = []
            for g, tags in groups.items():
                best = sorted(((sims[a], a) for a, (of, _, _) in library.items() if of == g), reverse=True)
                if best:
                    rows.append({"group": g, "asset": best[0][1], "sim": 0.65 * best[0][0] + 0.35 * np.mean([s for s, _ in best[:3]]), "top": [a for _, a in best[:3]], "mode": mode_of(fields.get(q), asked.get(q, (None, 0))[1], tags)[0]})
            for r in rows:
                r["feature"], r["final"], r["sha"] = None, r["sim"], library[r["asset"]][2]
            for mode in ("supported", "fallback"):
                for r in sorted((r for r in rows if r["mode"] == mode), key=lambda r: (-r["sim"], -r["asset"]))[:refined]:
                    if q not in asked:
                        continue
                    seen = list(dict.fromkeys((tuple(shown[a][0]), shown[a][1]) for a in r["top"] if a in shown))
                    if not seen:
                        continue
                    ys, xs = list(dict.fromkeys(w for o, _ in seen for w in o)), list(asked[q][0])
                    few, many = (xs, ys) if len(xs) <= len(ys) else (ys, xs)
                    hit = [w in many for w in few]
                    s, rel = np.mean([1.0 if h else 0.5 for h in hit]), np.mean(hit)
                    c = min(asked[q][1], np.mean([c for _, c in seen]))
                    if rel > 0:
                        weight = 0.30 * c * rel * 0.2
                        r["feature"], r["final"] = s, r["sim"] * (1 - weight) + s * weight
            found = rows
        same = {}
        for r in found:
            same.setdefault((r["group"], r["sha"] if r["sha"] is not None else f"asset {r['asset']}"), []).append(r)
        order = lambda r: (r["final"], r["sim"], r["asset"])
        by_group = {}
        for rs in same.values():
            b = max(rs, key=order)
            by_group[b["group"]] = max(by_group.get(b["group"], b), b, key=order)
        ranked = sorted(by_group.values(), key=lambda r: (-r["final"], -r["sim"], r["asset"]))
        if not ranked:
            out[q] = ("unmatched", None, None, [], None, None, False, [])
            continue
        b = ranked[0]
        good = b["final"] >= auto or b["feature"] is not None and b["feature"] >= 0.75
        margin = b["final"] - ranked[1]["final"] if len(ranked) > 1 else 1.0
        out[q] = ("matched" if good else "unmatched", b["asset"] if good else None, b["group"] if good else None, groups[b["group"]] if good else [], b["final"], margin, any(len(r) > 1 for r in same.values()), [r["asset"] for r in ranked[:10]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_whole_match(spark, seed):
    rng, arr = random.Random(seed), np.random.default_rng(seed)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(np.abs(arr.standard_normal(6)) + 0.3 * arr.standard_normal(6))
    tags = list(TAG_RULES)
    groups = {g: [tags[(g * 7 + seed) % len(tags)], "own"] if g % 4 else ["own"] for g in range(14)}
    library = {a: (rng.randrange(13), unit(), rng.choice([None, f"s{rng.randrange(5)}", f"u{a}"])) for a in range(70)}
    queries = {q: (unit(), rng.choice([None, "s3", "s1", f"q{q}", f"q{q}"])) for q in range(1000, 1024)}
    fields = {q: f for q, f in zip(queries, contents(seed, 24).values(), strict=True) if q % 6}
    for q in fields:  # some contents speak for a group
        if q % 2:
            fields[q]["scene"] = [k for t in groups[q % 13] if t in TAG_RULES for k in TAG_RULES[t].keywords[:1]]
    asked = {q: (rng.sample(THINGS, rng.randrange(1, 4)), rng.choice([0.3, 0.7, 0.9])) for q in fields}
    shown = {a: (rng.sample(THINGS, 2), rng.choice([0.5, 0.8])) for a in library if a % 5}
    expected = plain_match(queries, fields, asked, library, shown, groups, 0.93, 3, 0.78)
    frame = spark.createDataFrame
    found = tag_rules.library_match(
        frame([(q, v, s) for q, (v, s) in queries.items()], "query_id long, query_vector array<double>, sha string"), frame([(q, f, *asked[q]) for q, f in fields.items()], KIND),
        frame([(a, g, v, s) for a, (g, v, s) in library.items()], "asset_id long, group_id long, vector array<double>, sha string"), frame([(a, o, c) for a, (o, c) in shown.items()], "asset_id long, objects array<string>, confidence double"),
        frame(list(groups.items()), "group_id long, tags array<string>"), auto=0.93, refined=3,
    ).collect()
    assert {r["query_id"] for r in found} == set(queries) and len(found) == len(queries)
    for r in found:
        e = expected[r["query_id"]]
        assert (r["decision"], r["matched_asset_id"], r["matched_group_id"], r["tags"], r["collapsed"], r["candidates"]) == (*e[:4], e[6], e[7])
        assert r["final_score"] == pytest.approx(e[4]) and r["margin"] == pytest.approx(e[5])
    assert {e[0] for e in expected.values()} == {"matched", "unmatched"} and any(e[6] for e in expected.values())


def test_best_of_blocks_are_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 16)
    arr = np.random.default_rng(3)
    vectors = np.abs(arr.standard_normal((90, 4))).round(1)
    vectors[::9] = vectors[0]  # ties
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    library = spark.createDataFrame([(k, k % 5 if k % 11 else None, unit(v)) for k, v in enumerate(vectors)], "asset_id long, group_id long, vector array<double>")
    queries = spark.createDataFrame([(k, unit(v)) for k, v in enumerate(vectors[:40])], "query_id long, query_vector array<double>")
    every = matching.scored(queries, library)
    a, b = (sorted(map(tuple, matching.group_scores(x, support=0.9).na.fill(-1, ["group_id"]).select("query_id", "group_id", "asset_id", F.round("similarity", 9), "prototypes", "support").collect())) for x in (every, matching.best_scored(queries, library, support=0.9)))
    assert a == b
    a, b = (sorted(map(tuple, matching.nearest(x, 7).select("query_id", "rank", "asset_id").collect())) for x in (every, matching.best_scored(queries, library, top=7, by_group=False, larger=False)))
    assert a == b


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    facts = spark.createDataFrame([(k, f"word{k % 7} and more", 0.9) for k in range(20)], "query_id long, haystack string, confidence double")
    rules = spark.createDataFrame([(g, d, [f"word{g % 7}"], 1, d == "a") for g in range(30) for d in "ab"], "group_id long, dimension string, keywords array<string>, least_hits int, hard_gate boolean")
    few = sorted(map(tuple, matching.rule_evidence(facts, rules).collect()))
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 13)
    assert sorted(map(tuple, matching.rule_evidence(facts, rules).collect())) == few and len(few) == 600
