"""Closed forms, boundaries, order independence and plain versions of the catalog's operators."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismatic.functions import geometry, retouch, score, text, vector
from prismatic.operators import duplicates, evidence, matching, pixels, sequential
from prismatic.plans import scalars, sequences
from prismatic.plans.evidence import hmac_sha256
from prismatic.session import shared_folder
from prismatic.sources import files
from prismatic.streaming import stages


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_technical_quality(spark):
    assert round(value(spark, score.technical_quality(*lit(80, 100, 100, 100))), 2) == 91.87
    assert round(value(spark, score.technical_quality(*lit(95, 95, 95, 95))), 2) == 95
    assert value(spark, score.technical_quality(*lit(0, 100, 100, 100))) == 0


@pytest.mark.parametrize("ratings, hard, technical, expected", [((5, 5, 5, 5), False, 80, 95.0), ((5, 5, 5, 5), False, 100, 100.0), ((5, 5, 5, 5), False, 79.99, 94.99), ((4, 5, 5, 5), False, 100, 94.99), ((5, 3, 5, 5), False, 100, 89.99), ((5, 2, 5, 5), False, 100, 79.99), ((5, 5, 5, 5), True, 100, 79.99)])
def test_cover_score(spark, ratings, hard, technical, expected):
    assert round(value(spark, score.cover_score(*lit(*ratings), F.lit(hard), F.lit(technical))), 2) == expected


def test_blend(spark):
    final, weight = score.blended(F.lit(0.6632), F.lit(0.4379), F.lit(0.7), F.lit(0.15))
    assert round(value(spark, weight), 4) == 0.0315
    assert value(spark, score.fixed_blend(F.lit(0.67), F.lit(0.80))) == pytest.approx(0.709)
    assert value(spark, score.blended(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))[0]) == 0.5


@pytest.mark.parametrize("final, feature, passed", [(0.60, 0.10, True), (0.5999, 0.7501, True), (0.5999, 0.75, True), (0.5999, None, False)])
def test_decision_gates(spark, final, feature, passed):
    assert value(spark, score.matched(F.lit(final), F.lit(feature).cast("double"))) is passed


def test_completion(spark):
    label, subtype, codes = score.completion(*lit(*[True] * 7))
    assert value(spark, label) == value(spark, subtype) == "completed"
    label, subtype, codes = score.completion(*lit(True, True, True, False, True, True, True))
    assert (value(spark, subtype), value(spark, codes)) == ("construction", ["VISIBLE_CONSTRUCTION"])


@pytest.mark.parametrize("coverage, confidence, action", [(0.75, 0.9, "reject"), (0.72, 0.9, "review"), (0.60, 0.9, "pass"), (0.90, 0.5, "review")])
def test_ground_film(spark, coverage, confidence, action):
    assert value(spark, score.ground_film(F.lit(True), F.lit(True), F.lit(coverage), F.lit(confidence))) == action


def test_boxes(spark):
    assert tuple(value(spark, geometry.portrait_crop(*lit(1600, 900)))) == (462, 0, 1137, 900)
    assert tuple(value(spark, geometry.expanded(tuple(lit(0, 5, 20, 25)), *lit(100, 80), 0.25))) == (0, 0, 25, 30)
    assert value(spark, geometry.expanded(tuple(lit(110, 5, 120, 25)), *lit(100, 80), 0.25)) is None
    assert value(spark, geometry.iou(tuple(lit(0.0, 0.0, 2.0, 2.0)), tuple(lit(1.0, 1.0, 3.0, 3.0)))) == pytest.approx(1 / 7)


def test_hash_bits(spark):
    assert value(spark, vector.hamming(vector.bits(F.lit("1" * 64)), vector.bits(F.lit("0" * 64)))) == 64
    assert value(spark, vector.average_hash(F.array(*lit(1.0, 2.0, 3.0)))) == "011"
    assert not value(spark, vector.usable(F.array(*lit(0.0, 0.0)))) and not value(spark, vector.usable(F.array(*lit(1.0, float("nan")))))


def test_text(spark):
    assert value(spark, text.normalized(F.lit("  Ab　c D\n"))) == "abcd"
    assert value(spark, text.redacted(F.lit("x  token: abc, Bearer q.w"))) == "x token=[REDACTED], Bearer [REDACTED]"
    assert value(spark, text.http_status(F.lit("HTTP 429!"))) == 429 and value(spark, text.http_status(F.lit("HTTP 42"))) is None
    assert value(spark, text.dice(F.lit("night"), F.lit("nacht"))) == 0.25 and value(spark, text.dice(F.lit("a"), F.lit("a"))) == 0
    assert value(spark, text.first_spellings(F.array(*lit("B ", "b", " ", "A", "B")))) == ["B", "A"]
    assert value(spark, text.archive_name(F.lit(7), F.lit("a\\b/c.d.png"), F.lit("x"))) == "007_c.d.jpg"


def test_margin_and_ties(spark):
    rows = [(1, "b", 10, 0.7, None, 0.7), (1, "a", 11, 0.7, None, 0.7), (2, "z", 9, 0.2, 0.8, 0.3)]
    found = {r["query_id"]: r for r in matching.decided(spark.createDataFrame(rows, "query_id int, asset_id string, group_id int, similarity double, feature_score double, final_score double")).collect()}
    assert (found[1]["matched_asset_id"], found[1]["margin"], found[1]["candidates"]) == ("a", 0.0, ["a", "b"])
    assert (found[2]["decision"], found[2]["margin"]) == ("matched", 1.0)


def test_prototypes(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.01], 3: [0.0, 1.0], 4: [0.01, 0.99], 5: None, 6: [0.0, 0.0]}
    rows = spark.createDataFrame([(k, 0, x) for k, x in v.items()], "asset_id long, group_id int, vector array<double>")
    a = [r["asset_id"] for r in matching.prototypes(rows, 2).orderBy("rank").collect()]
    b = [r["asset_id"] for r in matching.prototypes(rows.orderBy(F.desc("asset_id")), 2).orderBy("rank").collect()]
    x, y = (np.array(v[k]) for k in a)
    assert a == b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) < 0.1


def test_prototypes_in_rounds_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(60, 5)).round(1)
    vectors[[7, 13]] = vectors[1]
    rows = [(k, k % 3, v.tolist()) for k, v in enumerate(vectors)] + [(100, 3, [1.0, 2.0]), (101, 3, [-1.0, -2.0]), (102, 4, [0.0, 0.0]), (103, 0, None), (104, 0, [1.0]), (105, 5, [0.5, 0.5])]
    rows = spark.createDataFrame(rows, "asset_id long, group_id int, vector array<double>")
    chosen = lambda limit: sorted(map(tuple, matching.prototypes(rows, limit).select("group_id", "rank", "asset_id").collect()))
    by_group = {limit: chosen(limit) for limit in (1, 6, 25)}
    assert {g for g, _, _ in by_group[1]} == {0, 1, 2, 3, 5} and len(by_group[25]) == 63
    for most in (0, 2):
        monkeypatch.setattr(matching, "GROUP_ROWS", most)
        assert chosen(6) == by_group[6]
    assert chosen(1) == by_group[1]


def test_leave_one_out_as_the_reference_chooses(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6)) + rng.normal(size=(3, 6))[np.arange(90) % 3] * 0.7
    groups = np.arange(90) % 3
    vectors[[33, 63]] = vectors[3]  # copies in their own group
    vectors[[34, 65]] = vectors[4]  # and in two groups
    vectors = np.vstack([vectors, rng.normal(size=(4, 6)), np.zeros((1, 6))])
    vectors[93] = vectors[92]
    groups = np.array([*groups, 3, 4, 5, 5, 0])
    rows = spark.createDataFrame([(k, int(g), v.tolist()) for k, (g, v) in enumerate(zip(groups, vectors, strict=True))], "asset_id long, group_id int, vector array<double>")
    for limit in (4, 12):
        expected = {}
        for q in range(94):
            same = (vectors == vectors[q]).all(axis=1)
            by_group = {g: (ids := np.flatnonzero((groups == g) & ~same))[matching.diverse(ids, vectors[ids].astype(np.float32), limit)] for g in set(groups)}
            if len(by_group[groups[q]]):
                for g, ids in by_group.items():
                    for k in ids:
                        cosine = vectors[q] @ vectors[k] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[k])
                        expected[q, int(k), int(g)] = max(0.0, min(1.0, cosine))
        found = [((r["query_id"], r["asset_id"], r["group_id"]), r["similarity"]) for r in matching.leave_one_out_scores(rows, limit).collect()]
        assert len(found) == len(expected) and dict(found) == pytest.approx(expected)


def test_scores_in_blocks_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, k % 3, rng.normal(size=4).tolist()) for k in range(60)], "asset_id long, group_id int, vector array<double>")
    asked = rows.limit(7).select(F.col("asset_id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = {tuple(r) for r in matching.scored(asked, rows).collect()}
    vectors = {r["asset_id"]: np.array(r["vector"]) for r in rows.collect()}
    expected = {(q["query_id"], k): max(0.0, min(1.0, float(np.dot(q["query_vector"], v)))) for q in asked.collect() for k, v in vectors.items()}
    assert {(q, k): s for q, k, _, s in whole} == pytest.approx(expected) and all(g == k % 3 for _, k, g, _ in whole)
    monkeypatch.setattr(matching, "BLOCK_ROWS", 8)
    assert {tuple(r) for r in matching.scored(asked, rows).collect()} == whole
    other = spark.createDataFrame([(99, 0, [1.0])], rows.schema)
    assert matching.scored(asked, rows.union(other)).count() == len(whole)
    assert matching.scored(asked.limit(0), rows).count() == 0 == matching.scored(asked, rows.limit(0)).count()


def test_banded_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 30)
    hashes = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 8), replace=False))) for b in base for _ in range(4)]
    found = {(r["a"], r["b"], r["distance"]) for r in duplicates.near_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, h long"), 5, "id", "h").collect()}
    assert found == {(i, j, d) for i in range(120) for j in range(i + 1, 120) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= 5} and found


def test_detection_matching(spark):
    p = spark.createDataFrame([(1, "logo", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "logo", 0.8, 1.0, 1.0, 10.0, 10.0), (2, "logo", 0.5, 0.0, 0.0, 1.0, 1.0)], "image_id long, class string, confidence double, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(1, "logo", 0.0, 0.0, 10.0, 9.0), (3, "logo", 0.0, 0.0, 1.0, 1.0)], "image_id long, class string, x0 double, y0 double, x1 double, y1 double")
    found = {(r["image_id"], r["outcome"]): r["n"] for r in sequential.detection_outcomes(p, t).collect()}
    assert [found[k] for k in ((1, "tp"), (1, "fp"), (1, "fn"), (2, "fp"), (3, "fn"))] == [1, 1, 0, 1, 1]
    kept = sequential.suppressed(p, 0.45).collect()
    assert len(kept) == 2


def test_token_bucket(spark):
    rows = spark.createDataFrame([(1, k, 0) for k in range(22)] + [(1, 22, 20_000)], "owner long, request long, at_ms long")
    found = {r["request"]: (r["granted"], r["retry_ms"]) for r in sequential.token_bucket(rows, 3, 20).collect()}
    assert [found[k][0] for k in range(22)] == [True] * 20 + [False] * 2 and found[20][1] == 20_000 and found[22][0]


def test_fair_order(spark):
    rows = [(0, k, 1, 1, 0) for k in range(3)] + [(0, 10, 2, 2, 0), (0, 11, 3, 3, 0), (0, 12, 4, 4, 0), (0, 13, 1, 5, 0)]
    found = sequential.fair_order(spark.createDataFrame(rows, "lane long, token long, stage int, job long, at_ms long")).orderBy("place").collect()
    assert [r["token"] for r in found] == [0, 13, 1, 10, 11, 12, 2]


def test_lockout(spark):
    rows = [(1, k, k * 1000, False) for k in range(5)] + [(1, 9, 16 * 60_000, True)]
    found = sequential.lockouts(spark.createDataFrame(rows, "account long, attempt long, at_ms long, good boolean")).orderBy("attempt").collect()
    assert [r["locked"] for r in found] == [False, False, False, True, True, False]


def test_pixels():
    gray = np.zeros((8, 8), np.uint8)
    assert pixels.edge_variance(gray) == 0 and pixels.noise_residual(gray) == 0
    board = np.indices((8, 8)).sum(0).astype(np.uint8) % 2 * 255
    assert pixels.edge_variance(board) > 1000 and pixels.noise_residual(board) > 20
    out = pixels.mosaic(board, (2, 2, 6, 6), 2)
    assert pixels.changed_outside(board, out, [(2, 2, 6, 6)]) == 0 and set(out[2:6, 2:6].ravel()) == {128}
    assert pixels.union_area([(0, 0, 2, 2), (1, 1, 3, 3)], 8, 8) == 7
    mark, alpha = np.full((8, 8), 255.0), np.full((8, 8), 0.5)
    blended = 0.5 * 100 + 0.5 * mark
    assert (pixels.unblended(blended, mark, alpha) == 100).all()
    curve = pixels.tone_curve(0.3, 0.3)
    assert (np.diff(curve.astype(int)) >= 0).all() and curve[0] == 16
    assert abs(pixels.white_balanced(np.dstack([gray + 96, gray + 100, gray + 104]), 1.0).mean(axis=(0, 1)) - 100).max() <= 1
    assert pixels.white_balanced(np.dstack([gray + 50, gray + 100, gray + 150]), 1.0)[0, 0].tolist() == [53, 100, 141]


def test_pictures_of_whole_texts(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "a", "é" * 7, *("".join(chr(c) for c in rng.integers(32, 127, n)) for n in (255, 256, 257, 5000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    measured = {r["image_id"]: r for r in pixels.measured(sequences.pictures(docs)).collect()}
    tiled = {r["image_id"]: r for r in sequences.mosaics(docs).collect()}
    assert set(measured) == set(tiled) == set(range(len(texts)))
    for k, t in enumerate(texts):
        payload = (t or "").encode()
        picture = np.frombuffer(payload + bytes(-len(payload) % 16), np.uint8)
        expected = pixels.quality(picture.reshape(-1, 16)) if len(payload) else dict.fromkeys(("brightness", "deviation", "shadow", "highlight", "edges", "noise"))
        assert {c: measured[k][c] for c in expected} == expected
        frames = [np.frombuffer((payload + bytes(-len(payload) % 256))[x : x + 256], np.uint8).reshape(16, 16) for x in range(0, len(payload), 256)]
        after = [pixels.mosaic(f, (2, 3, 12, 11), 4) for f in frames]
        assert bytes(tiled[k]["pixels"]) == b"".join(f.tobytes() for f in after)
        assert (tiled[k]["outside"], tiled[k]["inside"]) == (0, sum(int((a != f).sum()) for a, f in zip(after, frames, strict=True)))


def test_rule_evidence_of_long_and_unmeasured_texts(spark):
    texts = {8: ("x" * 4000 + " the license and", 4016), 17: ("the and licence", None), 9: (None, None), 6: ("", 0)}
    docs = spark.createDataFrame([(k, t, n) for k, (t, n) in texts.items()], "doc_id long, text string, n_chars long")
    found = {(r["query_id"], r["group_id"]): (r["score"], r["mode"]) for r in scalars.evidence(spark, docs).collect()}
    assert len(found) == 12
    assert [found[8, g] for g in (1, 2, 3)] == [(1.0, "supported"), (0.0, "conflicted"), (0.0, "unsupported")]
    assert found[17, 1] == (1.0, "supported") and found[9, 1] == found[6, 1] == (0.0, "conflicted")


def test_whole_texts_are_compared(spark):
    texts = ["A b" * 20, "a B" * 20 + " tail one", "ab" * 20 + "zz" * 9, "x" * 60, "q" * 40 + "r" * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    plain = ["".join(t.lower().split()) if t is not None else None for t in texts]
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
    dice = {r["item_id"]: r["dice"] for r in scalars.pair_dice(scalars.whole_pairs(docs)).collect()}
    methods = {r["item_id"]: r["method"] for r in scalars.pair_evidence(scalars.whole_pairs(docs)).collect()}
    for k in range(5):
        x, y = plain[k], plain[k - k % 3]
        a, b = grams(x), grams(y)
        d = 2 * len(a & b) / (len(a) + len(b))
        assert dice[k] == round(d, 6)
        assert methods[k] == ("exact" if x == y else "normalized" if x in y or y in x else "lexical" if d >= 0.35 else "inconclusive")
    assert methods[1] == "normalized" and methods[5] is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "group_id": "g", "tags": ["t"], "embedding": "[1.0, 2.0]", "analysis_json": "{\\"scene\\": \\"hall\\"}"}\n{"asset_id": "y", "group_id": "g", "embedding": [3.0]}\n{"id": "z"}\n')
    found = {r["id"]: r["embedding"] for r in files.assets_jsonl(spark, str(tmp_path / "a.jsonl")).select("id", "embedding").collect()}
    assert found == {"x": [1.0, 2.0], "y": [3.0]}
    (tmp_path / "b.json").write_text(json.dumps({"categories": [{"id": 1, "name": "logo"}], "images": [], "annotations": [{"image_id": 5, "category_id": 1, "bbox": [1, 2, 3, 4]}]}))
    assert [tuple(r) for r in files.annotations(spark, str(tmp_path / "b.json")).collect()] == [(5, "logo", 1.0, 2.0, 4.0, 6.0)]
    (tmp_path / "c.csv").write_text("query_id,expected_asset_id,candidate_asset_id,similarity_score,feature_score,final_score\nq,a,a,0.5,,0.5\n")
    assert files.pairs_csv(spark, str(tmp_path / "c.csv")).first()["feature_score"] is None
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "p.bin").write_bytes(b"12345")
    assert files.pictures(spark, str(tmp_path / "pics")).count() == 1 and files.pictures(spark, str(tmp_path / "pics"), 3).count() == 0
    files.append_metrics(spark.createDataFrame([("m", 1, {"a": "b"})], "name string, value int, labels map<string,string>"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first()["value"] == 1.0


def test_queries_of_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query_id": " a ", "embedding": "[1.0, 2.0]", "expected_group_id": ""}\n\n{"id": "b", "embedding": [3.0], "expected_group_id": "g", "analysis_json": {"scene": "hall"}}\n')
    found = {r["query_id"]: (r["embedding"], r["expected_group_id"]) for r in files.queries_jsonl(spark, str(path)).drop("analysis").collect()}
    assert found == {"a": ([1.0, 2.0], None), "b": ([3.0], "g")}
    for bad in ('{"id": "c"}', '{"embedding": [1.0]}', '{"id": "c", "embedding": []}', "{"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="query_id or an embedding"):
            files.queries_jsonl(spark, str(path)).drop("analysis").collect()


def test_index_is_made_anew(spark):
    rows = spark.createDataFrame([(k, k % 2, [1.0 * k, 1.0]) for k in range(8)], "asset_id long, group_id int, vector array<double>")
    index = matching.PrototypeIndex(limit=2, max_age=300)
    first = index.at(rows, 1, 0.0)
    assert first.count() == 4
    assert index.at(rows, 1, 299.0) is first and index.at(rows, None, 299.0) is first
    second = index.at(rows.where("group_id = 0"), 2, 299.0)
    assert second is not first and second.count() == 2
    assert index.at(rows, 2, 600.0).count() == 4


def test_standard_selection(spark):
    answers = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, None), (5, None), (6, None)], "image_id long, selected_id string")
    told = spark.createDataFrame([(1, "b", True), (3, "b", True), (3, "z", False), (4, "a", True), (4, "b", True), (5, "a", True), (5, "z", True)], "image_id long, standard_id string, matched boolean")
    standards = lambda *rows: spark.createDataFrame(rows, "standard_id string, fallback boolean")
    got = lambda s: [(r["selected"], r["error"]) for r in evidence.standard_selection(answers, told, s).orderBy("image_id").collect()]
    assert got(standards(("a", False), ("b", False), ("z", True))) == [("a", None), (None, "foreign"), ("b", None), (None, "ambiguous"), (None, "ambiguous"), ("z", None)]
    assert got(standards(("a", False), ("b", False))) == [("a", None), (None, "foreign"), ("b", None), (None, "ambiguous"), (None, "ambiguous"), (None, "none")]
    assert {e for _, e in got(standards(("a", True), ("z", True)))} == {"fallbacks"}


def test_streams_give_what_batches_give(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").limit(300)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stages.per_item(stream).writeStream.format("memory").queryName("per_item").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("per_item").toPandas()["event_id"]) == sorted(stages.per_item(events).toPandas()["event_id"])
    run = stages.fixed_window_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    a, b = (f.toPandas().sort_values(["start", "user_id"]).reset_index(drop=True) for f in (spark.table("windows"), stages.fixed_window_counts(events)))
    pd.testing.assert_frame_equal(a, b)
    run = stages.leased_once(stream, ["user_id"]).writeStream.format("memory").queryName("leased").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("leased").select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_tone_curve_in_closed_form():
    assert pixels.tone_curve(0, 0).tolist() == list(range(256))
    lifted, held = pixels.tone_curve(0.4, 0), pixels.tone_curve(0, 0.6)
    assert lifted[0] == 22 and lifted[255] == 255 and held[0] == 0 and held[255] == 222
    assert [int(pixels.tone_curve(0.3, 0.2)[v]) for v in (64, 128, 192)] == [round(v + 55 * (0.3 * (1 - v / 255) ** 2 - 0.2 * (v / 255) ** 3)) for v in (64, 128, 192)]


def test_field_evidence_in_closed_form(spark):
    """Scenes equal and space on one side only; unrelated scenes; conditions that exclude each other."""
    rows = [("客厅", "客厅", "厨房", None, None), ("a very old hall", "qqq", None, None, None), ("x", "x", None, None, 0.9), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "s string, t string, p string, q string, c double")
    scene, space = matching.phrase_evidence(F.col("s"), F.col("t")), matching.phrase_evidence(F.col("p"), F.col("q"))
    weights = {"scene": 0.15, "space": 0.15, "other": 0.70}
    found = [tuple(r) for r in frame.select(*evidence.field_evidence({"scene": scene, "space": space}, F.col("c"), weights).values()).collect()]
    assert [tuple(None if v is None else round(v, 6) for v in r) for r in found] == [(1.0, 0.7, 0.15), (None, 0.0, 0.15), (1.0, 0.9, 0.15), (None, 0.0, 0.0)]
    known = evidence.known_phrases(F.col("a"), F.col("b"), {"building": ["施工"], "done": ["完工"]}, [("building", "done")])
    judged = spark.createDataFrame([("施工中", "已经完工"), ("施工中", "正在施工"), ("", "施工")], "a string, b string").select(known.alias("e")).collect()
    assert [(r["e"]["score"], r["e"]["method"]) if r["e"] else None for r in judged] == [(0.0, "canonical_conflict"), (1.0, "canonical"), None]


def test_lists_and_mappings(spark):
    rows = [(["Sofa", " lamp "], ["sofa", "chair", "LAMP"], {"Color ": ["Blue"]}, {"COLOR": ["blue"], "size": ["1"]}), ([""], ["x"], {"a": ["b"]}, {"c": ["b"]}), (None, ["x"], None, {"c": ["b"]})]
    frame = spark.createDataFrame(rows, "x array<string>, y array<string>, m map<string,array<string>>, n map<string,array<string>>")
    found = frame.select(evidence.list_evidence(F.col("x"), F.col("y")).alias("l"), evidence.mapping_evidence(F.col("m"), F.col("n")).alias("m")).collect()
    assert [(r["l"] and tuple(r["l"]), r["m"] and tuple(r["m"])) for r in found] == [((1.0, 1.0), (1.0, 1.0)), (None, None), (None, None)]


def test_retouching_policies(spark):
    plan = retouch.NEUTRAL | {"brightness": 1.12, "contrast": 1.3, "shadow_lift": 0.2, "denoise": 0.3, "sharpness": 1.4, "clarity": 0.3}
    columns = {n: F.lit(v) for n, v in plan.items()}
    held = spark.range(1).select(*(c.alias(n) for n, c in retouch.clamped(columns).items())).first()
    assert (held["highlight_recovery"], held["contrast"], held["sharpness"], held["clarity"], held["brightness"]) == (0.15, 1.08, 1.15, 0.18, 1.12)
    passed = {n: F.lit(n not in ("exposure", "sharpening")) for n in ("exposure", "color", "noise", "sharpening")}
    again = spark.range(1).select(*(c.alias(n) for n, c in retouch.corrected(columns, passed).items())).first()
    assert (again["brightness"], again["highlight_recovery"], again["sharpness"], again["clarity"], again["denoise"]) == (1.03, 0.22, 1.05, 0.1, 0.3)


def test_signature_is_an_hmac(spark):
    import hashlib
    import hmac

    found = spark.createDataFrame([(b"1.{}",), (b"",)], "b binary").select(hmac_sha256(b"key", F.col("b")).alias("h")).collect()
    assert [r["h"] for r in found] == [hmac.new(b"key", m, hashlib.sha256).hexdigest() for m in (b"1.{}", b"")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class getConf:  # noqa: N801
            get = staticmethod(lambda key: None)

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
