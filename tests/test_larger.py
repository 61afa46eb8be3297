"""What keeps queries in proportion to their tables: steps that run once, and bounded groups, batches and queues."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from prismatic.operators import retouching, shapes
from prismatic.catalog import QUERIES
from prismatic.operators import matching, pixels, sequential


def planned(frame, step="MapInPandas"):
    """How often a step stands in the physical plan."""
    return frame._jdf.queryExecution().sparkPlan().toString().count(step)


def test_lines_of_pictures_are_found_once(spark, data):
    assert planned(QUERIES["i8_skew_from_pixels"](spark, data)) == 1


def test_the_chain_looks_at_each_picture_for_lines_once(spark, data):
    assert planned(QUERIES["i7_retouched"](spark, data)) == 2  # lines, and the chain


def test_small_turns_are_asked_first(spark):
    from prismatic.operators import evidence

    rows = [(1, 100, 2)] * 4 + [(1, 100, 8)] * 9 + [(2, 100, 8)] * 5 + [(3, 100, 2)] * 3
    lines = spark.createDataFrame(rows + [(None, 100, 2)] * 5, "image_id long, dx int, dy int")
    both = {r["image_id"]: r["turn"] for r in evidence.skew_votes(lines, 5, small_degrees=3).collect()}
    small = {r["image_id"]: r["turn"] for r in evidence.skew_votes(lines, 3).collect()}
    large = {r["image_id"]: r["turn"] for r in evidence.skew_votes(lines, 5).collect()}
    assert both == {1: pytest.approx(np.degrees(np.arctan2(2, 100))), 2: pytest.approx(np.degrees(np.arctan2(8, 100)))}
    assert small == {1: both[1]} and large == {1: pytest.approx(both[2]), 2: both[2]}


@pytest.fixture
def many(spark):
    rng = np.random.default_rng(11)
    vectors = np.abs(rng.standard_normal((150, 5))).round(1) + 0.1
    vectors[::7] = vectors[0]  # ties
    rows = [(k, k % 4 if k % 11 else None, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(vectors)]
    library = spark.createDataFrame(rows + [(900, 1, [1.0])], "asset_id long, group_id long, vector array<double>")
    queries = library.where("asset_id < 30").selectExpr("asset_id AS query_id", "vector AS query_vector")
    return queries, library


@pytest.mark.parametrize(("block", "group"), [(4096, 100_000), (8, 100_000), (8, 20)])
def test_places_by_group_as_a_window_gives_them(spark, monkeypatch, many, block, group):
    monkeypatch.setattr(matching, "BLOCK_ROWS", block)
    monkeypatch.setattr(matching, "GROUP_ROWS", group)
    order = Window.partitionBy("query_id").orderBy("group_id", F.desc("similarity"), "asset_id")
    expected = matching.scored(*many).select("query_id", "asset_id", "group_id", F.row_number().over(order).alias("place"))
    assert sorted(map(str, matching.placed_by_group(*many).collect())) == sorted(map(str, expected.collect()))


def test_pairs_are_placed_where_they_are_made(spark, data):
    assert planned(QUERIES["l4_group_order"](spark, data), "Window") == 0


def test_places_take_disk_as_the_vectors_do(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 100)
    vectors = np.abs(np.random.default_rng(5).standard_normal((2000, 16)))
    rows = [(k, k % 8, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "asset_id long, group_id long, vector array<double>").write.parquet(f"{tmp_path}/library")
    library = spark.read.parquet(f"{tmp_path}/library")
    queries = library.where("asset_id % 10 = 0").selectExpr("asset_id AS query_id", "vector AS query_vector")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    matching.placed_by_group(queries, library).write.parquet(f"{tmp_path}/places")
    assert shuffled() - before < 2 * vectors.nbytes  # not a vector for each block that it meets
    assert spark.read.parquet(f"{tmp_path}/places").count() == 200 * 2000
    assert sum(f.stat().st_size for f in (tmp_path / "places").glob("*.parquet")) < 2 * 200 * 2000


def test_the_best_of_a_group_in_few_rows(spark, monkeypatch, many):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 64)
    found = matching.best_scored(*many, top=3)
    assert found.groupBy("query_id", "group_id").count().agg(F.max("count")).first()[0] == 3  # a group of up to 64 rows is in one block
    monkeypatch.setattr(matching, "BLOCK_ROWS", 8)
    asset = Window.partitionBy("query_id", "group_id", F.col("asset_id") % 3).orderBy(F.desc("similarity"), F.desc("asset_id"))
    expected = matching.scored(*many).withColumn("rn", F.row_number().over(asset)).where("rn = 1")
    parts = many[0], many[1].withColumn("third", F.col("asset_id") % 3)
    best = matching.collapsed(matching.best_scored(*parts, top=1, by=("group_id", "third")).selectExpr("*", "similarity AS final_score", "asset_id % 3 AS third"), "query_id", "group_id", "third")
    key = lambda r: str((r["query_id"], r["group_id"], r["asset_id"], r["similarity"]))
    assert sorted(map(key, best.collect())) == sorted(map(key, expected.collect()))


def test_halves_go_up_as_in_spark(spark):
    x = np.concatenate([np.random.default_rng(0).random(500), np.arange(200) / 1e6 + 5e-7, [0.0, 1.0, 0.1234565, 0.9999995, 0.0000005]])
    expected = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert matching.half_up(x[None, :], 6)[0].tolist() == expected


@pytest.mark.parametrize("name", ["j21_detection_matches", "j22_best_first_matches", "d14_detector_report", "i27_suppressed_boxes", "z8_fair_order"])
def test_no_frame_of_its_own_for_a_group(spark, data, name):
    assert planned(QUERIES[name](spark, data), "GroupsInPandas") == 0


def test_groups_beyond_an_arrow_batch(spark):
    boxes = spark.range(60).selectExpr("id", "id % 4 AS image_id", "'a' AS class", "id % 7 / 7D AS confidence", "id % 5 AS x0", "id % 3 AS y0", "id % 5 + 9 AS x1", "id % 3 + 9 AS y1")
    found = {}
    for rows in (10_000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            kept = {r["id"] for r in sequential.suppressed(boxes, 0.6).collect()}
            outcomes = sorted(map(tuple, sequential.detection_outcomes(boxes, boxes.where("id % 6 <> 0")).collect()))
            found[rows] = kept, outcomes, sorted(map(tuple, sequential.best_first_matches(boxes.where("id > 9"), boxes).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[3] == found[10_000] and {o[2] for o in found[3][1]} == {"tp", "fp", "fn"}
    assert sum(n for _, _, outcome, n in found[3][1] if outcome != "fn") == 60


def test_windows_of_an_hour_by_counting(spark, tmp_path):
    rng = np.random.default_rng(4)
    us = (rng.integers(0, 4 * 3600, 300) // 60 * 60_000_000).tolist()  # on whole minutes: ties, and rows just an hour apart
    rows = [(k, "ab"[k % 2] if k % 13 else None, t if k % 17 else None) for k, t in enumerate(us)]
    spark.createDataFrame(rows, "event_id long, event_type string, us long").selectExpr("event_id", "event_type", "timestamp_micros(us)::timestamp_ntz AS ts").write.parquet(f"{tmp_path}/events.parquet")
    expected = {k: sum(e == e2 and (t2 is None if t is None else t2 is not None and 0 <= t - t2 <= 3_600_000_000) for _, e2, t2 in rows) for k, e, t in rows}
    frame = QUERIES["w9_sliding_window"](spark, str(tmp_path))
    assert {r["event_id"]: r["in_window"] for r in frame.collect()} == expected
    assert planned(frame, "-3600000000") == 0  # such a frame counts its rows anew for each row


def test_pictures_come_in_slices_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(pixels, "SLICE_BYTES", 100)
    frame = pd.DataFrame({"image_id": range(50), "pixels": [b"x" * (k % 40) if k % 9 else None for k in range(49)] + [b"y" * 500]})
    parts = list(pixels.in_slices([frame, frame.iloc[:0]]))
    assert pd.concat(parts).equals(frame) and len(parts) > 8
    assert all(sum(len(p or b"") for p in part["pixels"][:-1]) <= 140 for part in parts)


@pytest.mark.parametrize("name", ["i17_turned", "i6_upright", "i16_enlarged", "i1_ingested_files", "i2_thumbnails", "i22_stroke_masks", "i23_mark_plans"])
def test_batches_of_pictures_are_bounded(spark, data, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    QUERIES[name](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
