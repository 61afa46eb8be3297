"""Skew, marks and the retouching chain on pictures whose right result is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.operators import covers, marks, resampling, retouching, shapes

KIND = "image_id long, width int, height int, pixels binary"


def frame(spark, images):
    return spark.createDataFrame([(k, i.shape[1], i.shape[0], bytearray(i.tobytes())) for k, i in images.items()], KIND)


def ruled(degrees, h=240, w=320):
    """Sharp stripes that fall off to the right by so many degrees."""
    y, x = np.mgrid[0:h, 0:w]
    a = np.radians(degrees)
    stripe = ((y * np.cos(a) - x * np.sin(a)) // 20).astype(int) % 2
    return np.repeat((60 + 130 * stripe)[..., None], 3, axis=2).astype(np.uint8)


def test_turned_pictures_come_back(spark):
    asked = {1: -4.0, 2: -2.5, 3: -1.0, 4: 1.5, 5: 3.0, 6: 4.0}
    images = {k: ruled(d) for k, d in asked.items()} | {7: ruled(0.0), 8: np.full((100, 100, 3), 9, np.uint8), 9: ruled(20.0), 10: np.zeros((0, 60, 3), np.uint8)}
    found = {r["image_id"]: r["turn"] for r in shapes.skew_turns(frame(spark, images)).collect()}
    assert set(found) == set(asked)
    for k, d in asked.items():
        assert found[k] == pytest.approx(d, abs=0.5)
    # What is straightened by the turn is straight.
    again = {k: resampling.turned(images[k], found[k]) for k in asked}
    assert all(abs(r["turn"]) < 0.75 for r in shapes.skew_turns(frame(spark, again)).collect())


def marked(seed, h=120, w=200):
    """A plain ground with noise, and pale signs in the lower left."""
    rng = np.random.default_rng(seed)
    clean = np.repeat(rng.integers(100, 104, (h, w, 1)), 3, axis=2).astype(np.uint8)
    out = clean.copy()
    for k, x in enumerate(range(8, 130, 11)):
        y = (45, 70, 100)[k % 3]
        out[y : y + 7, x : x + 2] = 235
        out[y + 3, x : x + 4] = 235
    return clean, out


def test_marks_come_off_in_two_steps(spark):
    plan = marks.MarkPlan()
    images = {k: marked(k)[1] for k in range(3)} | {5: marked(0)[1], 6: np.full((120, 200, 3), 100, np.uint8), 7: np.zeros((0, 200, 3), np.uint8), 8: np.full((5, 5, 3), 1, np.uint8)}
    pictures = frame(spark, images)
    plans = marks.planned(pictures, plan)
    found = {r["image_id"]: r for r in plans.collect()}
    assert set(found) == {0, 1, 2, 6, 7, 8} and found[0]["status"] == "planned" and found[6]["status"] == "none" and found[7]["status"] == "empty"
    done = {r["image_id"]: r for r in marks.carried_out(pictures, plans, plan).collect()}
    for k in (0, 1, 2, 5):
        clean, image = marked(k % 5)
        status, method, mask, _ = marks.prepared(image, [], plan)
        out = np.frombuffer(done[k]["pixels"], np.uint8).reshape(image.shape)
        assert (status, done[k]["status"], done[k]["outside"]) == ("planned", "applied", 0)
        assert (out == marks.finished(image, method, mask, plan)).all()
        x0, y0, x1, y1 = marks.region_of(plan, 120, 200)
        assert np.abs(out.astype(int) - clean)[y0:y1, x0:x1].max() <= 4 and (out[:y0] == image[:y0]).all()
    assert done[5]["pixels"] == done[0]["pixels"] and done[6]["status"] == "none" and done[7]["pixels"] == b""
    # The same plans again find nothing to do.
    after = marks.carried_out(pictures, plans, plan).drop("status", "outside")
    again = {r["image_id"]: r for r in marks.carried_out(after, plans, plan).collect()}
    assert all(again[k]["status"] is None and again[k]["pixels"] == done[k]["pixels"] for k in (0, 1, 2, 5))


def test_known_opacities_are_taken_back(spark):
    clean = (np.arange(120 * 200 * 3).reshape(120, 200, 3) % 150 + 40).astype(np.uint8)
    alpha = np.zeros((90, 150), np.uint8)
    alpha[10:40, 20:120] = 128
    plan = marks.MarkPlan(opacity=alpha.tobytes(), opacity_shape=alpha.shape)
    image = clean.copy()
    part = image[30:120, 0:150].astype(float)
    a = (alpha / 255)[..., None]
    image[30:120, 0:150] = np.rint(part * (1 - a) + 220 * a)
    pictures = frame(spark, {1: image})
    (row,) = marks.carried_out(pictures, marks.planned(pictures, plan), plan).collect()
    out = np.frombuffer(row["pixels"], np.uint8).reshape(image.shape)
    assert row["status"] == "applied" and np.abs(out.astype(int) - clean).max() <= 2


def test_polygons_add_to_what_is_found(spark):
    _, image = marked(3)
    pictures = frame(spark, {1: image})
    quads = spark.createDataFrame([(1, [[5.0, 40.0], [140.0, 40.0], [140.0, 56.0], [5.0, 56.0]])], "image_id long, points array<array<double>>")
    (row,) = marks.planned(pictures, marks.MarkPlan(), quads).collect()
    assert row["method"] == "text and candidates" and row["status"] == "planned"
    (row,) = marks.planned(pictures, marks.MarkPlan(largest_share=0.01), quads).collect()
    assert row["status"] == "too large" and row["mask"] is None


def test_masked_pixels_are_means_from_the_rim():
    image = np.zeros((5, 7, 3), np.uint8)
    image[:, :3], image[:, 4:] = 10, 30
    mask = np.zeros((5, 7), bool)
    mask[:, 3] = True
    assert (marks.painted_over(image, mask)[:, 3] == 20).all() and (marks.painted_over(image, np.ones((5, 7), bool)) == image).all()


def test_the_chain_straightens_first_and_sharpens_what_is_enlarged(spark):
    image = ruled(2.0, 60, 80)
    rows = frame(spark, {1: image, 2: image}).withColumn("turn", F.when(F.col("image_id") == 1, 2.0))
    plan = retouching.Retouch(contrast=1.1, sharpness=1.4, longest=120)
    found = {r["image_id"]: r for r in retouching.retouch_all(rows, plan).collect()}
    for k, start in ((1, resampling.turned(image, 2.0)), (2, image)):
        by_steps = retouching.sharpened(resampling.resized(retouching.enhanced(start, plan), 120, 90), 1.4)
        assert (found[k]["width"], found[k]["height"]) == (120, 90) and bytes(found[k]["pixels"]) == by_steps.tobytes()


BOX = "image_id long, x0 double, y0 double, x1 double, y1 double, label string, confidence double"


def test_boxes_in_blocks(spark):
    rng = np.random.default_rng(2)
    images = {k: rng.integers(0, 256, (60, 90, 3)).astype(np.uint8) for k in range(4)} | {4: np.zeros((0, 90, 3), np.uint8)}
    rows = [(0, 40.0, 30.0, 10.0, 10.0, "logo", 0.9), (0, 80.0, 50.0, 200.0, 70.0, "logo", 0.9), (1, 10.0, 10.0, 40.0, 30.0, "other", 0.9), (1, 10.0, 10.0, 40.0, 30.0, "logo", 0.1), (2, 95.0, 0.0, 99.0, 9.0, "logo", 0.9), (4, 0.0, 0.0, 9.0, 9.0, "logo", 0.9)]
    cover = covers.Cover(labels=("logo",), expansion=0.1, block_ratio=0.25)
    found = {r["image_id"]: r for r in covers.covered(frame(spark, images), spark.createDataFrame(rows, BOX), cover).collect()}
    assert {k: r["status"] for k, r in found.items()} == {0: "applied", 1: "not_detected", 2: "not_detected", 3: "not_detected", 4: "empty"}
    r = found[0]
    assert [list(b) for b in r["boxes"]] == [[7, 8, 43, 32], [68, 48, 90, 60]] and r["outside"] == 0
    assert r["share"] == pytest.approx((36 * 24 + 22 * 12) / 5400)
    out = np.frombuffer(r["pixels"], np.uint8).reshape(60, 90, 3)
    # 36 x 24 by blocks of 6: six by four, each the mean of its own pixels
    for y in range(8, 32, 6):
        for x in range(7, 43, 6):
            block = images[0][y : y + 6, x : x + 6].reshape(-1, 3).mean(axis=0)
            assert np.abs(out[y : y + 6, x : x + 6] - block).max() <= 0.5 + 1e-9
    assert all(bytes(found[k]["pixels"]) == images[k].tobytes() for k in (1, 2, 3))


def test_stickers(spark):
    image = np.full((60, 90, 3), 100, np.uint8)
    rgba = np.zeros((8, 12, 4), np.uint8)
    rgba[1:7, 1:11] = (250, 50, 0, 255)
    rgba[1:7, 6:11, 3] = 128
    cover = covers.Cover("sticker", expansion=0.0, sticker=rgba.tobytes(), sticker_shape=(8, 12))
    boxes = spark.createDataFrame([(1, 20.0, 20.0, 30.0, 26.0, "a", 0.9)], BOX)
    (r,) = covers.covered(frame(spark, {1: image}), boxes, cover).collect()
    # its visible part is 10 x 6, the box 10 x 6: as high as the box, at 25 less a third of its width
    assert [list(b) for b in r["boxes"]] == [[22, 20, 32, 26]] and r["outside"] == 0 and r["covered"] == 1
    out = np.frombuffer(r["pixels"], np.uint8).reshape(60, 90, 3)
    assert out[22, 23].tolist() == [250, 50, 0] and np.abs(out[22, 30].astype(int) - [175, 75, 50]).max() <= 1 and out[19, 23].tolist() == [100] * 3
    blank = covers.Cover("sticker", sticker=bytes(16), sticker_shape=(2, 2))
    (r,) = covers.covered(frame(spark, {1: image}), boxes, blank).collect()
    assert r["status"] == "failed_safe" and "sticker" in r["error"] and bytes(r["pixels"]) == image.tobytes()


def test_means_of_areas():
    assert resampling.averaged(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2).tolist() == [[2, 4], [10, 12]]
    values = np.array([[0, 30, 60]], np.uint8)
    assert resampling.averaged(values, 2, 1).tolist() == [[10, 50]]
