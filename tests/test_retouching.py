"""The retouching steps against loops over pixels and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.functions import text
from prismatic.operators import evidence, pixels, retouching, sequential
from prismatic.operators.retouching import Retouch


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(7).integers(0, 256, (21, 17, 3)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 16, 3), (2, 3, 3), (40, 16, 3)])
def test_a_plan_of_no_strength_changes_nothing_and_all_steps_bear_small_pictures(shape):
    some = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (retouching.retouched(some, Retouch()) == some).all()
    full = retouching.retouched(some, Retouch(0.5, 0.3, 0.2, 0.5, 0.3, 2.0, 0.3, 1.04, 1.05, 1.03, 0.3, 1.2))
    assert full.shape == shape and full.dtype == np.uint8
    assert all(np.isfinite(v) for v in retouching.measures(full).values())


def test_flat_pictures_stay_flat():
    flat = np.full((20, 20, 3), 90, np.uint8)
    assert (retouching.denoised(flat) == 90).all()
    assert (retouching.clarified(flat, 1.0) == 90).all()
    assert (retouching.sharpened(flat, 1.8) == 90).all() and (retouching.sharpened(flat, 0.4) == 90).all()
    assert np.allclose(retouching.smoothed(flat, 1.7), 90)
    assert retouching.measures(flat) == {"brightness": 90, "shadow": 0, "highlight": 0, "saturation": 0, "cast": 0, "noise": 0, "edges": 0}


def test_white_balance_moves_a_channel_by_six_hundredths_at_most():
    cast = np.full((4, 4, 3), (200, 100, 100), np.uint8)
    assert pixels.white_balanced(cast, 1.0)[0, 0].tolist() == [188, 106, 106]
    assert pixels.white_balanced(cast, 0.5)[0, 0].tolist() == [194, 103, 103]


def test_lightness_and_colour_come_back(image):
    assert np.abs(retouching.from_lab(retouching.lab(image)).astype(int) - image).max() <= 1
    assert np.allclose(retouching.lab(np.full((1, 1, 3), 255))[0, 0], [255, 0, 0], atol=0.01)


def test_denoising_by_a_loop(image):
    got, (h, w, _) = retouching.denoised(image), image.shape
    mirrored = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    for y, x in [(0, 0), (5, 7), (20, 16), (1, 15)]:
        total, weights = np.zeros(3), 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dy**2 + dx**2 <= 4:
                    other = image[mirrored(y + dy, h), mirrored(x + dx, w)].astype(float)
                    weight = np.exp(-(dy**2 + dx**2) / 18 - np.abs(other - image[y, x]).sum() ** 2 / (2 * 22**2))
                    total, weights = total + weight * other, weights + weight
        assert np.abs(got[y, x] - np.rint(total / weights)).max() <= 1


def test_spots_by_flooding():
    mask = np.random.default_rng(3).random((40, 30)) < 0.35
    found, number = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not found[y, x]:
            number, stack = number + 1, [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 40 and 0 <= b < 30 and mask[a, b] and not found[a, b]:
                    found[a, b] = number
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = retouching.spots(mask)
    pairs = set(zip(found.ravel().tolist(), got.ravel().tolist(), strict=True))
    assert len(pairs) == number + 1 == got.max() + 1
    assert retouching.spots(np.zeros((3, 3), bool)).max() == 0


def test_glare_is_a_pale_spot_within():
    rgb = np.full((100, 100, 3), 60, np.uint8)
    rgb[40:48, 40:48] = 250
    rgb[0:8, 0:8] = 250
    rgb[70:72, 70:72] = 250
    rgb[80:88, 20:28] = (250, 100, 100)
    mask = retouching.glare(rgb)
    assert mask.sum() == 64 and mask[40:48, 40:48].all()
    less = retouching.without_glare(rgb, 1.0)
    assert less[44, 44, 0] < 250 and np.abs(less[2, 2].astype(int) - 250).max() <= 1
    assert (retouching.without_glare(np.full((50, 50, 3), 60, np.uint8), 1.0) == 60).all()


def test_local_contrast_spreads_what_is_close():
    light = np.tile(np.linspace(100, 120, 64), (64, 1))
    assert retouching.equalized(light, 40.0).std() > 2 * light.std()
    even = np.full((64, 64), 100.0)
    assert np.ptp(retouching.equalized(even, 2.0)) == 0


def test_turning_and_orientation(image):
    assert (retouching.upright(image, 1) == image).all() and (retouching.upright(image, 0) == image).all()
    assert (retouching.upright(image, 3) == np.rot90(image, 2)).all()
    assert (retouching.upright(image, 6) == np.rot90(image, -1)).all()
    assert (retouching.upright(image, 8) == np.rot90(image, 1)).all()
    assert (retouching.upright(image, 5) == image.swapaxes(0, 1)).all()
    assert (retouching.upright(image, 7) == np.rot90(image, 2).swapaxes(0, 1)).all()


def test_a_mark_comes_off(image):
    alpha = np.tile(np.linspace(0.0, 0.7, 17), (21, 1))
    marked = np.rint(image + alpha[..., None] * (255.0 - image))
    told = retouching.alpha_of(image, marked)
    tells = (255 - image.astype(int) >= 60).all(axis=2)
    assert np.abs(told - alpha)[tells].max() < 0.02
    back = pixels.unblended(marked.astype(np.uint8), np.full(3, 255.0), alpha)
    assert np.abs(back.astype(int) - image).max() <= 3
    assert (pixels.unblended(image, np.full(3, 255.0), np.full((21, 17), 0.001)) == image).all()


def test_measures_by_hand():
    rgb = np.zeros((4, 4, 3), np.uint8)
    rgb[1:3, 1:3] = (255, 0, 0)
    told = retouching.measures(rgb)
    assert told["brightness"] == 19 and told["shadow"] == 0.75 and told["saturation"] == 63.75 and told["cast"] == 63.75


def test_pictures_without_pixels(spark):
    rows = spark.createDataFrame([(1, 16, 0, bytearray()), (2, 1, 1, bytearray(b"abc"))], "image_id long, width int, height int, pixels binary")
    got = {r["image_id"]: r for r in retouching.retouch_all(rows, Retouch(sharpness=1.5)).collect()}
    assert got[1]["pixels"] == b"" and got[1]["noise_after"] is None and got[2]["pixels"] == b"abc"
    assert retouching.retouch_all(rows.limit(0), Retouch()).count() == 0
    assert {r["image_id"]: bytes(r["pixels"]) for r in retouching.each_picture(rows, lambda image, row: 255 - image).collect()} == {1: b"", 2: bytes(255 - c for c in b"abc")}


def test_sliding_limit_by_counting():
    times = sorted(np.random.default_rng(5).integers(0, 60_000, 400).tolist())
    granted, waits = sequential.admitted(times, 5_000, 6, 3, 1_500)
    let_in: list[int] = []
    for now, good, wait in zip(times, granted, waits, strict=True):
        recent, running = [t for t in let_in if t > now - 5_000], [t for t in let_in if t + 1_500 > now]
        assert good == (len(recent) < 6 and len(running) < 3)
        assert wait == (0 if good else max(250, recent[0] + 5_000 - now if len(recent) >= 6 else 0, running[0] + 1_500 - now if len(running) >= 3 else 0))
        let_in += [now] if good else []


def test_cascade_takes_the_first_healthy_detector(spark):
    runs = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (2, 0, "a", True), (2, 1, "b", True), (3, 0, "a", False), (4, 0, "a", True)], "image_id long, place int, detector string, healthy boolean")
    found = [(1, "a", 0.9, 0, 0, 9, 9), (1, "b", 0.8, 0, 0, 9, 9), (1, "b", 0.7, 0, 0, 9, 8), (1, "b", 0.6, 50, 50, 60, 60), (2, "b", 0.9, 0, 0, 9, 9), (3, "a", 0.9, 0, 0, 9, 9), (4, "a", 0.5, 0, 0, 9, 9)]
    boxes = spark.createDataFrame(found, "image_id long, detector string, confidence double, x0 long, y0 long, x1 long, y1 long")
    got = {(r["image_id"], r["detector"], r["n"]) for r in sequential.cascade(runs, boxes).collect()}
    assert got == {(1, "b", 2), (2, "a", 0), (3, None, None), (4, "a", 1)}


def test_skew_of_lines(spark):
    lines = [(1, 100, 5)] * 4 + [(1, 3, 100), (2, 100, 5), (2, 100, 5), (2, 100, 5), (3, 100, 0)] + [(3, 100, 0)] * 4 + [(4, -100, -5)] * 5 + [(5, -5, 100)] * 5
    got = {r["image_id"]: round(r["turn"], 4) for r in evidence.skew_votes(spark.createDataFrame(lines, "image_id long, dx long, dy long")).collect()}
    tilt = round(float(np.degrees(np.arctan2(5, 100))), 4)
    # too few lines (2) and upright ones (3) give none
    assert got == {1: tilt, 4: tilt, 5: tilt}


def test_strings_of_json_and_common_texts(spark):
    nested = '{"a":"x\\"y","b":[1,"z:",{"c":"\\\\","d":null,"e :":"ü"}],"f":""}'
    rows = spark.createDataFrame([(nested,), ("7",), (None,), ('"' + "\\n" * 50_000 + '"',)], "j string").select(text.json_strings(F.col("j")).alias("s")).collect()
    assert [r["s"] for r in rows] == [['x"y', "z:", "\\", "ü", ""], [], None, ["\n" * 50_000]]
    pairs = spark.createDataFrame([("abcdef", "xcdey"), ("", "a"), (None, "a"), ("aaa", "aa")], "a string, b string")
    assert [r[0] for r in pairs.select(text.common_substring("a", "b")).collect()] == [3, 0, None, 2]
