"""Shapes and resampling against loops over single pixels."""

import math

import numpy as np
import pytest

from prismatic.operators import marks, resampling, shapes
from prismatic.operators.retouching import spots


def some(h, w, seed=0, smooth=False):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (h, w))
    if smooth:
        out = np.cumsum(rng.integers(-9, 10, (h, w)), axis=1) % 256
    return out.astype(np.int16)


@pytest.mark.parametrize(("width", "height"), [(3, 3), (7, 5), (3, 2), (1, 4), (31, 9)])
def test_gray_morphology(width, height):
    g = some(13, 17)

    def loop(values, of):
        out = np.zeros_like(values)
        for y in range(values.shape[0]):
            for x in range(values.shape[1]):
                rows = range(max(0, y - height // 2), min(values.shape[0], y - height // 2 + height))
                columns = range(max(0, x - width // 2), min(values.shape[1], x - width // 2 + width))
                out[y, x] = of(values[b, a] for b in rows for a in columns)
        return out

    more, less = loop(g, max), loop(g, min)
    assert (shapes.dilated(g, width, height) == more).all() and (shapes.eroded(g, width, height) == less).all()
    assert (shapes.closed(g, width, height) == loop(more, min)).all() and (shapes.opened(g, width, height) == loop(less, max)).all()
    if width == height:
        assert (shapes.standing_out(g, width) == np.maximum(g - loop(less, max), loop(more, min) - g)).all()


@pytest.mark.parametrize("radius", [1, 2, 4, 7])
def test_grown_masks(radius):
    mask = np.random.default_rng(radius).random((20, 23)) < 0.03
    expected = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy in range(-radius, radius + 1):
            reach = round(radius * math.sqrt((radius * radius - dy * dy) / radius**2))
            if 0 <= y + dy < 20:
                expected[y + dy, max(0, x - reach) : x + reach + 1] = True
    assert (shapes.grown(mask, radius) == expected).all()


@pytest.mark.parametrize("corners", [[(2, 2), (15, 3), (14, 10), (1, 9)], [(0, 0), (19, 0), (19, 11), (0, 11)], [(5, 1), (9, 10), (1, 4), (9, 4), (1, 10)], [(3, 3), (3, 8), (3, 5)]])
def test_filled_polygons(corners):
    points = np.array(corners)
    found = shapes.filled(points, 12, 20)
    for y in range(12):
        for x in range(20):
            crossings, on = 0, False
            for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], corners[0]], strict=True):
                if min(ya, yb) <= y < max(ya, yb):
                    crossings += xa + (y - ya) * (xb - xa) / (yb - ya) <= x
                steps = max(abs(xb - xa), abs(yb - ya))
                on |= any((round(xa + (xb - xa) * k / steps), round(ya + (yb - ya) * k / steps)) == (x, y) for k in range(steps + 1)) if steps else (xa, ya) == (x, y)
            assert found[y, x] == (crossings % 2 == 1 or on), (x, y)


def thin_edges(g, low, high):
    h, w = g.shape
    at = lambda y, x: float(g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx, dy, steep = {}, {}, {}
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (at(y + b, x + 1) - at(y + b, x - 1)) for b, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(y + 1, x + b) - at(y - 1, x + b)) for b, k in ((-1, 1), (0, 2), (1, 1)))
            steep[y, x] = abs(dx[y, x]) + abs(dy[y, x])
    thin = set()
    for (y, x), m in steep.items():
        if m <= low:
            continue
        angle = math.degrees(math.atan2(abs(dy[y, x]), abs(dx[y, x])))
        if angle < 22.5:
            good = m > steep.get((y, x - 1), 0) and m >= steep.get((y, x + 1), 0)
        elif angle > 67.5:
            good = m > steep.get((y - 1, x), 0) and m >= steep.get((y + 1, x), 0)
        else:
            s = -1 if dx[y, x] * dy[y, x] < 0 else 1
            good = m > steep.get((y - 1, x - s), 0) and m > steep.get((y + 1, x + s), 0)
        if good:
            thin.add((y, x))
    kept, todo = set(), [p for p in thin if steep[p] > high]
    while todo:
        p = todo.pop()
        if p not in kept:
            kept.add(p)
            todo += [q for q in ((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in thin]
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_thin_edges(seed):
    g = some(18, 22, seed, smooth=True)
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero(shapes.edges(g, 60, 180)), strict=True)} == thin_edges(g, 60, 180)
    assert not shapes.edges(np.full((9, 9), 7), 24, 72).any()


def test_straight_lines():
    mask = np.zeros((80, 120), bool)
    mask[20, 10:100] = True  # flat, with a gap that is crossed and one that isn't
    mask[20, 40:46] = False
    mask[20, 70:85] = False
    mask[np.arange(30, 75), 60] = True
    found = shapes.lines(mask, votes=20, shortest=12)
    assert (10, 20, 69, 20) in found and (85, 20, 99, 20) in found and any(a == b == 60 for a, _, b, _ in found)
    assert shapes.lines(mask[:10]) == []


def test_candidate_masks_of_marks():
    """Pale strokes in the bands are found, whole areas and coloured things aren't."""
    rgb = np.full((120, 200, 3), 120, np.uint8)
    for x in range(10, 190, 12):
        rgb[30:38, x : x + 2] = 240
        rgb[35:36, x : x + 3] = 240
        rgb[90:98, x : x + 2] = 30
        rgb[93:94, x : x + 3] = 30
    rgb[60:80, 20:60] = 250  # too dense
    rgb[62:70, 100:140:12] = (255, 20, 20)
    mask, sure = marks.candidate_mask(rgb)
    assert mask[34, 10:12].all() and mask[93, 10:13].all() and not mask[65, 30:50].any() and not mask[65, 100:140].any()
    assert 0.45 < sure <= 1
    assert marks.candidate_mask(rgb[:19])[1] == 0 and not marks.candidate_mask(np.full((60, 90, 3), 99, np.uint8))[0].any()


def test_candidate_masks_by_hand():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        rgb = (rng.integers(90, 130, (48, 70, 1)) + rng.integers(0, 12, (48, 70, 3))).astype(np.uint8)
        h, w = rgb.shape[:2]
        gray, found = marks.gray_bytes(rgb), np.zeros((h, w), bool)
        size = marks.odd(max(7, round(h * 0.045)))
        near = lambda g, y, x, of, a, b: of(g[v, u] for v in range(max(0, y - b), min(h, y + b + 1)) for u in range(max(0, x - a), min(w, x + a + 1)))
        r = size // 2
        less, more = (np.array([[near(gray, y, x, of, r, r) for x in range(w)] for y in range(h)]) for of in (min, max))
        for y in range(h):
            for x in range(w):
                contrast = max(gray[y, x] - near(less, y, x, max, r, r), near(more, y, x, min, r, r) - gray[y, x])
                high, low = int(rgb[y, x].max()), int(rgb[y, x].min())
                band = any(round(h * a) <= y < round(h * b) for a, b in marks.BANDS) and x < round(w * 0.96)
                found[y, x] = contrast >= 11 and round(255 * (high - low) / max(high, 1)) <= 105 and band
        grown = np.array([[any(found[v, u] for v in range(max(0, y - 1), y + 1) for u in range(max(0, x - 1), min(w, x + 2))) for x in range(w)] for y in range(h)])
        closed = np.array([[all(grown[v, u] for v in range(max(0, y - 1), y + 1) for u in range(max(0, x - 1), min(w, x + 2))) for x in range(w)] for y in range(h)])
        part, kept = spots(closed), np.zeros((h, w), bool)
        for n in range(1, part.max() + 1):
            y, x = np.nonzero(part == n)
            tall, wide = y.max() - y.min() + 1, x.max() - x.min() + 1
            if len(y) >= 3 and 2 <= tall <= h * 0.22 and wide <= w * 0.45 and len(y) / (tall * wide) <= 0.9:
                kept |= part == n
        cross = np.array([[any(0 <= y + b < h and 0 <= x + a < w and kept[y + b, x + a] for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) for x in range(w)] for y in range(h)])
        assert (marks.candidate_mask(rgb)[0] == cross).all()


def test_stroke_masks_stay_near_their_polygons():
    rng = np.random.default_rng(1)
    rgb = np.repeat(rng.integers(100, 110, (60, 150, 1)), 3, axis=2).astype(np.uint8)
    rgb[25:33, 20:110:5] = 230
    box = np.array([[15, 22], [112, 22], [112, 36], [15, 36]])
    mask, sure = marks.stroke_mask(rgb, [box])
    within = shapes.filled(box, 60, 150) | shapes.filled(np.array([[15, 22], [135, 22], [135, 36], [15, 36]]), 60, 150)
    assert mask[28, 20:110:5].all() and not (mask & ~shapes.grown(within, 4)).any()
    assert sure == pytest.approx(0.25 + 0.2 + 0.15)  # one polygon, in one band
    gray = marks.gray_bytes(rgb).astype(float)
    x = np.arange(9) - 4
    kernel = np.exp(-(x**2) / (2 * (0.3 * 3 + 0.8) ** 2))
    kernel /= kernel.sum()
    mirrored = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    strokes = np.zeros((60, 150), bool)
    for y in range(60):
        for x in range(150):
            around = sum(kernel[a] * kernel[b] * gray[mirrored(y + a - 4, 60), mirrored(x + b - 4, 150)] for a in range(9) for b in range(9))
            strokes[y, x] = gray[y, x] - round(around) >= 7 or gray[y, x] - round(around) <= -10
    for y, x in thin_edges(gray, 24, 72):
        strokes[y, x] = True
    assert (mask == shapes.grown(strokes & within, 4)).all()
    assert marks.stroke_mask(rgb, [])[1] == 0 and marks.stroke_mask(rgb, [box[:2]])[1] == 0


@pytest.mark.parametrize("kernel", [resampling.sinc3, resampling.cubic, resampling.triangle, resampling.box])
@pytest.mark.parametrize(("before", "after"), [(10, 10), (10, 7), (7, 23), (40, 3), (3, 1)])
def test_weights_as_a_loop(kernel, before, after):
    found = resampling.weights(before, after, kernel)
    scale = before / after
    for i in range(after):
        middle, widen = (i + 0.5) * scale, max(scale, 1.0)
        reach = resampling.REACH[kernel] * widen
        row = [float(kernel(np.array((k + 0.5 - middle) / widen))) if max(0, math.floor(middle - reach + 0.5)) <= k < min(before, math.floor(middle + reach + 0.5)) else 0.0 for k in range(before)]
        assert found[i] == pytest.approx([v / sum(row) for v in row])
    if before == after:
        assert found == pytest.approx(np.eye(before))


def test_sizes_in_closed_form():
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert (resampling.resized(flat, 20, 11) == 77).all() and resampling.at_least(flat, 200).shape == (120, 200, 3) and resampling.within(flat, 25).shape == (15, 25, 3)
    assert resampling.at_least(flat, 50) is flat and resampling.within(flat, 50) is flat
    ramp = np.repeat(np.arange(0, 200, 2)[None, :], 40, axis=0).astype(np.uint8)
    wide = resampling.resized(ramp, 200, 40)
    assert np.abs(wide[:, 8:-8].astype(float) - (np.arange(200) * 1.0 - 0.5)[None, 8:-8]).max() <= 1
    assert (resampling.resized(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2, resampling.box) == np.rint([[2.5, 4.5], [10.5, 12.5]])).all()


@pytest.mark.parametrize("degrees", [-4.0, -1.5, 0.5, 3.0])
def test_turned_ramps(degrees):
    """A plane of gray turns into the plane that the turn says, scaled by what is cut off."""
    h, w = 120, 160
    y, x = np.mgrid[0:h, 0:w]
    image = np.rint(60 + 0.5 * x + 0.3 * y).astype(np.uint8)
    out = resampling.turned(image, degrees).astype(float)
    assert out.shape == image.shape
    a = math.radians(degrees)
    full_w, full_h = math.ceil(w * math.cos(a) + h * abs(math.sin(a))), math.ceil(h * math.cos(a) + w * abs(math.sin(a)))
    inset = math.ceil(w * math.sin(abs(a))) + 2
    u = ((x + 0.5) / w - 0.5) * (full_w - 2 * inset)
    v = ((y + 0.5) / h - 0.5) * (full_h - 2 * inset)
    expected = 60 + 0.5 * (u * math.cos(a) - v * math.sin(a) + w / 2 - 0.5) + 0.3 * (u * math.sin(a) + v * math.cos(a) + h / 2 - 0.5)
    assert np.abs(out - expected)[6:-6, 6:-6].max() <= 1.6
    assert resampling.turned(image[:5, :5], 30.0).shape == (5, 5)
