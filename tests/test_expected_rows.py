"""Registered queries without SQL against plain loops over the same inputs."""

import math
from collections import Counter, defaultdict

import pytest

from prismatic.catalog import QUERIES
from prismatic.plans.registry import assets
from prismatic.plans.sequences import predictions


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    size = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
    return both / max(1e-9, size(a) + size(b) - both)


@pytest.fixture(scope="module")
def found_and_true(spark, data):
    p, t = predictions(spark, data)
    box = lambda r: tuple(float(r[c]) for c in ("x0", "y0", "x1", "y1"))
    return [(r["id"], r["image_id"], r["class"], r["confidence"], box(r)) for r in p.collect()], [(r["id"], r["image_id"], r["class"], box(r)) for r in t.collect()]


def outcomes(found_and_true):
    p, t = found_and_true
    groups = defaultdict(lambda: ([], []))
    for r in p:
        groups[r[1], r[2]][0].append(r)
    for r in t:
        groups[r[1], r[2]][1].append(r)
    out = Counter()
    for key, (ps, ts) in groups.items():
        free = sorted(ts, key=lambda r: r[3])
        for r in sorted(ps, key=lambda r: (-r[3], r[4])):
            best = max(free, key=lambda x: overlap(r[4], x[3]), default=None)
            if best is not None and overlap(r[4], best[3]) >= 0.5:
                free.remove(best)
                out[(*key, "tp")] += 1
            else:
                out[(*key, "fp")] += 1
        out[(*key, "fn")] += len(free)
    return out


def test_j21_and_d14(spark, data, found_and_true):
    expected = outcomes(found_and_true)
    rows = QUERIES["j21_detection_matches"](spark, data).collect()
    assert {(r["image_id"], r["class"], r["outcome"]): r["n"] for r in rows if r["n"]} == {k: n for k, n in expected.items() if n}
    totals = Counter()
    for (_, kind, outcome), n in expected.items():
        totals[kind, outcome] += n
    for r in QUERIES["d14_detector_report"](spark, data).collect():
        tp, fp, fn = (totals[r["class"], o] for o in ("tp", "fp", "fn"))
        assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (tp, fp, fn, round(tp / max(1, tp + fp), 6), round(tp / max(1, tp + fn), 6))


def test_j22(spark, data, found_and_true):
    p, t = found_and_true
    expected = set()
    for image in {r[1] for r in p} | {r[1] for r in t}:
        pairs = [(overlap(x[3], y[4]), x[0], y[0]) for x in t if x[1] == image for y in p if y[1] == image]
        while pairs := [x for x in pairs if x[0] >= 0.5]:
            best = max(pairs)
            expected.add((image, best[1], best[2], round(best[0], 9)))
            pairs = [x for x in pairs if x[1] != best[1] and x[2] != best[2]]
    assert {(r["image_id"], r["expected_id"], r["predicted_id"], round(r["overlap"], 9)) for r in QUERIES["j22_best_first_matches"](spark, data).collect()} == expected


def test_i27(spark, data, found_and_true):
    p, _ = found_and_true
    expected = set()
    for key in {(r[1], r[2]) for r in p}:
        kept = []
        for r in sorted((r for r in p if (r[1], r[2]) == key), key=lambda r: (-r[3], r[4])):
            if all(overlap(r[4], k[4]) <= 0.45 for k in kept):
                kept.append(r)
        expected |= {k[0] for k in kept}
    assert {r["id"] for r in QUERIES["i27_suppressed_boxes"](spark, data).collect()} == expected


def chosen(rows, limit):
    """The asset most like the mean direction, then always the one whose nearest chosen one is least like it; ties to the smaller id."""
    unit = {}
    for i, v in sorted(rows):
        size = math.sqrt(math.fsum(x * x for x in v))
        if v and math.isfinite(size) and size > 0:
            unit[i] = [x / size for x in v]
    if not unit:
        return []
    mean = [math.fsum(x) / len(unit) for x in zip(*unit.values(), strict=True)]
    dot = lambda a, b: round(math.fsum(x * y for x, y in zip(a, b, strict=True)), 9)
    out = [max(sorted(unit), key=lambda i: dot(unit[i], mean))]
    while len(out) < min(limit, len(unit)):
        out.append(min((i for i in sorted(unit) if i not in out), key=lambda i: max(dot(unit[i], unit[o]) for o in out)))
    return out


def test_v4(spark, data):
    groups = defaultdict(list)
    for r in assets(spark, data).collect():
        groups[r["group_id"]].append((r["asset_id"], r["vector"]))
    found = defaultdict(dict)
    for r in QUERIES["v4_prototypes"](spark, data).collect():
        found[r["group_id"]][r["rank"]] = r["asset_id"]
    assert {g: [a for _, a in sorted(x.items())] for g, x in found.items()} == {g: chosen(x, 12) for g, x in groups.items()}
