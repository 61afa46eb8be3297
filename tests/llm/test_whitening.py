"""Whitening against numpy's own eigenvectors, and exact sums against Python's."""

import math
from fractions import Fraction

import numpy as np
import pytest

from prismatic.llm.queries import QUERIES
from prismatic.llm.whitening import jacobi, whitened

KIND = "vec_id long, embedding array<float>, x string, component int"


def as_plain(rows, found, components=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for x in {tuple(x) for _, x in kept}]
    width = max(set(lengths), key=lambda w: (lengths.count(w), w))
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x) for x in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    by_component = {}
    for r in found:
        by_component.setdefault(r["component"], []).append(r)
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / v.trace()) < 1e-9 and r["identity_error"] < 1e-9
    assert sorted(by_component) == list(range(1, k + 1))
    own = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), x) for i, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for c, these in by_component.items():
        these = sorted(these, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]))
        assert [(r["vec_id"], r["deviation"]) for r in these] == [r[:2] for r in own]
        expected = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums, strict=True)] for *_, x in own]) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        got = np.array([r["whitened"] for r in these])
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-8


def test_hard_rows(spark):
    rng = np.random.default_rng(5)
    scale = np.array([30, 10, 3, 1, 1, 0.5, 0.2, 0.1])
    rows = [(k, (rng.standard_normal(8) * scale).astype(np.float32).tolist()) for k in range(300)]
    rows += [(k, rows[k % 3][1]) for k in range(300, 340)] + [rows[5], rows[5], (None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [None] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    as_plain(rows, whitened(frame.repartition(5)).collect())


def test_how_rows_are_dealt_does_not_matter(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    a, b = (sorted(whitened(f).select("vec_id", "component", "deviation", "explained").collect()) for f in (frame.coalesce(1), frame.repartition(7)))
    assert a == b
    as_plain([(r["vec_id"], r["embedding"]) for r in frame.collect()], QUERIES["op12_whitening"](spark, data).collect())


def test_directions_without_spread_are_left_out(spark):
    rows = [(k, [float(k % 5), 2.0, float(k % 5)]) for k in range(20)]
    found = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 20
    assert whitened(spark.createDataFrame(rows[:1] * 3, "vec_id long, embedding array<double>")).isEmpty()
    assert whitened(spark.createDataFrame([], "vec_id long, embedding array<double>")).isEmpty()


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_small_eigenvalues_are_as_accurate_as_large_ones(spread):
    """A graded matrix whose eigenvalues are known to a hundred digits by their product and sum."""
    d = np.array([spread, 1.0, 1 / spread])
    base = np.array([[2.0, 0.5, 0.25], [0.5, 2.0, 0.5], [0.25, 0.5, 2.0]])
    values, vectors = jacobi(base * np.outer(d, d))
    exact = Fraction(1)
    f = [[Fraction(x) for x in row] for row in (base * np.outer(d, d)).tolist()]
    exact = f[0][0] * (f[1][1] * f[2][2] - f[1][2] ** 2) - f[0][1] * (f[0][1] * f[2][2] - f[1][2] * f[0][2]) + f[0][2] * (f[0][1] * f[1][2] - f[1][1] * f[0][2])
    assert abs(math.prod(Fraction(float(v)) for v in values) / exact - 1) < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(3)).max() < 1e-14
