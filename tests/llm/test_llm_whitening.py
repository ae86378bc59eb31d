"""Whitening against numpy's eigenvectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most):
    good = [(k, v) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    m = int((e[:most] > 1e-9 * e.sum()).sum())
    return [k for k, _ in good], ((n * x - total) ** 2).sum(1), centred @ v[:, :m] / np.sqrt(e[:m]), e[:m] / e.sum()


def check(spark, rows, most, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"component": F.lit(7), "n": F.lit("clash"), **more})
    out = whitening.whiten(df, most=most).collect()
    ids, deviation, whitened, explained = brute(rows, most)
    m = len(explained)
    assert len(out) == len(ids) * m
    assert {r["n"] for r in out} == {len(ids)}
    assert {r["identity_error"] for r in out}.pop() < 1e-9
    for c in range(m):
        mine = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in out if r["component"] == c + 1)
        for sign in (1, -1):
            want = sorted((k is not None, k or 0, int(d), sign * y) for k, d, y in zip(ids, deviation, whitened[:, c], strict=True))
            if np.allclose([r[3] for r in mine], [r[3] for r in want], atol=1e-7):
                break
        else:
            raise AssertionError(f"component {c + 1}")
        assert [r[:3] for r in mine] == [r[:3] for r in want]
        assert {r["explained"] for r in out if r["component"] == c + 1}.pop() == pytest.approx(explained[c], rel=1e-9)


def test_bad_rows(spark):
    rng = np.random.default_rng(1)
    scale = np.array([9, 4, 3, 2, 1.5, 1, 0.7, 0.5])
    rows = [(k, (rng.normal(size=8) * scale + 3).tolist()) for k in range(300)]
    rows += [rows[3], (4, rows[3][1]), (None, rows[5][1]), (900, None), (901, [1.0, None, *[0.0] * 6]), (902, [float("nan")] * 8), (903, [float("inf")] * 8)]
    check(spark, rows, 32)
    check(spark, rows, 3)


def test_low_rank(spark):
    """Directions without variance are no components; equal variances are all found."""
    rng = random.Random(2)
    rows = [(k, [a, -a, b, 2.0, a + b, 0.0]) for k in range(90) for a, b in [(rng.randrange(-9, 9) / 4, rng.randrange(-9, 9) / 4)]]
    check(spark, rows, 32)
    corners = [(k, [float(s * (j == i)) for j in range(4)]) for k, (i, s) in enumerate((i, s) for i in range(4) for s in (1, -1))]
    out = whitening.whiten(spark.createDataFrame(corners, SCHEMA)).collect()
    assert len(out) == 8 * 4
    assert all(abs(r["explained"] - 0.25) < 1e-9 and r["identity_error"] < 1e-9 for r in out)


def test_stops_early(spark):
    """With a falling spectrum fewer steps than dimensions are made, and the components are right."""
    rng = np.random.default_rng(3)
    scale = 100 * 0.5 ** np.arange(40)
    rows = [(k, (rng.normal(size=40) * scale).tolist()) for k in range(400)]
    packed = whitening.Packed(spark.createDataFrame(rows, SCHEMA), "embedding")
    steps = []
    real = packed.added
    packed.added = lambda *a: steps.append(1) or real(*a)
    whitening.bidiagonalise(packed, 4)
    assert len(steps) < 40
    check(spark, rows, 4)


def test_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_other_lengths_and_large_entries(spark):
    rows = [(k, [float(k), float(k % 3)]) for k in range(9)] + [(50, [1.0]), (51, [1.0, 2.0, 3.0]), (52, [])]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in out} == set(range(9))
    large = [(k, [1e30 * (k - 2), float(k)]) for k in range(5)]
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in whitening.whiten(spark.createDataFrame(large, SCHEMA)).collect())


def test_deviations():
    x = np.array([[5, -7], [2**40, 1], [2**50, 2]])
    assert whitening.deviations(x, 3, [10, 20]).to_pylist() == [(15 - 10) ** 2 + (-21 - 20) ** 2, None, None]
    assert whitening.deviations(x[:1], 3, [2**63, 20]).to_pylist() == [None]
