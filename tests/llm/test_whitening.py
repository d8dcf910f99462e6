"""Whitening against plain linear algebra, and odd rows."""

import math

import numpy as np
import pytest

from sitetide.llm import whitening as w

KIND = "vec_id long, embedding array<float>, label int, x int, w string"


def plain(vectors):
    x = np.floor(256 * np.array(vectors, np.float64)) + 0
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, turn = np.linalg.eigh(v)
    e, turn = e[::-1], turn[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ turn, e, np.trace(v)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + rng.normal(size=6)).astype(np.float32).tolist()
    return [*x, *[x[0]] * 150]


def test_equals_plain_algebra(spark, vectors):
    rows = [(i, v, i, 0, "") for i, v in enumerate(vectors)]
    got = w.whiten(spark.createDataFrame(rows, KIND).repartition(5)).toPandas()
    n, dev, turned, e, total = plain(vectors)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and set(got.component) == {1, 2, 3, 4}
    assert all(int(dev[i]) == d for i, d in zip(got.vec_id, got.deviation, strict=True))
    for k in range(4):
        part = got[got.component == k + 1].sort_values("vec_id")
        want = turned[:, k] / math.sqrt(e[k])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-9
        assert np.allclose(part.explained, e[k] / total, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_odd_rows_go(spark, vectors):
    bad = [(900, None), (901, [math.nan] * 6), (902, [math.inf] * 6), (903, [None, *[1.0] * 5]), (904, [1.0]), (905, [])]
    rows = [(i, v, 1, 0, "") for i, v in [*enumerate(vectors), *bad, (None, vectors[5]), (7, vectors[5])]]
    got = w.whiten(spark.createDataFrame(rows, KIND)).toPandas()
    assert len(got) == 4 * (len(vectors) + 2) and not set(got.vec_id.dropna()) & {i for i, _ in bad}
    assert got.vec_id.isna().sum() == 4 and set(got.n) == {300}


def test_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, -0.0], 1, 0, "") for i in range(9)]
    got = w.whiten(spark.createDataFrame(rows, KIND)).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1) and got.identity_error[0] < 1e-9


def test_no_direction(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, 0, "") for i in range(3)], KIND)
    for df in (same, same.limit(0), same.selectExpr("vec_id", "cast(null as array<float>) embedding", "label", "x", "w")):
        found = w.whiten(df)
        assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 1000) * 1e6, float(i)], 1) for i in range(50)]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    x = [[int(v * 256) for v in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((50 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    for i, d in zip(got.vec_id, got.deviation, strict=True):
        assert (d is None or math.isnan(d)) if want[int(i)] >= 1 << 63 else int(d) == pytest.approx(want[int(i)], rel=1e-15)
