"""Whitening against numpy on the whole matrix, and vectors of all odd kinds."""

import numpy as np
import pytest

from corpusloom.llm import whitening as wh

VECTORS = "vec_id long, embedding array<double>, label int"


def frame(spark, rows, clash=True):
    d = spark.createDataFrame(rows, VECTORS)
    if clash:
        for c in ("id", "x", "v", "n", "at", "block", "tile", "deviation", "component", "whitened"):
            d = d.withColumn(c, d.label)
    return d


def brute(vectors):
    x = np.floor(np.array(vectors) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    return x, n, s, values[::-1], parts[:, ::-1], fit


@pytest.mark.parametrize("d, tile", [(5, 2), (7, 32), (40, 16)])
def test_whitening_is_brute_force(spark, d, tile):
    r = np.random.default_rng(d)
    own = r.standard_normal((300, d)) * np.linspace(3, 0.5, d) + 1.7
    own = np.concatenate([own, own[:90], own[:90]])  # a third are copies
    got = wh.whiten(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(own)]), components=None, tile=tile, rows=37, held=2).collect()  # products are passed on before a task ends
    x, n, s, values, parts, _ = brute(own)
    assert len(got) == len(own) * d and {g.n for g in got} == {n} and {g.component for g in got} == set(range(1, d + 1))
    assert max(g.identity_error for g in got) < 1e-9
    white = np.zeros((len(own), d))
    for g in got:
        white[g.vec_id, g.component - 1] = g.whitened
        assert g.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x[g.vec_id], s))
        assert g.explained == pytest.approx(values[g.component - 1] / values.sum(), rel=1e-9)
    want = (x - s / n) @ parts / np.sqrt(values)
    for c in range(d):  # either sign
        sign = np.sign(white[:, c] @ want[:, c])
        assert np.abs(white[:, c] - sign * want[:, c]).max() < 1e-7


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [i * 0.1, -0.5 * (i % 3)], 0) for i in range(6)]
    odd = [(20, None, 0), (21, [], 0), (22, [None, 1.0], 0), (23, [nan, 1.0], 0), (24, [inf, 0.0], 0), (25, [1.0, 2.0, 3.0], 0)]
    got = wh.whiten(frame(spark, good + odd + [(None, [0.3, -0.2], None), (5, [0.5, -1.0], 0), (5, [0.5, -1.0], 0)])).collect()
    assert len(got) == 2 * 9 and sum(g.vec_id == 5 for g in got) == 6 and sum(g.vec_id is None for g in got) == 2
    assert {g.n for g in got} == {7}  # the repeated row is one of the fit list
    assert max(g.identity_error for g in got) < 1e-9


def test_without_variance(spark):
    one = wh.whiten(frame(spark, [(1, [0.5, 0.0], 0), (2, [0.5, -0.0], 0)])).collect()
    assert [(g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 0, None, None, None)] * 4
    flat = wh.whiten(frame(spark, [(1, [0.5, 0.1], 0), (2, [1.5, 0.1], 0)])).collect()
    assert sorted((g.component, g.whitened) for g in flat if g.component == 1) == [(1, -1.0), (1, 1.0)]
    assert all(g.whitened is None and g.explained == pytest.approx(0) for g in flat if g.component == 2) and flat[0].identity_error == 0.0
    assert wh.whiten(frame(spark, [])).collect() == [] and wh.whiten(frame(spark, [(1, None, 0)])).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0), (3, [5.0, 1e300], 0)]
    got = {g.vec_id: g for g in wh.whiten(frame(spark, rows), components=1).collect()}
    assert [got[i].deviation for i in (1, 2, 3)] == [None] * 3  # no long holds them
    rows = [(i, [float(i) * 3e3, -1.0], 0) for i in range(50)]
    got = wh.whiten(frame(spark, rows), components=1).collect()
    x, n, s, *_ = brute([v for _, v, _ in rows])
    assert [g.deviation for g in sorted(got, key=lambda g: g.vec_id)] == [sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
