"""Interpolated LOESS against an explicit operator built row by row."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlab.functions import loess
from fieldlab.operators import lines as L

EPOCH = dt.date(1970, 1, 1)


def plain_vertices(x, most):
    """Cells as lists of rows, cut at the gap nearest to the middle row."""
    lo, hi = min(x), max(x)
    mu = 0.005 * max(hi - lo, max(abs(lo), abs(hi)) * 1e-3 + 1e-30)
    out = [lo - mu, hi + mu]

    def cut(rows):
        if len(rows) <= most:
            return
        middle = (len(rows) + 1) // 2
        gaps = [j for j in range(1, len(rows)) if rows[j - 1] != rows[j]]
        if not gaps:
            return
        at = min(gaps, key=lambda j: (abs(j - middle), -j))
        out.append((rows[at - 1] + rows[at]) / 2)
        cut(rows[:at])
        cut(rows[at:])

    cut(sorted(x))
    return np.array(sorted(out))


def plain_operator(x, at, span):
    """Matrix (points x rows) of the interpolated fit, by weighted least squares at each vertex."""
    x = np.asarray(x, float)
    n = len(x)
    v = plain_vertices(list(x), int(n * span * 0.2))
    value, slope = [], []
    for p in v:
        d = np.abs(x - p)
        h = np.sort(d)[min(n, int(np.floor(n * span + 1e-5))) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        basis = np.vander((x - p) / h, 3, increasing=True)
        fit = np.linalg.pinv(basis * np.sqrt(w)[:, None]) * np.sqrt(w)
        value.append(fit[0])
        slope.append(fit[1] / h)
    rows = []
    for g in at:
        k = max(int(np.searchsorted(v, g)) - 1, 0)
        wd = v[k + 1] - v[k]
        t = (g - v[k]) / wd
        rows.append((1 - t) ** 2 * (1 + 2 * t) * value[k] + t * t * (3 - 2 * t) * value[k + 1]
                    + wd * (t * (1 - t) ** 2 * slope[k] - t * t * (1 - t) * slope[k + 1]))
    return np.array(rows)


def reduced(x, y):
    u, inv = np.unique(x, return_inverse=True)
    return u.astype(float), np.bincount(inv), np.bincount(inv, y), np.bincount(inv, y * y)


def series(n, seed, step=3):
    rng = np.random.default_rng(seed)
    x = 9000 + np.sort(rng.integers(0, step * n, n))
    return x, np.round(20 + 5 * np.sin(x / 40) + rng.normal(size=n), 3)


@pytest.mark.parametrize("n,step", [(8, 5), (25, 3), (60, 1), (140, 2)])
def test_line_and_traces(n, step):
    x, y = series(n, n, step)
    got = loess.surface(*reduced(x, y), 80, 0.8, band=True)
    assert np.allclose(got["yhat"], plain_operator(x, got["x"], 0.8) @ y, atol=1e-7)
    op = plain_operator(x, x, 0.8)
    rest = (np.eye(n) - op) @ (np.eye(n) - op).T
    assert got["delta1"] == pytest.approx(np.trace(rest), rel=1e-8)
    assert got["delta2"] == pytest.approx(np.trace(rest @ rest), rel=1e-8)
    assert got["s"] == pytest.approx(np.sqrt(((y - op @ y) ** 2).sum() / np.trace(rest)), rel=1e-7)
    assert np.allclose(got["norm"], np.linalg.norm(plain_operator(x, got["x"], 0.8), axis=1), atol=1e-8)


def test_a_quadratic_is_reproduced():
    """Local quadratic fits blended by cubics leave a parabola as it is."""
    x = np.arange(9000, 9200, 3)
    y = 2.0 + 0.3 * (x - 9100) - 0.01 * (x - 9100) ** 2
    got = loess.surface(*reduced(x, y), 80, 0.8, band=True)
    assert np.allclose(got["yhat"], 2.0 + 0.3 * (got["x"] - 9100) - 0.01 * (got["x"] - 9100) ** 2, atol=1e-7)
    assert got["s"] < 1e-4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80), st.integers(1, 30))
def test_vertices(days, most):
    x, rows = np.unique(np.array(days, float), return_counts=True)
    assert np.allclose(loess.vertices(x, rows, most), plain_vertices([float(d) for d in days], most))


def test_vertices_do_not_grow_with_the_series():
    for n in (200, 2_000, 20_000):
        assert len(loess.vertices(np.arange(float(n)), np.ones(n, int), np.floor(n * 0.8 * 0.2))) == 9


def frame(spark, rows):
    return spark.createDataFrame([(s, EPOCH + dt.timedelta(days=int(d)) if d is not None else None, v) for s, d, v in rows],
                                 "SiteParam string, DateSampled date, FinalResult double").repartition(3)


def test_band_over_series(spark):
    rows, want = [], {}
    for s, n in (("a", 30), ("b", 75), (None, 9)):
        x, y = series(n, n + 1)
        rows += [(s, d, float(v)) for d, v in zip(x, y)]
        want[s] = (x, y)
    rows += [("a", None, 3.0), ("b", 9_005, None), ("few", 9_000, 1.0), ("few", 9_001, 2.0)]
    rows += [("one date", 9_000, float(k)) for k in range(12)]
    got = L.loess_surface(frame(spark, rows), band=True).collect()
    assert {r.SiteParam for r in got} == {"a", "b", None, "one date"} and len(got) == 4 * 80
    for r in got:
        if r.SiteParam == "one date":
            assert r.yhat is None and r.se is None and r.df is None
    for s, (x, y) in want.items():
        mine = sorted((r for r in got if r.SiteParam == s), key=lambda r: r.i)
        op = plain_operator(x, x, 0.8)
        rest = (np.eye(len(x)) - op) @ (np.eye(len(x)) - op).T
        d1, d2 = np.trace(rest), np.trace(rest @ rest)
        assert all(r.df == pytest.approx(d1 * d1 / d2, rel=1e-6) for r in mine)
        rows_at = plain_operator(x, [r.x for r in mine], 0.8)
        se = np.sqrt(((y - op @ y) ** 2).sum() / d1) * np.linalg.norm(rows_at, axis=1)
        assert np.allclose([r.yhat for r in mine], rows_at @ y, atol=1e-7) and np.allclose([r.se for r in mine], se, atol=1e-7)
        assert all(r.lo < r.yhat < r.hi and r.hi - r.yhat == pytest.approx(r.yhat - r.lo) for r in mine)


def test_line_without_rows(spark):
    empty = frame(spark, []).where("false")
    assert L.loess_surface(empty).count() == 0 and L.loess_surface(empty, band=True).count() == 0


def test_one_exchange_by_series(spark):
    """Rows are reduced per date before the only exchange by series."""
    line = L.loess_surface(frame(spark, [("a", 9_000, 1.0)]))
    plan = line._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(SiteParam") == 2
    assert plan.index("FlatMapGroupsInArrow") < plan.index("HashAggregate")
