"""Linear statistics and trend lines: exact cases, boundaries, brute force."""

import datetime as dt
import math

import numpy as np
import pytest

from fieldlab.operators import lines as L
from fieldlab.operators import trend

BASE = dt.date(2000, 1, 1)


def _clean_frame(spark, rows):
    """rows: (site, param, day_offset, value, dl)"""
    data = [(s, p, BASE + dt.timedelta(days=int(d)), float(v), dl, "None", f"{s} - {p}")
            for s, p, d, v, dl in rows]
    return spark.createDataFrame(data, "SamplingPoint string, WebParameter string, DateSampled date, "
                                       "FinalResult double, DL string, Qualifiers string, SiteParam string")


def test_perfect_line_and_boundaries(spark):
    rows = []
    rows += [("A", "P", d, 2.0 + 0.5 * d, "Measured value") for d in range(10)]      # perfect line
    rows += [("B", "P", d, 3.0, "Measured value") for d in range(10)]                 # constant y
    rows += [("C", "P", 5, float(v), "Measured value") for v in range(10)]            # constant x
    rows += [("D", "P", d, d * d, "Measured value") for d in range(7)]                # n = 7
    rows += [("E", "P", d, d * d, "Measured value") for d in range(8)]                # n = 8
    rows += [("F", "P", d, d, "Measured value") for d in range(7)] + [("F", "P", 9, 1, "<DL")]
    st = {r["Site"]: r for r in trend.linear_stats(_clean_frame(spark, rows)).collect()}
    assert set(st) == {"A", "B", "C", "E"}
    assert st["A"]["R_squared"] == pytest.approx(1.0)
    assert st["A"]["p_value"] == pytest.approx(0.0, abs=1e-12)
    assert st["B"]["R_squared"] is None and st["B"]["p_value"] is None
    assert st["C"]["R_squared"] is None and st["C"]["p_value"] is None
    assert st["E"]["N"] == 8


def test_against_numpy_ols(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(5):
        days = rng.integers(0, 3000, 40)
        vals = 0.002 * s * days + rng.normal(0, 1, 40)
        rows += [(f"S{s}", "P", int(d), float(v), "Measured value") for d, v in zip(days, vals)]
    st = {r["Site"]: r for r in trend.linear_stats(_clean_frame(spark, rows)).collect()}
    for s in range(5):
        sub = [(d, v) for site, _, d, v, _ in rows if site == f"S{s}"]
        x = np.array([d for d, _ in sub], float) + (BASE - dt.date(1970, 1, 1)).days
        y = np.array([v for _, v in sub])
        r2 = np.corrcoef(x, y)[0, 1] ** 2
        assert st[f"S{s}"]["R_squared"] == pytest.approx(r2, rel=1e-9)


def test_min_group_keeps_rows(spark):
    rows = [("A", "P", d, d, "Measured value") for d in range(8)] + \
           [("B", "P", d, d, "Measured value") for d in range(3)]
    out = trend.min_group(_clean_frame(spark, rows)).collect()
    assert len(out) == 8 and {r["SamplingPoint"] for r in out} == {"A"}


def test_linear_line_exact_and_band(spark):
    rows = [("A", "P", d * 10, 1.0 + 0.1 * d * 10, "Measured value") for d in range(12)]
    out = L.linear_line(_clean_frame(spark, rows), band=True).orderBy("i").collect()
    assert len(out) == 80
    epoch = (BASE - dt.date(1970, 1, 1)).days
    for r in out:
        assert r["yhat"] == pytest.approx(1.0 + 0.1 * (r["x"] - epoch), abs=1e-9)
        assert r["hi"] - r["lo"] == pytest.approx(0.0, abs=1e-6)
    assert out[0]["x"] == epoch and out[-1]["x"] == epoch + 110


def _loess_brute(x, y, span=0.8, points=80):
    """Direct local quadratic fit with tricube weights at each grid point."""
    n = len(x)
    q = int(np.floor(n * span))
    grid = x.min() + np.arange(points) * (x.max() - x.min()) / (points - 1)
    out = []
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        u = (x - g) / h
        X = np.vstack([np.ones(n), u, u * u]).T
        W = np.diag(w)
        beta = np.linalg.solve(X.T @ W @ X, X.T @ W @ y)
        out.append(beta[0])
    return grid, np.array(out)


def test_loess_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    days = np.sort(rng.choice(2000, 60, replace=False))
    days = np.concatenate([days, days[:10]])          # repeated dates
    vals = np.sin(days / 300.0) * 5 + rng.normal(0, 0.5, len(days))
    rows = [("A", "P", int(d), float(v), "<DL" if k % 7 == 0 else "Measured value")
            for k, (d, v) in enumerate(zip(days, vals))]
    out = L.loess_line(_clean_frame(spark, rows)).orderBy("i").collect()
    epoch = (BASE - dt.date(1970, 1, 1)).days
    grid, want = _loess_brute(days.astype(float) + epoch, vals)
    assert np.allclose([r["x"] for r in out], grid)
    assert np.allclose([r["yhat"] for r in out], want, atol=1e-8)


def test_loess_reproduces_quadratic(spark):
    rows = [("A", "P", d, 0.001 * d * d - 0.3 * d + 4, "Measured value") for d in range(0, 300, 7)]
    out = L.loess_line(_clean_frame(spark, rows)).collect()
    epoch = (BASE - dt.date(1970, 1, 1)).days
    for r in out:
        d = r["x"] - epoch
        assert r["yhat"] == pytest.approx(0.001 * d * d - 0.3 * d + 4, abs=1e-6)


def _t_quantile(nu, steps=20000):
    """97.5 % point of Student t by bisection on Simpson's rule in the angle."""
    c = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    lo, hi = 0.0, math.atan(12.8 / math.sqrt(nu))
    for _ in range(60):
        mid = (lo + hi) / 2
        f = np.cos(np.linspace(0.0, mid, steps + 1)) ** (nu - 1)
        mass = 2 * c * mid / steps / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
        lo, hi = (mid, hi) if mass < 0.95 else (lo, mid)
    return math.tan(lo) * math.sqrt(nu)


def _loess_band_brute(x, y, span=0.8, points=80):
    """Same definitions as the Spark band, by brute force in numpy; also
    returns delta1 from the exact operator matrix at the data points."""
    n = len(x)
    q = int(np.floor(n * span))

    def op_row(g):
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        u = (x - g) / h
        X = np.vstack([np.ones(n), u, u * u]).T
        Minv = np.linalg.inv(X.T @ (w[:, None] * X))
        return (Minv @ (X * w[:, None]).T)[0], Minv[0, 0]

    grid = x.min() + np.arange(points) * (x.max() - x.min()) / (points - 1)
    rows = [op_row(g) for g in grid]
    yhat = np.array([r[0] @ y for r in rows])
    kn2 = np.array([r[0] @ r[0] for r in rows])
    l00 = np.array([r[1] for r in rows])
    yd, ld, kd = (np.interp(x, grid, v) for v in (yhat, l00, kn2))
    rss = np.sum((y - yd) ** 2)
    delta1 = n - 2 * ld.sum() + kd.sum()
    s = np.sqrt(rss / delta1)
    tq = _t_quantile(delta1)
    Lfull = np.array([op_row(v)[0] for v in x])
    exact_delta1 = np.trace((np.eye(n) - Lfull).T @ (np.eye(n) - Lfull))
    return yhat, s * np.sqrt(kn2), tq, delta1, exact_delta1


def test_loess_band_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    days = np.sort(rng.choice(1500, 45, replace=False)).astype(float)
    vals = np.cos(days / 250.0) * 3 + rng.normal(0, 0.8, len(days))
    rows = [("A", "P", int(d), float(v), "Measured value") for d, v in zip(days, vals)]
    out = L.loess_line(_clean_frame(spark, rows), band=True).orderBy("i").collect()
    epoch = (BASE - dt.date(1970, 1, 1)).days
    yhat, se, tq, delta1, exact_delta1 = _loess_band_brute(days + epoch, vals)
    assert np.allclose([r["yhat"] for r in out], yhat, atol=1e-8)
    assert np.allclose([r["se"] for r in out], se, atol=1e-8)
    assert np.allclose([r["hi"] - r["yhat"] for r in out], tq * se, atol=1e-7)
    assert out[0]["df"] == pytest.approx(delta1, rel=1e-9)
    # Interpolating the influences between grid points stays close to the
    # exact residual degrees of freedom of the smoother.
    assert abs(delta1 - exact_delta1) / exact_delta1 < 0.02


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as hst  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(hst.lists(hst.tuples(hst.sampled_from("ABCD"), hst.integers(0, 30)), max_size=60),
       hst.integers(1, 9))
def test_min_group_property(spark, rows, n):
    data = [(s, "P", d, float(d), "Measured value") for s, d in rows]
    if not data:
        return
    out = trend.min_group(_clean_frame(spark, data), n=n).collect()
    counts = {}
    for s, _ in rows:
        counts[s] = counts.get(s, 0) + 1
    assert len(out) == sum(c for c in counts.values() if c >= n)
    assert all(counts[r["SamplingPoint"]] >= n for r in out)


def test_linear_band_degenerate_series(spark):
    rows = [("C", "P", 5, float(v), "Measured value") for v in range(10)]     # constant date
    rows += [("T", "P", d, float(d), "Measured value") for d in range(2)]     # two points
    out = L.linear_line(_clean_frame(spark, rows), band=True, min_n=2).collect()
    assert {r["SiteParam"] for r in out} == {"C - P", "T - P"}
    assert all(r["lo"] is None and r["hi"] is None for r in out)
    assert all(r["yhat"] is None for r in out if r["SiteParam"] == "C - P")


def test_loess_band_partly_degenerate_series(spark):
    # Rows piled on few dates: some grid points have no local fit, so the
    # band of the series is withheld rather than computed from part of RSS.
    rows = [("A", "P", d, float(d % 5 + k), "Measured value") for d in (0, 1, 200) for k in range(4)]
    rows += [("A", "P", 400, 1.0, "Measured value")]
    out = L.loess_line(_clean_frame(spark, rows), band=True).collect()
    assert any(r["yhat"] is None for r in out)
    assert all(r["lo"] is None and r["hi"] is None for r in out)
