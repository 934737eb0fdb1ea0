"""Student-t p-values and quantiles without scipy."""

import math

import pytest

from fieldlab.functions import tdist

# Two-sided 5 % critical values of Student t (standard tables).
CRIT_05 = {2: 4.302652729749464, 7: 2.364624251592785, 9: 2.262157162798205,
           10: 2.228138851986274, 15: 2.131449545559774, 30: 2.042272456301238}


def _t_pdf(t, nu):
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return math.exp(c - (nu + 1) / 2 * math.log1p(t * t / nu))


def _p_numeric(t, nu, steps=20000):
    # 2 * integral_t^inf pdf, by substitution u = 1/(1+x), Simpson's rule.
    a, b = 0.0, 1.0 / (1.0 + t)
    h = (b - a) / steps
    tot = 0.0
    for k in range(steps + 1):
        u = a + k * h
        x = 1.0 / u - 1.0 if u > 0 else None
        # limit at u = 0 (x -> inf): 1/pi for nu = 1, else 0
        f = (1 / math.pi if nu == 1 else 0.0) if x is None else _t_pdf(x, nu) / (u * u)
        w = 1 if k in (0, steps) else (4 if k % 2 else 2)
        tot += w * f
    return 2 * tot * h / 3


def _p_spark(spark, cases):
    df = spark.createDataFrame([(float(r2), int(n)) for r2, n in cases], "r2 double, n long")
    return [r[0] for r in df.select(tdist.slope_p_value("r2", "n")).collect()]


def test_critical_values(spark):
    cases = [(t * t / (nu + t * t), nu + 2) for nu, t in CRIT_05.items()]
    for p in _p_spark(spark, cases):
        assert abs(p - 0.05) < 1e-9


def test_against_integration(spark):
    cases = []
    for nu in (1, 3, 6, 8, 25, 101, 400):
        for t in (0.3, 1.1, 2.5):
            cases.append((t * t / (nu + t * t), nu + 2, _p_numeric(t, nu)))
    got = _p_spark(spark, [(a, b) for a, b, _ in cases])
    for (_, _, want), p in zip(cases, got):
        assert abs(p - want) < 1e-6


def test_edges(spark):
    got = _p_spark(spark, [(1.0, 10), (0.0, 10), (0.0, 11), (0.5, 2)])
    assert got[0] == pytest.approx(0.0, abs=1e-15)
    assert got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(1.0)
    assert got[3] is None  # no residual degrees of freedom


def test_large_nu(spark):
    # At this size the t distribution differs from the normal by under 1e-6.
    nu = 4_000_000
    t = 1.959963984540054
    p = _p_spark(spark, [(t * t / (nu + t * t), nu + 2)])[0]
    assert abs(p - 0.05) < 1e-6
    # Just above sizes where a finite series gets long: no jump.
    ps = _p_spark(spark, [(9.0 / (n - 2 + 9.0), n) for n in (99_999, 100_000, 100_001, 100_002)])
    assert max(ps) - min(ps) < 1e-8
    assert ps == sorted(ps, reverse=True)


def test_small_p_values_keep_relative_accuracy(spark):
    # Even nu: the exact tail sum of the finite series, in rational numbers.
    from fractions import Fraction as Fr

    def tail(num, den, nu):
        # P(|T| > t) = 1 - s * sum_k c_k (1 - s^2)^k with s^2 = r2 a square.
        s = Fr(num, den)
        c2, term, total = 1 - s * s, Fr(1), Fr(1)
        for k in range(1, nu // 2):
            term *= c2 * Fr(2 * k - 1, 2 * k)
            total += term
        return float(1 - s * total)

    cases = [(7, 10, 200), (7, 10, 120), (1, 2, 200), (9, 10, 400), (1, 20, 50)]
    got = _p_spark(spark, [((a / b) ** 2, nu + 2) for a, b, nu in cases])
    for (a, b, nu), p in zip(cases, got):
        assert p == pytest.approx(tail(a, b, nu), rel=1e-9)


def _quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return {r["v"]: r["tq"] for r in tdist.with_t_quantile(df, "v").collect()}


def test_quantiles(spark):
    got = _quantiles(spark, CRIT_05)
    for nu, t in CRIT_05.items():
        assert got[nu] == pytest.approx(t, abs=1e-11)
    big = _quantiles(spark, [1e7])[1e7]
    assert big == pytest.approx(tdist.normal_quantile(0.975), abs=1e-6)


def test_tiny_r2_no_division_by_zero(spark):
    got = _p_spark(spark, [(1e-18, 100), (1e-300, 101), (5e-17, 1000)])
    assert all(abs(p - 1.0) < 1e-6 for p in got)


def test_real_df_quantile(spark):
    got = _quantiles(spark, [0.0, -1.0, 0.9, 1.0, 1.5, 2.5, 3.5, 7.25, 350.5])
    assert got[0.0] is None and got[-1.0] is None
    assert got[1.0] == pytest.approx(math.tan(math.pi * 0.475), rel=1e-12)
    for nu, want in ((0.9, 16.58), (1.5, 6.017), (2.5, 3.575), (3.5, 2.940)):
        assert got[nu] == pytest.approx(want, abs=1e-3)
    for nu in (1.5, 2.5, 3.5, 7.25, 350.5):
        assert _p_numeric(got[nu], nu) == pytest.approx(0.05, abs=1e-5)
