"""Student-t tail probabilities and quantiles from built-in expressions.

The two-sided tail of Student's t with nu degrees of freedom is the
regularized incomplete beta function

  P(|T| > t) = I_x(nu/2, 1/2),   x = nu / (nu + t^2),

and for the slope of a simple regression x = 1 - r2.  Below the usual
crossing point of x the tail comes from the continued fraction of I_x (DLMF
8.17.22), so tiny p-values keep their relative accuracy; above it (p over
0.08) from the power series of 1 - I_x.  Both have a fixed number of terms
that suffices for every nu, because one parameter is always 1/2.  Quantiles
invert the same function by Newton's method in log t.  All of it runs per
group on the aggregated statistics, never per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRACTION_TERMS = 60
SERIES_TERMS = 60
NEWTON_STEPS = 5
# Arguments below this are shifted up before the asymptotic gamma ratio.
SHIFT = 20


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): asymptotic expansion at a + SHIFT, brought
    back by the recurrence of the gamma function."""
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0),
                       lambda acc, j: acc * (a + j) / (a + j + 0.5))
    z = a + float(SHIFT)
    z2 = z * z
    tail = (-1 / 8 + (1 / 192 + (-1 / 640 + (17 / 14336 - 31 / 18432 / z2) / z2) / z2) / z2) / z
    return down * F.sqrt(z) * F.exp(tail)


def _weight(a: Column, y: Column, log_x: Column, ratio: Column) -> Column:
    """x^a (1 - x)^(1/2) / B(a, 1/2)."""
    return F.exp(a * log_x) * F.sqrt(y) * ratio / math.sqrt(math.pi)


def _tail(a: Column, x: Column, y: Column, w: Column) -> Column:
    """I_x(a, 1/2) with y = 1 - x and the weight ``w`` of the point."""
    def back(v, m):
        even = (m + 1) * (-0.5 - m) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
        odd = -(a + m) * (a + m + 0.5) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1.0 + odd / (1.0 + even / v)

    def forward(acc, k):
        term = acc["t"] * (a - 0.5 + k) / (k + 0.5) * y
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    down = F.sequence(F.lit(FRACTION_TERMS), F.lit(0), F.lit(-1))
    small = w / (a * F.aggregate(down, F.lit(1.0), back))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), one, forward, lambda acc: acc["s"])
    return F.when(x < (a + 1.0) / (a + 2.5), small).otherwise(1.0 - 2.0 * w * series)


def slope_p_value(r2, n) -> Column:
    """Two-sided p-value of the regression slope from r2 and the row count
    (NULL without residual degrees of freedom or r2)."""
    r2 = F.col(r2) if isinstance(r2, str) else r2
    n = F.col(n) if isinstance(n, str) else n
    nu = (n - 2).cast("double")
    y = F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0))
    a = nu / 2.0
    w = _weight(a, y, F.log1p(-y), _gamma_ratio(a))
    p = F.when(y >= 1.0, F.lit(0.0)).otherwise(_tail(a, 1.0 - y, y, w))
    return F.when((nu >= 1) & r2.isNotNull() & ~F.isnan(r2), F.greatest(p, F.lit(0.0)))


def normal_quantile(p: float) -> float:
    """Standard normal quantile by bisection on erfc (driver-side, scalar)."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_quantile(nu, level: float = 0.95) -> Column:
    """Two-sided ``level`` quantile for any real nu > 0, else NULL (0.95:
    the value that |T| exceeds with probability 0.05).

    ln P(|T| > e^s) is concave and falls in s, so Newton's method converges
    from any start; the first Cornish-Fisher term is close for every nu."""
    v = (F.col(nu) if isinstance(nu, str) else nu).cast("double")
    a = v / 2.0

    def step(acc, _):
        t2 = F.exp(2.0 * acc["s"])
        y = t2 / (v + t2)
        w = _weight(a, y, -F.log1p(t2 / v), acc["r"])
        p = _tail(a, v / (v + t2), y, w)
        s = acc["s"] + (F.log(p) - math.log(1.0 - level)) * p / (2.0 * w)
        return F.struct(s.alias("s"), acc["r"].alias("r"))

    z = normal_quantile(0.5 + level / 2.0)
    start = F.struct(F.log(z + (z ** 3 + z) / (4.0 * v)).alias("s"), _gamma_ratio(a).alias("r"))
    return F.when(v > 0, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step,
                                     lambda acc: F.exp(acc["s"])))


def with_t_quantile(df: DataFrame, df_col: str, out: str = "tq", level: float = 0.95) -> DataFrame:
    """Attach the two-sided t quantile for the degrees of freedom in ``df_col``."""
    return df.withColumn(out, t_quantile(df_col, level))
