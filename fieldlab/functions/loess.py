"""Interpolated LOESS of one series: vertices, blending, and exact statistics.

The fit is local quadratic regression with tricube weights, computed only at
the vertices of a one-dimensional k-d tree.  A cell with more than
floor(N * span * cell) rows is cut at the middle of the gap between two dates
that is nearest to its median row.  Each vertex keeps the fitted value and
slope, and the curve between two vertices is the cubic through both.

With E the blending coefficients (rows x vertex values and slopes) and V the
regression coefficients (vertex values and slopes x rows), the operator that
maps the results to their fits is L = E V.  Its rank is twice the number of
vertices, which does not grow with the series (about 9 vertices at span 0.8),
so the traces behind the degrees of freedom need no matrix of dates by dates:
with A = E'E, B = VV' and C = VE,

    tr((I-L)(I-L)')     = N - 2 tr C + tr AB
    tr(((I-L)(I-L)')^2) = N - 4 tr C + 2 tr CC + 4 tr AB + tr ABAB - 4 tr ACB

Rows of one date share their coefficients, so everything is computed per
distinct date, weighted by its rows.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the method: the most rows of a cell as a share of N * span,
# and the part of the range by which the outer vertices lie outside it.
CELL = 0.2
MARGIN = 0.005
SINGULAR = 1e-12


def vertices(x: np.ndarray, rows: np.ndarray, most: float, margin: float = MARGIN) -> np.ndarray:
    """Ordered vertices for sorted distinct dates ``x`` with ``rows`` each."""
    upto = np.cumsum(rows)
    outside = margin * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    cuts, cells = [], [(0, int(upto[-1]))]
    while cells:
        before, last = cells.pop()
        if last - before <= most:
            continue
        lo, hi = np.searchsorted(upto, before, "right"), np.searchsorted(upto, last, "left")
        if lo >= hi:
            continue                       # one date only
        off = np.abs(upto[lo:hi] - (before + 1 + last) // 2)
        at = lo + np.flatnonzero(off == off.min())[-1]
        cuts.append((x[at] + x[at + 1]) / 2.0)
        cells += [(before, int(upto[at])), (int(upto[at]), last)]
    return np.array([x[0] - outside, *sorted(cuts), x[-1] + outside])


def vertex_operator(x: np.ndarray, rows: np.ndarray, v: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of one row of each date in the value (first half of the
    rows) and slope (second half) at each vertex; and which vertices have a
    fit (three dates of positive weight)."""
    n = rows.sum()
    dist = np.abs(x[None, :] - v[:, None])
    order = np.argsort(dist, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1)
    reach = np.argmax(held >= min(n, np.floor(n * span + 1e-5)), axis=1)
    h = np.take_along_axis(dist, order, axis=1)[np.arange(len(v)), reach] * max(1.0, span)
    safe = np.where(h > 0, h, 1.0)[:, None]
    w = np.where(dist < h[:, None], (1.0 - (dist / safe) ** 3) ** 3, 0.0)
    u = (x[None, :] - v[:, None]) / safe
    s = [(w * rows * u ** k).sum(axis=1) for k in range(5)]
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    fit = ((w > 0).sum(axis=1) >= 3) & (np.abs(det) > SINGULAR * s[0] ** 3)
    det = np.where(fit, det, np.nan)
    value = [s[2] * s[4] - s[3] * s[3], s[3] * s[2] - s[1] * s[4], s[1] * s[3] - s[2] * s[2]]
    slope = [s[3] * s[2] - s[1] * s[4], s[0] * s[4] - s[2] * s[2], s[1] * s[2] - s[0] * s[3]]
    at = [w * sum((k / det)[:, None] * u ** p for p, k in enumerate(row)) for row in (value, slope)]
    return np.vstack([at[0], at[1] / safe]), fit


def blend(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cubic blending coefficients of the vertex values and slopes at points."""
    cell = np.clip(np.searchsorted(v, points, "left") - 1, 0, len(v) - 2)
    width = v[cell + 1] - v[cell]
    t = (points - v[cell]) / width
    e, i, nv = np.zeros((len(points), 2 * len(v))), np.arange(len(points)), len(v)
    e[i, cell] = (1 - t) ** 2 * (1 + 2 * t)
    e[i, cell + 1] = t ** 2 * (3 - 2 * t)
    e[i, nv + cell] = t * (1 - t) ** 2 * width
    e[i, nv + cell + 1] = -t ** 2 * (1 - t) * width
    return e


def _through(e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """e @ values, where vertices without a fit count only if they are used."""
    return np.where(e != 0, e * values, 0.0).sum(axis=1)


def surface(x: np.ndarray, rows: np.ndarray, sy: np.ndarray, syy: np.ndarray, points: int, span: float,
            band: bool = False, cell: float = CELL, margin: float = MARGIN) -> dict:
    """Line of one series at ``points`` even points from the first to the last
    date: ``x``, ``yhat``; with ``band`` also ``norm`` (length of the operator's
    row at each point), ``s`` (residual scale), ``delta1``, ``delta2``.
    Per distinct date come the rows, the sum and the sum of squares of the
    results.  NaN stands for no fit."""
    v = vertices(x, rows, np.floor(rows.sum() * span * cell), margin)
    op, fit = vertex_operator(x, rows, v, span)
    grid = x[0] + np.arange(points) * (x[-1] - x[0]) / (points - 1.0)
    eg, at_vertex = blend(grid, v), op @ sy
    out = {"x": grid, "yhat": _through(eg, at_vertex)}
    if not band:
        return out
    out |= {"norm": np.full(points, np.nan), "s": np.nan, "delta1": np.nan, "delta2": np.nan}
    if not fit.all():
        return out
    ed, n = blend(x, v), float(rows.sum())
    fitted = ed @ at_vertex
    a, b, c = ed.T @ (rows[:, None] * ed), (op * rows) @ op.T, (op * rows) @ ed
    ab, tr = a @ b, np.trace
    out["delta1"] = n - 2 * tr(c) + tr(ab)
    out["delta2"] = n - 4 * tr(c) + 2 * tr(c @ c) + 4 * tr(ab) + tr(ab @ ab) - 4 * tr(a @ c @ b)
    rss = max((syy - 2 * fitted * sy + rows * fitted ** 2).sum(), 0.0)
    out["s"] = np.sqrt(rss / out["delta1"]) if out["delta1"] > 0 else np.nan
    out["norm"] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", eg, b, eg), 0.0))
    return out


# Least determinant of a direct fit, as a share of the cubed weight sum, and
# the cells (grid points x dates) worked on at once.
DIRECT_SINGULAR = 1e-12
MOST_CELLS = 4_000_000


def _reach(x: np.ndarray, rows: np.ndarray, grid: np.ndarray, span: float) -> np.ndarray:
    """Distance from each grid point to its q-th nearest row, q = floor(N *
    span): the q nearest rows are those of a run of consecutive dates, so it is
    the least, over runs that hold q rows, of the distance to the farther end."""
    if span > 1.0:
        return np.maximum(grid - x[0], x[-1] - grid) * span
    upto = np.cumsum(rows)
    last = np.searchsorted(upto, upto - rows + np.floor(upto[-1] * span), "left")
    first = x[last < len(x)]
    return np.maximum(grid[:, None] - first, x[last[last < len(x)]] - grid[:, None]).min(axis=1)


def _direct_sums(x, rows, sy, grid, span, band):
    """Per grid point: moments of the weights (S0-S4), of the weighted results
    (T0-T2) and of the squared weights (V0-V4), and the dates that count."""
    h = _reach(x, rows, grid, span)[:, None]
    safe, off = np.where(h > 0, h, 1.0), x[None, :] - grid[:, None]
    r = np.abs(off) / safe
    w = np.where(h > 0, np.where(r < 1.0, (1.0 - r * r * r) ** 3, 0.0), off == 0)
    u = np.where(h > 0, off / safe, 0.0)
    u2 = u * u
    powers = [np.ones_like(u), u, u2, u2 * u, u2 * u2]
    moments = lambda a, k: [np.einsum("ij,ij->i", a, p) for p in powers[:k]]
    return [np.array(moments(w * rows, 5)), np.array(moments(w * sy, 3)),
            np.array(moments(w * w * rows, 5)) if band else np.empty((5, len(grid))), (w > 0).sum(axis=1)]


def _det3(a, b, c, d, e, f, g, h, i):
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def direct(x: np.ndarray, rows: np.ndarray, sy: np.ndarray, syy: np.ndarray, points: int, span: float,
           band: bool = False) -> dict:
    """Line of one series, fitted at each of ``points`` even points from the
    first to the last date: ``x``, ``yhat``; with ``band`` also ``norm``
    (squared length of the operator's row at each point), ``s`` (residual
    scale) and ``df`` = delta1.  Input as for ``surface``; NaN stands for no fit."""
    grid = x[0] + np.arange(points) * (x[-1] - x[0]) / (points - 1.0)
    some = max(1, MOST_CELLS // len(x))
    parts = [_direct_sums(x, rows, sy, grid[i:i + some], span, band) for i in range(0, points, some)]
    s, t, v, dates = (np.concatenate(p, axis=-1) for p in zip(*parts))
    det = _det3(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    fit = (dates >= 3) & (np.abs(det) > DIRECT_SINGULAR * s[0] ** 3)
    det = np.where(fit, det, np.nan)
    yhat = _det3(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]) / det
    out = {"x": grid, "yhat": yhat}
    if not band:
        return out
    a0, a1, a2 = (s[2] * s[4] - s[3] * s[3]) / det, -(s[1] * s[4] - s[3] * s[2]) / det, (s[1] * s[3] - s[2] * s[2]) / det
    norm2 = a0 * a0 * v[0] + a1 * a1 * v[2] + a2 * a2 * v[4] + 2.0 * a0 * a1 * v[1] + 2.0 * a0 * a2 * v[2] + 2.0 * a1 * a2 * v[3]
    step = (x[-1] - x[0]) / (points - 1.0)
    k = np.minimum(np.floor((x - x[0]) / step), points - 2).astype(int) if step > 0 else np.zeros(len(x), int)
    width = grid[k + 1] - grid[k]
    at = np.where(width > 0, (x - grid[k]) / np.where(width > 0, width, 1.0), 0.0)
    yd, ld, kd = (f[k] + (f[k + 1] - f[k]) * at for f in (yhat, a0, norm2))
    # A date beside a point without a fit does not count; the series has no scale then.
    known = ~np.isnan(yd)
    out |= {"norm": norm2, "s": np.nan, "df": np.nan}
    if known.any():
        out["df"] = rows.sum() - 2.0 * (rows * ld)[known].sum() + (rows * kd)[known].sum()
    if known.all() and out["df"] > 0:
        out["s"] = np.sqrt(max((syy - 2.0 * yd * sy + rows * yd * yd).sum(), 0.0) / out["df"])
    return out
