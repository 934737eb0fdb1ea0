"""Fitted trend lines on an even grid per series (plot-ready frames).

Linear (L1/L2): one aggregation of regression sums per series, then the
grid is generated per series and the line and its confidence band are
closed-form expressions.

LOESS (L3/L4): local quadratic fits with tricube weights, span 0.8, evaluated
directly at each grid point (``functions.loess.direct``).  Rows are first
reduced to one row per (series, date) with partial aggregation, dealt by series
and sorted; each task then streams its series through Arrow, so the grid points
x distinct dates of a series (bounded by the calendar rather than by the number
of rows) are arrays, never rows.

``loess_surface`` is the interpolated form of the same regression: fitted only
at the vertices of each series' k-d tree, blended by cubics, with the exact
degrees of freedom delta1^2 / delta2.  A series' dates (bounded by the
calendar) go to one Arrow group; its work is vertices x dates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import schema as S
from fieldlab.functions import loess
from fieldlab.functions.cleaning import days_since_epoch
from fieldlab.functions.tdist import with_t_quantile
from fieldlab.operators.trend import series_moments
from fieldlab.session import checkpoint_dir

SERIES_KEY = ["SiteParam"]
_LINE = pa.list_(pa.struct([("i", pa.int32()), ("x", pa.float64()), ("yhat", pa.float64()), ("norm", pa.float64())]))


def _keys(by):
    return [by] if isinstance(by, str) else list(by)


def _grid_x(points: int) -> Column:
    return F.col("xmin") + F.col("i") * (F.col("xmax") - F.col("xmin")) / float(points - 1)


def linear_line(df: DataFrame, by=SERIES_KEY, points: int = S.LINE_POINTS, band: bool = False,
                level: float = S.CONF_LEVEL, min_n: int = S.MIN_MODEL_N,
                measured_only: bool = True) -> DataFrame:
    """Least-squares line per series over the series' date range:
    keys, i, x (days since 1970-01-01), yhat, lo, hi (lo/hi only with
    ``band``).  Defaults follow the current rules (measured values only,
    at least 8 rows); the older tabs used all points: ``measured_only=False,
    min_n=2``."""
    keys = _keys(by)
    return line_from_moments(series_moments(df, keys, min_n, measured_only), keys, points, band, level)


def line_from_moments(m: DataFrame, by=SERIES_KEY, points: int = S.LINE_POINTS, band: bool = False,
                      level: float = S.CONF_LEVEL) -> DataFrame:
    """``linear_line`` from regression sums per series."""
    keys = _keys(by)
    m = m.withColumn("b1", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")))
    extra = []
    if band:
        # One quantile per distinct number of rows: the sums (a row per series)
        # are cut from their lineage, so that both readers scan nothing again.
        checkpoint_dir(m.sparkSession)
        m = m.withColumn("_df", (F.col("n_fit") - 2).cast("long")).checkpoint(eager=True)
        m = m.join(with_t_quantile(m.select("_df").distinct(), "_df", "_tq", level), "_df", "left")
        extra = ["_df", "_tq"]
    g = m.select(*keys, "n_fit", "xbar", "ybar", "sxx", "syy", "sxy", "b1", "xmin", "xmax", *extra,
                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    g = g.withColumn("x", _grid_x(points))
    g = g.withColumn("yhat", F.col("ybar") + F.col("b1") * (F.col("x") - F.col("xbar")))
    if band:
        rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
        s = F.sqrt(rss / F.col("_df"))
        # No band without a slope (constant dates) or residual freedom.
        se = F.when((F.col("sxx") > 0) & (F.col("_df") > 0),
                    s * F.sqrt(1.0 / F.col("n_fit") + (F.col("x") - F.col("xbar")) ** 2 / F.col("sxx")))
        g = g.withColumns({"lo": F.col("yhat") - F.col("_tq") * se,
                           "hi": F.col("yhat") + F.col("_tq") * se})
    else:
        g = g.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    return g.select(*keys, "i", "x", "yhat", "lo", "hi")


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def date_points(df: DataFrame, by=SERIES_KEY, partitions: int | None = None) -> DataFrame:
    """Per (series, date): count, sum and sum of squares of the results.  The
    output is hash-partitioned by the series keys into ``partitions`` parts
    (default: the session's shuffle parallelism)."""
    keys = _keys(by)
    rows = (df.where(F.col("FinalResult").isNotNull() & F.col("DateSampled").isNotNull())
            .select(*keys, days_since_epoch(F.col("DateSampled")).alias("x"), F.col("FinalResult").alias("y")))
    pts = rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("sy"),
                                       F.sum(F.col("y") * F.col("y")).alias("syy"))
    # The fits cost far more than reading these rows; an explicit partition
    # count keeps AQE from coalescing the (small) shuffle into too few tasks.
    return pts.repartition(_partitions(df, partitions), *keys)


def _whole_series(batches, keys):
    """Tables of whole series from sorted batches, and where each series
    starts: the last series of a batch waits for the next one."""
    held = []
    for batch in batches:
        t = pa.Table.from_batches([*held, batch])
        codes = [pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0))
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        held = t.slice(int(starts[-1])).to_batches() if len(starts) else []
    if held:
        yield pa.Table.from_batches(held), np.array([0])


def _line_type(pts: DataFrame, keys) -> T.StructType:
    """One row per series: the keys, ``line`` (i, x, yhat, norm at each point),
    ``s`` and ``df``."""
    item = "array<struct<i:int,x:double,yhat:double,norm:double>>"
    return T.StructType([pts.schema[k] for k in keys] + T._parse_datatype_string(f"line {item}, s double, df double").fields)


def _line_table(t: pa.Table, keys, at, fits, points: int) -> pa.Table:
    """The fits (x, yhat and, with a band, norm, s and df) of the series that
    have their keys in the rows ``at`` of a table; NaN becomes NULL."""
    none = np.full(points, np.nan)
    number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
    columns = [number(np.concatenate([f.get(k, none) for f in fits] or [none[:0]])) for k in ("x", "yhat", "norm")]
    i = pa.array(np.tile(np.arange(points, dtype=np.int32), len(fits)))
    grid = pa.StructArray.from_arrays([i, *columns], fields=list(_LINE.value_type))
    line = pa.ListArray.from_arrays(pa.array(np.arange(len(fits) + 1, dtype=np.int32) * points), grid)
    of = t.select(keys).take(pa.array(at, pa.int64())).combine_chunks()
    one = [number(np.array([f.get(k, np.nan) for f in fits], dtype=float)) for k in ("s", "df")]
    return pa.Table.from_arrays([*(of.column(k) for k in keys), line, *one], names=[*keys, "line", "s", "df"])


def _date_arrays(t: pa.Table) -> list[np.ndarray]:
    return [t.column(k).to_numpy().astype(float) for k in ("x", "c", "sy", "syy")]


def loess_line(df: DataFrame, by=SERIES_KEY, span: float = S.LOESS_SPAN,
               points: int = S.LINE_POINTS, min_n: int = S.LOESS_MIN_N, band: bool = False,
               level: float = S.CONF_LEVEL, partitions: int | None = None) -> DataFrame:
    """LOESS (degree 2, tricube, span 0.8) per series on an even grid over
    the series' date range: keys, i, x, yhat (and se, lo, hi, df with
    ``band``).  All parsed results are used, detection-limit values
    included.  A grid point with fewer than three distinct dates of positive
    weight has no fit (NULL).  ``partitions`` sets the parallelism of the
    grid stage (default: the session's shuffle parallelism; a small
    selection can use fewer)."""
    keys = _keys(by)
    pts = date_points(df.dropna(subset=keys), keys, partitions).sortWithinPartitions(*keys, "x")

    def run(batches):
        # A task streams its sorted series, many in a batch: it holds a batch
        # and the dates of one series.
        for t, starts in _whole_series((b for b in batches if b.num_rows), keys):
            x, c, sy, syy = _date_arrays(t)
            kept, fits = [], []
            for a, b in zip(starts, [*starts[1:], t.num_rows]):
                if c[a:b].sum() >= min_n:
                    kept.append(a)
                    fits.append(loess.direct(x[a:b], c[a:b], sy[a:b], syy[a:b], points, span, band))
            yield from _line_table(t, keys, kept, fits, points).to_batches()

    per = pts.mapInArrow(run, _line_type(pts, keys))
    if not band:
        return per.select(*keys, F.explode("line").alias("p")).select(*keys, "p.i", "p.x", "p.yhat")
    norm = F.sqrt(F.greatest(F.col("p.norm"), F.lit(0.0)))
    return _banded(per, keys, norm, level)


def _banded(per: DataFrame, keys, norm: Column, level: float) -> DataFrame:
    """yhat +/- t(level, df) * s * norm at each point of the lines."""
    out = with_t_quantile(per, "df", "tq", level).select(*keys, "s", "df", "tq", F.explode("line").alias("p"))
    out = out.select(*keys, "p.i", "p.x", "p.yhat", (F.col("s") * norm).alias("se"), "tq", "df")
    return out.select(*keys, "i", "x", "yhat", "se", (F.col("yhat") - F.col("tq") * F.col("se")).alias("lo"),
                      (F.col("yhat") + F.col("tq") * F.col("se")).alias("hi"), "df")


def loess_surface(df: DataFrame, by=SERIES_KEY, span: float = S.LOESS_SPAN, points: int = S.LINE_POINTS,
                  min_n: int = S.LOESS_MIN_N, band: bool = False, level: float = S.CONF_LEVEL,
                  cell: float = loess.CELL, margin: float = loess.MARGIN, partitions: int | None = None) -> DataFrame:
    """LOESS interpolated from k-d tree vertices (see ``functions.loess``), on
    an even grid over the series' date range: keys, i, x, yhat (and se, lo, hi
    and df = delta1^2 / delta2 with ``band``).  Rows need a result and a date;
    a series has a line from ``min_n`` rows on.  Points between vertices
    without a fit (fewer than three dates of positive weight) are NULL, and a
    series with such a vertex has no band.

    Rows are reduced to one per series and date with partial aggregation, then
    dealt by series once."""
    keys = _keys(by)
    pts = date_points(df, keys, partitions)

    def fit(t: pa.Table) -> pa.Table:
        x, c, sy, syy = _date_arrays(t)
        if c.sum() < min_n:
            return _line_table(t, keys, [], [], points)
        o = np.argsort(x, kind="stable")
        out = loess.surface(x[o], c[o], sy[o], syy[o], points, span, band, cell, margin)
        d1, d2 = out.get("delta1", np.nan), out.get("delta2", np.nan)
        out["df"] = d1 * d1 / d2 if band and d1 > 0 and d2 > 0 else np.nan
        return _line_table(t, keys, [0], [out], points)

    per = pts.groupBy(*keys).applyInArrow(fit, _line_type(pts, keys))
    if not band:
        return per.select(*keys, F.explode("line").alias("p")).select(*keys, "p.i", "p.x", "p.yhat")
    return _banded(per, keys, F.col("p.norm"), level)
