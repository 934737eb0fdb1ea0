"""Mergeable regression sums per series.

A state holds the rows, the fitted rows, both means and the centred sums of
squares and products, so states of different loads combine exactly, without
the rows and without the cancellation of raw power sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.operators.trend import SERIES, _moments, model_rows

SCHEMA = ("SamplingPoint string, WebParameter string, N long, n_fit long, xbar double, ybar double, sxx double, "
          "syy double, sxy double, xmin double, xmax double")


def partial_moments(df: DataFrame, keys=SERIES, measured_only: bool = True) -> DataFrame:
    """The states of clean rows (``SCHEMA`` for the default keys)."""
    m = _moments(model_rows(df, measured_only), list(keys))
    return m.select(*keys, "N", "n_fit", *[F.col(c).cast("double").alias(c) for c in
                                           ("xbar", "ybar", "sxx", "syy", "sxy", "xmin", "xmax")])


def merged(states: DataFrame, keys=SERIES) -> DataFrame:
    """One state per series: sums around the common means.  One exchange of
    the states (a row per series and load); the means come from a window over
    a series' states."""
    keys = list(keys)
    per = Window.partitionBy(*keys)
    n = F.col("n_fit")
    mean = lambda c: F.sum(F.when(n > 0, n * F.col(c))).over(per) / F.sum(n).over(per)
    s = states.withColumns({"mx": F.when(F.sum(n).over(per) > 0, mean("xbar")),
                            "my": F.when(F.sum(n).over(per) > 0, mean("ybar"))})
    dx, dy = F.col("xbar") - F.col("mx"), F.col("ybar") - F.col("my")
    return s.groupBy(*keys).agg(
        F.sum("N").alias("N"), F.sum("n_fit").alias("n_fit"), F.first("mx").alias("xbar"), F.first("my").alias("ybar"),
        F.sum(F.col("sxx") + n * dx * dx).alias("sxx"), F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
