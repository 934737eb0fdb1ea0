"""Retrieval: station join, site/parameter selection, date range."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.operators.joins import bounded_broadcast, keep_values

# Columns the retrieval query projects (raw names).
RAW_COLUMNS = ["SamplingPoint", "DateSampled", "WebResult", "Qualifier",
               "RelativeDepthSample", "WebParameter"]


def with_station(results: DataFrame, stations: DataFrame) -> DataFrame:
    """Left equi-join of results to stations (``SamplingPoint = StationID``).

    Duplicate station ids fan out, as in SQL.  The station side is broadcast
    only when its row count is within the broadcast bound."""
    st = stations.select(F.col("StationID"), F.col("Description"))
    st = bounded_broadcast(st)
    return (results.join(st, results["SamplingPoint"] == st["StationID"], "left")
            .drop("StationID"))


def select_results(results: DataFrame, stations: DataFrame, sites=None, params=None,
                   columns=RAW_COLUMNS, dates=None) -> DataFrame:
    """Rows of the selected sites and parameters with their description.

    ``dates``: (start, end) of typed sample dates, filtered on the scan.

    ``sites`` / ``params``: a string (one value), a list, or None (all).
    The filters sit on the results scan (pushed to Parquet); the station
    side is restricted to the selected sites before the size check, so the
    broadcast is bounded by the selection."""
    df = results
    st = stations
    if sites is not None:
        sites = [sites] if isinstance(sites, str) else list(sites)
        df = keep_values(df, "SamplingPoint", sites)
        st = keep_values(st, "StationID", sites)
    if params is not None:
        params = [params] if isinstance(params, str) else list(params)
        df = keep_values(df, "WebParameter", params)
    if dates is not None:
        df = filter_dates(df, *dates)
    df = df.select(*columns)
    return with_station(df, st)


def has_rows(df: DataFrame) -> DataFrame:
    """One row, one column ``has_rows``: whether the frame is non-empty.
    (Driver code uses ``df.isEmpty()``; this form composes lazily.)"""
    return df.select(F.lit(1).alias("_one")).limit(1).groupBy().agg(
        (F.count("*") > 0).alias("has_rows"))


def _as_date(v):
    if isinstance(v, (_dt.date, _dt.datetime)):
        return F.lit(v).cast("date")
    return F.to_date(F.lit(v))


def filter_dates(df: DataFrame, start, end, col: str = "DateSampled") -> DataFrame:
    """Inclusive date range; NULL dates drop out.  Of the store's rows (a
    ``sample_year`` beside the sample date) only the years' folders are read."""
    lo, hi = _as_date(start), _as_date(end)
    if col == "DateSampled" and "sample_year" in df.columns:
        df = df.where(F.col("sample_year").between(F.year(lo), F.year(hi)))
    return df.where(F.col(col).between(lo, hi))
