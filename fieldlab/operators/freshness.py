"""Store freshness: coverage dates, age of the newest data, refresh rule."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab import schema as S


def _epoch_micros(as_of) -> Column:
    """``as_of`` as microseconds since the epoch.  Text and naive datetimes
    are read as UTC, so the result does not depend on the session zone."""
    if isinstance(as_of, Column):
        return F.unix_micros(as_of)
    ts = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=_dt.timezone.utc)
    delta = ts - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
    return F.lit((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds).cast("long")


def date_coverage(df: DataFrame, col: str = "DateSampled", last: str | None = None) -> DataFrame:
    """Min and max sample date of the table; of a table of date ranges (the
    store's zones) with the columns of their first and last dates."""
    return df.agg(F.min(col).alias("min_date"), F.max(last or col).alias("max_date"))


def staleness(df: DataFrame, as_of, col: str = "DateSampled") -> DataFrame:
    """Age in days of the newest sample at ``as_of`` (the newest date is
    taken at midnight UTC), exact and rounded to one decimal."""
    newest = df.agg(F.max(col).alias("max_date"))
    age = ((_epoch_micros(as_of) - F.unix_date(F.col("max_date")).cast("long") * 86_400_000_000)
           / 86_400_000_000.0)
    return newest.select("max_date", age.alias("age_days"), F.round(age, 1).alias("age_days_1"))


def is_fresh(df: DataFrame, as_of, ttl_days: float = S.REFRESH_TTL_DAYS,
             col: str = "DateSampled") -> DataFrame:
    """Staleness plus ``fresh``: newest data younger than ``ttl_days``.
    An empty table is never fresh."""
    st = staleness(df, as_of, col)
    return st.withColumn("fresh", F.coalesce(F.col("age_days") < ttl_days, F.lit(False)))


def watermark(store: DataFrame, col: str = "DateSampled"):
    """Newest stored date (one scalar to the driver), None if empty."""
    return store.agg(F.max(col).alias("wm")).first()["wm"]


def new_rows(source: DataFrame, wm, col: str = "DateSampled") -> DataFrame:
    """Rows of ``source`` strictly after the watermark ``wm`` (all rows when
    it is None).  A literal bound, so the filter reaches the scan."""
    if wm is None:
        return source
    return source.where(F.col(col) > F.lit(wm))


def new_row_count(source: DataFrame, store: DataFrame, col: str = "DateSampled") -> DataFrame:
    """``n_new`` and whether anything new arrived (the 'no new data' case)."""
    n = new_rows(source, watermark(store, col), col).agg(F.count(F.lit(1)).alias("n_new"))
    return n.withColumn("has_new", F.col("n_new") > 0)


def coverage_message(df: DataFrame, kind: str = "cached", col: str = "DateSampled", last: str | None = None) -> DataFrame:
    """The coverage text: 'cached' prints ISO dates, 'reloaded' prints
    month-day-year dates (with the original's spacing)."""
    cov = date_coverage(df, col, last)
    if kind == "cached":
        msg = F.concat_ws(" ", F.lit(S.MSG_CACHED), F.date_format("min_date", "yyyy-MM-dd"),
                          F.lit("and"), F.date_format("max_date", "yyyy-MM-dd"))
    elif kind == "reloaded":
        msg = F.concat_ws(" ", F.lit(S.MSG_RELOADED), F.lit(S.MSG_RELOADED_RANGE),
                          F.date_format("min_date", "MM-dd-yyyy"), F.lit(" and "),
                          F.date_format("max_date", "MM-dd-yyyy"))
    else:
        raise ValueError("kind must be 'cached' or 'reloaded'")
    return cov.select("min_date", "max_date", msg.alias("message"))
