"""Key maintenance: trimming and column-name alignment (applied at ingest
so later filters and joins on the keys stay pushable)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.cleaning import date_text


def trim_keys(df: DataFrame, cols) -> DataFrame:
    """SQL TRIM (spaces) on the key columns, as the store maintenance does."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: F.trim(F.col(c)) for c in cols if c in df.columns})


def align_columns(df: DataFrame, renames: dict) -> DataFrame:
    """Rename columns that are present (``{old: new}``); others pass through."""
    present = {old: new for old, new in renames.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(present) if present else df


def dates_as_text(df: DataFrame, col: str = "DateSampled") -> DataFrame:
    """Store the sample date as ISO text (the cache's text form)."""
    return df.withColumn(col, date_text(F.col(col)))
