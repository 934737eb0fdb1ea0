"""Cleaning pipeline: raw retrieval rows -> typed observation frame.

One narrow projection of built-in expressions (no UDF, no shuffle); the
profile argument reproduces the three generations of the rules:

* ``current``: strip to ``[0-9.<>=]``, censored values kept at the reported
  limit, blank depth -> 'surface', depth restricted to five levels, rows
  without a number dropped.
* ``v2``: as current but '<' values halved and depth upper case ('N/A').
* ``v1``: no strip step (signed/exponent numbers parse, units do not),
  '<' halved, NULL qualifiers stay NULL, blank depth -> NULL, unparsed rows
  kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import schema as S
from fieldlab.functions import cleaning as C
from fieldlab.operators.order import number_options
from fieldlab.operators.joins import bounded_broadcast
from fieldlab.operators.keys import align_columns

PROFILES = {
    "current": dict(strip=True, nondetect="full", depth="current", keep_null_qualifier=False,
                    drop_unparsed=True, depth_levels=True),
    "v2": dict(strip=True, nondetect="half", depth="v2", keep_null_qualifier=False,
               drop_unparsed=True, depth_levels=False),
    "v1": dict(strip=False, nondetect="half", depth="v1", keep_null_qualifier=True,
               drop_unparsed=False, depth_levels=False),
}


def _sample_date(df: DataFrame, col: str):
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DateType):
        return F.col(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(col))
    return C.to_sample_date(F.col(col))


def clean(raw: DataFrame, profile: str = "current", nondetect: str | None = None,
          drop_unparsed: bool | None = None) -> DataFrame:
    """Raw rows (current or legacy column names) -> clean frame with columns
    SamplingPoint, RelativeDepthComments, DateSampled, WebParameter,
    FinalResult, Qualifiers, Description, DL, legend_shape, SiteParam."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    p = dict(PROFILES[profile])
    if nondetect is not None:
        p["nondetect"] = nondetect
    if drop_unparsed is not None:
        p["drop_unparsed"] = drop_unparsed

    # Accept both the current and the legacy source names.
    df = align_columns(raw, {v: k for k, v in S.LEGACY_RENAMES.items()})
    if not isinstance(df.schema["FinalResult"].dataType, T.StringType):
        raise TypeError("FinalResult/WebResult must arrive as text: a number column "
                        "would be re-printed before parsing and lose signs and exponents")
    if "Description" not in df.columns:
        df = df.withColumn("Description", F.lit(None).cast("string"))

    text = F.col("FinalResult")
    if p["strip"]:
        text = C.strip_result(text)
        value = C.parse_result(text, p["nondetect"])
    else:
        value = C.parse_result_raw(text, p["nondetect"])
    depth = C.depth_label(F.col("RelativeDepthComments"), p["depth"])
    if p["depth_levels"]:
        depth = C.depth_category(depth)
    qual = C.qualifier_or_none(F.col("Qualifiers"), keep_null=p["keep_null_qualifier"])

    out = df.select(
        F.col("SamplingPoint"),
        depth.alias("RelativeDepthComments"),
        _sample_date(df, "DateSampled").alias("DateSampled"),
        F.col("WebParameter"),
        value.alias("FinalResult"),
        qual.alias("Qualifiers"),
        F.col("Description"),
        C.dl_class(text).alias("DL"),
    )
    if p["drop_unparsed"]:
        out = _drop_unparsed(out)
    return out.withColumns({
        "legend_shape": C.legend_class(F.col("Qualifiers"), F.col("DL")),
        "SiteParam": C.series_key(),
    })


def drop_unparsed(df: DataFrame, col: str = "FinalResult") -> DataFrame:
    """Drop rows whose result did not parse."""
    return df.where(F.col(col).isNotNull())


_drop_unparsed = drop_unparsed


def factor_code(df: DataFrame, col: str, out: str | None = None, locale: str | None = None) -> DataFrame:
    """Attach the 1-based code of ``col`` among its sorted distinct values
    (NULL is no level), in binary order or that of ``locale``.  The distinct values are numbered in sorted order by
    a range-partitioned sort with per-partition offsets (no single-task
    window, whatever the column's cardinality) and joined back; the level
    table is broadcast when its size check passes."""
    out = out or f"{col}_code"
    levels = number_options(df.select(col).where(F.col(col).isNotNull()).distinct(), order=[col], out=out, locale=locale)
    levels = levels.withColumn(out, F.col(out).cast("int"))
    return df.join(bounded_broadcast(levels), col, "left")
