"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest dimension side (rows and bytes) shipped to every executor.  Above
# it the join falls back to a shuffle join that AQE may still convert.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
# Longest selection list written as an IN list; longer lists become a
# broadcast semi join against a one-column frame.
INLIST_MAX = 1000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if it is within both bounds, else ``df``.

    The check is one aggregate with partial sums: a single row per task is
    gathered, whatever the size of ``df``."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) if text else F.lit(0)) + F.lit(16)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def values_frame(spark: SparkSession, name: str, values, with_pos: bool = False) -> DataFrame:
    """One-column frame of user-selected values (optionally with their
    1-based position).  Selections are bounded by the option caps."""
    values = list(values)
    if with_pos:
        schema = T.StructType([T.StructField("pos", T.IntegerType()),
                               T.StructField(name, T.StringType())])
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], schema)
    schema = T.StructType([T.StructField(name, T.StringType())])
    return spark.createDataFrame([(v,) for v in values], schema)


def keep_values(df: DataFrame, column: str, values) -> DataFrame:
    """Filter ``column IN values``: a pushed-down IN list for short
    selections, a semi join for long ones (broadcast within the byte bound)."""
    values = list(dict.fromkeys(values))
    if len(values) <= INLIST_MAX:
        return df.where(F.col(column).isin(values))
    sel = values_frame(df.sparkSession, column, values)
    small = sum(len(str(v)) + 16 for v in values) <= BROADCAST_MAX_BYTES
    return df.join(F.broadcast(sel) if small else sel, column, "left_semi")
