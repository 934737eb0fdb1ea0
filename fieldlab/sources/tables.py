"""Readers for the results/stations sources and the local store."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import schema as S
from fieldlab.operators.keys import align_columns
from fieldlab.sources.files import recover


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over all cores when it yields fewer splits than the
    session's parallelism (e.g. one large row group).  On a cluster reading
    many files the scan already has more splits than cores and nothing
    changes; the check only plans the scan, it runs no job.

    Rows are hash-partitioned on their position in the split
    (``monotonically_increasing_id``): the same on a task retry (same file,
    same split), no per-task sort as a round-robin repartition needs, and,
    because Catalyst treats the key as non-deterministic, later filters and
    projections stay above the exchange and run on all cores instead of in
    the single scan task.  Column pruning still reaches the scan."""
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df
    return df.repartition(want, F.monotonically_increasing_id())


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Plain scan, so that filters and projections reach it; ``spread`` (used
    by the test fixtures only) deals a single split over the cores."""
    df = spark.read.parquet(path)
    return balanced(df) if spread else df


def read_table(spark: SparkSession, source, name: str | None = None,
               rename_map: dict | None = None, **jdbc_options) -> DataFrame:
    """Full read of a source table.

    ``source`` is a path (Parquet store or extract) or a JDBC URL.  A JDBC
    read is split on ``partition_column`` (e.g. the sample date) into
    ``num_partitions`` parallel range queries when bounds are given.
    ``rename_map`` aligns legacy or server column names."""
    if isinstance(source, str) and source.startswith("jdbc:"):
        opts = {"url": source, "dbtable": name}
        part = jdbc_options.pop("partition_column", None)
        if part:
            opts.update({"partitionColumn": part,
                         "lowerBound": str(jdbc_options.pop("lower_bound")),
                         "upperBound": str(jdbc_options.pop("upper_bound")),
                         "numPartitions": str(jdbc_options.pop("num_partitions", 64))})
        opts.update({k: str(v) for k, v in jdbc_options.items()})
        df = spark.read.format("jdbc").options(**opts).load()
    else:
        path = source if name is None else f"{str(source).rstrip('/')}/{name}"
        df = read_parquet(spark, path)
    return align_columns(df, rename_map) if rename_map else df


def read_since(df: DataFrame, watermark, lookback_days: int = 0, col: str = "DateSampled") -> DataFrame:
    """Rows strictly after the high-water mark (optionally re-reading
    ``lookback_days`` before it, to catch late rows; pair with a dedup).
    The bound is a literal, so it reaches the Parquet/JDBC scan.  A text
    date column is compared as ISO text, like the source does.  Of the
    store's rows (a ``sample_year`` beside the sample date) only the folders
    from the bound's year on are read."""
    if watermark is None:
        return df
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    bound = F.date_sub(F.lit(str(watermark)).cast("date"), lookback_days)
    if is_text:
        bound = F.date_format(bound, "yyyy-MM-dd")
    elif col == "DateSampled" and "sample_year" in df.columns:
        df = df.where(F.col("sample_year") >= F.year(bound))
    cond = F.col(col) >= bound if lookback_days > 0 else F.col(col) > bound
    return df.where(cond)


def newest_partition(df: DataFrame, col: str = "sample_year", exclude_batches=()) -> DataFrame:
    """Restrict a year-partitioned store to its newest year, found from the
    file listing (no scan), so "newest date" reads one partition.  Files of
    the ``ingest_batch`` folders in ``exclude_batches`` are ignored (and
    filtered out)."""
    years = set()
    for f in df.inputFiles():
        b = re.search(r"ingest_batch=([^/]+)", f)
        if b and b.group(1) in exclude_batches:
            continue
        m = re.search(rf"{col}=(\d+)", f)
        if m:
            years.add(int(m.group(1)))
    if exclude_batches and "ingest_batch" in df.columns:
        df = df.where(~F.col("ingest_batch").isin(list(exclude_batches)))
    return df.where(F.col(col) == max(years)) if years else df


def load_store(spark: SparkSession, store: str, table: str = "results") -> DataFrame:
    """Read a table of the local store (Parquet folder ``store/table``); of the
    results, the loads that count (see ``sources.store``)."""
    if table == "results":
        from fieldlab.sources.store import read_results
        return read_results(spark, store)
    recover(spark, f"{store.rstrip('/')}/{table}")
    return read_parquet(spark, f"{store.rstrip('/')}/{table}")


def read_legacy(spark: SparkSession, source, name: str | None = None, **opts) -> DataFrame:
    """First-version source: legacy column names mapped to the current ones."""
    return read_table(spark, source, name, rename_map=S.LEGACY_RENAMES, **opts)


def source_updated(df: DataFrame, col: str = "Updated") -> DataFrame:
    """Publication time of the source (one-row table)."""
    return df.agg(F.max(col).alias("Updated"))


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station-metadata CSV: header row, quoted fields (commas inside
    names), every column read as text so codes keep their leading zeros;
    coordinates then cast to double."""
    df = (spark.read.schema(S.STATION_CSV_SCHEMA)
          .option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", False).option("mode", "PERMISSIVE")
          .csv(path))
    return df.withColumns({c: F.col(c).try_cast("double") for c in S.STATION_CSV_DOUBLES})


def read_with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame],
                       probe: bool = True) -> tuple[DataFrame, str]:
    """Use the primary source, or the fallback when it cannot be read.

    Resolving the plan catches missing paths and unreachable JDBC sources;
    ``probe`` also reads one row, catching failures that appear only at
    scan time.  Returns (frame, 'primary' | 'fallback')."""
    try:
        df = primary()
        if probe:
            df.limit(1).collect()
        return df, "primary"
    except Exception:  # noqa: BLE001 - any source failure means: use the fallback
        return fallback(), "fallback"
