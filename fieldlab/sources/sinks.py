"""Sinks: the Parquet store and CSV export.

Store layout::

    <store>/results/ingest_batch=<tag>/sample_year=<yyyy>/part-*.parquet
    <store>/stations/part-*.parquet
    <store>/zones, moments, merges: see sources.store

Every load (full load, increment, streaming micro-batch) writes its own
``ingest_batch`` folder with overwrite semantics, so a retried load or a
replayed micro-batch replaces its own files instead of adding duplicates.
``sample_year`` lets date filters prune folders; rows are range-partitioned
and sorted by (year, site, parameter) before writing, so the Parquet
min/max statistics make site and parameter filters skip row groups.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.functions.cleaning import to_sample_date
from fieldlab.operators.keys import align_columns, trim_keys
from fieldlab.sources import files
from fieldlab import schema as S

RESULTS = "results"
STATIONS = "stations"
ZONES = "zones"
MOMENTS = "moments"


def results_path(store: str) -> str:
    return f"{store.rstrip('/')}/{RESULTS}"


def stations_path(store: str) -> str:
    return f"{store.rstrip('/')}/{STATIONS}"


def prepare_results(df: DataFrame) -> DataFrame:
    """Source rows -> store rows: server key name aligned, keys trimmed,
    sample date typed (text dates parsed), year column added.  Other source
    columns pass through."""
    df = align_columns(df, S.SERVER_RENAMES)
    df = trim_keys(df, "SamplingPoint")
    dtype = df.schema["DateSampled"].dataType
    if isinstance(dtype, T.StringType):
        df = df.withColumn("DateSampled", to_sample_date(F.col("DateSampled")))
    elif not isinstance(dtype, T.DateType):
        df = df.withColumn("DateSampled", F.to_date(F.col("DateSampled")))
    return df.withColumn("sample_year", F.year("DateSampled"))


def prepare_stations(df: DataFrame) -> DataFrame:
    return trim_keys(df, "StationID")


# Range keys of the store: year and site first (folder pruning and row-group
# statistics), then date and result text so that one very large series is
# still cut into many tasks.
CLUSTER_KEYS = ("sample_year", "SamplingPoint", "WebParameter", "DateSampled", "WebResult")


def _clustered(df: DataFrame, partitions: int | None) -> DataFrame:
    """Range-partition and sort rows for writing.  Without an explicit
    count the session's shuffle parallelism is used and AQE merges the
    partitions of small loads."""
    keys = [c for c in CLUSTER_KEYS if c in df.columns]
    out = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return out.sortWithinPartitions(*keys)


def forget(spark: SparkSession, store: str, tag: str) -> None:
    """Remove what the store keeps about a load (see ``sources.store``)."""
    for what in (ZONES, MOMENTS):
        files.remove(spark, f"{store.rstrip('/')}/{what}/ingest_batch={tag}")


def write_results(df: DataFrame, store: str, tag: str, partitions: int | None = None) -> int:
    """Write prepared results as load ``tag`` (replacing that load's files
    if it was written before); returns the number of rows written, counted
    during the write itself (no second pass).  The count sits above the
    range exchange, so the boundary-sampling job does not add to it."""
    out = f"{results_path(store)}/ingest_batch={tag}"
    forget(df.sparkSession, store, tag)
    obs = Observation(f"write-{tag}")
    clustered = _clustered(df.drop("ingest_batch"), partitions)
    clustered.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite") \
        .partitionBy("sample_year").parquet(out)
    return int(obs.get["n"])


def overwrite(df: DataFrame, path: str, partition_by=None) -> None:
    """Replace a table: the new one is written beside the old one, then takes
    its place, so a failed write leaves the old table (and the new one may
    read from it)."""
    spark = df.sparkSession
    files.recover(spark, path)
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(beside)
    files.replace(spark, beside, path)


def align_to(df: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Columns in the target's order; missing ones NULL, extra ones kept at
    the end (unionByName with missing columns allowed)."""
    cols = []
    for f in target_schema.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in target_schema.fieldNames()]
    return df.select(*cols, *extra)


def append(df: DataFrame, path: str) -> None:
    """Append rows to an existing Parquet table, aligning columns to it."""
    spark = df.sparkSession
    if table_exists(spark, path):
        df = align_to(df, spark.read.parquet(path).schema)
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False, most_rows: int = 1_000_000) -> None:
    """CSV with a header, every row, quotes doubled.  Written in parallel as part files;
    ``single_file`` gathers a display table of at most ``most_rows`` rows into
    one file, and a larger one is refused (nothing is written)."""
    if single_file:
        if df.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"over {most_rows} rows: too many for a single CSV file, export part files instead")
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable Parquet table is present at ``path``, asked of the
    file system that Spark itself reads the path from."""
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the listing and footers
        return True
    except AnalysisException:
        return False
