"""Streaming ingest of arriving result files into the store.

The batch refresh polls a source for rows above the stored maximum date;
as a stream, each new file dropped into a landing folder is a micro-batch.
Rows are prepared exactly like the batch load (key alignment, trimming,
typed dates, year column) and written by ``foreachBatch`` into the store
folder of their micro-batch, with overwrite, so a micro-batch replayed after
a failure replaces its own output: the checkpoint plus idempotent writes
give exactly-once results.  Late rows (older dates) are kept, unlike the
strict "newer than the stored maximum" rule of the batch refresh.

Optional de-duplication, two ways:

* ``dedup="store"`` (exact): each micro-batch is de-duplicated and rows
  already stored are dropped by a null-safe anti join against the store,
  read only for the batch's date range (year partitions pruned, dates
  pushed down).  No streaming state; late rows are never lost.
* ``dedup_days=N`` (bounded state): the sample date is the event time, a
  watermark of N days bounds the state and ``dropDuplicatesWithinWatermark``
  drops repeats arriving within that delay.  Spark discards rows older than
  the watermark, so use it only when lateness is bounded by N days.

Every micro-batch adds a folder; ``sources.store.merge_loads`` merges them
while the stream goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import schema as S
from fieldlab.sources import sinks
from fieldlab.sources import store as ST

DEDUP_KEYS = ["SamplingPoint", "WebParameter", "DateSampled", "WebResult", "Qualifier",
              "RelativeDepthSample"]


def results_stream(spark: SparkSession, landing: str, schema: T.StructType = S.RESULTS_SCHEMA,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame over result files arriving in ``landing``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(landing)


def prepared(stream: DataFrame, dedup_days: int | None = None) -> DataFrame:
    """Store-ready rows; with ``dedup_days``, repeats within that event-time
    delay are dropped (state bounded by the watermark)."""
    rows = sinks.prepare_results(stream)
    if dedup_days:
        keys = [c for c in DEDUP_KEYS if c in rows.columns]
        rows = (rows.withColumn("sampled_ts", F.to_timestamp(F.col("DateSampled")))
                .withWatermark("sampled_ts", f"{int(dedup_days)} days")
                .dropDuplicatesWithinWatermark(keys)
                .drop("sampled_ts"))
    return rows


def drop_stored(batch: DataFrame, store: str, own_tag: str | None = None) -> DataFrame:
    """Rows of a micro-batch that are not yet stored (and not repeated
    within the batch).  Only stored rows in the batch's date range are read
    (year folders pruned, dates pushed down); the batch's own folder
    (``own_tag``, present when a failed batch is replayed) is ignored."""
    spark = batch.sparkSession
    keys = [c for c in DEDUP_KEYS if c in batch.columns]
    batch = batch.dropDuplicates(keys)
    rpath = sinks.results_path(store)
    if not sinks.table_exists(spark, rpath):
        return batch
    # Distinct years: bounded by the calendar.  The year filter stands as its
    # own conjunct, so the store's other year folders are pruned.
    b = batch.agg(F.min("DateSampled").alias("lo"), F.max("DateSampled").alias("hi"),
                  F.collect_set("sample_year").alias("years")).first()
    stored = ST.read_results(spark, store)
    if own_tag is not None:
        stored = stored.where(F.col("ingest_batch") != own_tag)
    in_range = F.col("DateSampled").isNull()
    if b["lo"] is not None:
        in_range = in_range | F.col("DateSampled").between(F.lit(b["lo"]), F.lit(b["hi"]))
    in_years = F.col("sample_year").isNull() | F.col("sample_year").isin(list(b["years"]))
    old = stored.where(in_years).where(in_range).select(*keys).dropDuplicates(keys).alias("o")
    cond = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return batch.alias("n").join(old, cond, "left_anti")


def stream_ingest(spark: SparkSession, landing: str, store: str, checkpoint: str,
                  stations: Callable[[], DataFrame] | None = None, dedup_days: int | None = None,
                  query_name: str = "results_ingest", available_now: bool = True,
                  schema: T.StructType = S.RESULTS_SCHEMA, fmt: str = "parquet",
                  dedup: str | None = None, max_files_per_trigger: int | None = None):
    """Start the ingest query.

    ``stations`` (optional) returns the current station table; it replaces
    the stored stations after every micro-batch that brought rows.  With
    ``available_now`` the query processes what has arrived and stops
    (scheduled runs); otherwise it keeps running.  Returns the
    StreamingQuery."""
    rows = prepared(results_stream(spark, landing, schema, fmt, max_files_per_trigger), dedup_days)
    if dedup not in (None, "store"):
        raise ValueError("dedup must be None or 'store'")
    # Output folders are keyed by the checkpoint (one per stream) and the
    # epoch: a replay from the same checkpoint overwrites its own folder;
    # streams with other checkpoints never touch it.
    stream_key = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    tag = lambda epoch_id: f"stream-{stream_key}-{epoch_id:08d}"

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # The micro-batch (bounded by the trigger) is read several times.
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            if dedup == "store":
                batch = drop_stored(batch, store, tag(epoch_id))
            sinks.write_results(batch, store, tag(epoch_id))
            if stations is not None:
                sinks.overwrite(sinks.prepare_stations(stations()), sinks.stations_path(store))
        finally:
            batch.unpersist()

    writer = (rows.writeStream.queryName(query_name).foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
