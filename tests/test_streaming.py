"""Streaming ingest: incremental runs equal one batch load; dedup; stations."""

import os

from pyspark.sql import functions as F

from fieldlab import fixtures
from fieldlab.sources import sinks
from fieldlab.streaming.ingest import stream_ingest
from conftest import SF001

KEYS = ["SamplingPoint", "DateSampled", "WebParameter", "WebResult", "Qualifier", "RelativeDepthSample"]


def _land(df, landing, name):
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(landing, name))


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*KEYS).collect())


def test_stream_twice_equals_batch(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    store = os.path.join(tmpdir_path, "store")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    ev = fixtures.event_results(spark, SF001)
    ev = ev.withColumn("SamplingPoint", F.concat(F.lit(" "), "SamplingPoint"))  # untrimmed on arrival
    parts = [ev.where(F.col("DateSampled") <= "2024-01-10"),
             ev.where((F.col("DateSampled") > "2024-01-10") & (F.col("DateSampled") <= "2024-01-20")),
             ev.where(F.col("DateSampled") > "2024-01-20")]
    os.makedirs(landing)
    _land(parts[0], landing, "f0")
    _land(parts[1], landing, "f1")
    stations = lambda: fixtures.stations(spark, SF001)
    q = stream_ingest(spark, landing + "/*", store, ckpt, stations=stations)
    q.awaitTermination()
    got1 = spark.read.parquet(sinks.results_path(store))
    assert got1.count() == parts[0].count() + parts[1].count()
    _land(parts[2], landing, "f2")
    q = stream_ingest(spark, landing + "/*", store, ckpt, stations=stations)
    q.awaitTermination()
    stored = spark.read.parquet(sinks.results_path(store))
    batch = sinks.prepare_results(ev)
    assert _rows(stored) == _rows(batch)
    assert spark.read.parquet(sinks.stations_path(store)).count() == fixtures.stations(spark, SF001).count()


def test_stream_dedup_within_watermark(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    store = os.path.join(tmpdir_path, "store")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    ev = fixtures.event_results(spark, SF001).dropDuplicates(KEYS)
    os.makedirs(landing)
    _land(ev, landing, "a")
    _land(ev.limit(50), landing, "b")          # the same rows delivered again
    q = stream_ingest(spark, landing + "/*", store, ckpt, dedup_days=30)
    q.awaitTermination()
    stored = spark.read.parquet(sinks.results_path(store))
    assert stored.count() == ev.count()


def test_stream_store_dedup_keeps_late_rows(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    store = os.path.join(tmpdir_path, "store")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    ev = fixtures.event_results(spark, SF001).dropDuplicates(KEYS)
    new = ev.where(F.col("DateSampled") > "2024-01-20")
    old = ev.where(F.col("DateSampled") <= "2024-01-20")
    os.makedirs(landing)
    _land(new, landing, "a")                           # recent rows first
    q = stream_ingest(spark, landing + "/*", store, ckpt, dedup="store")
    q.awaitTermination()
    _land(old, landing, "b")                           # then much older (late) rows
    _land(new.limit(40), landing, "c")                 # and repeats of stored rows
    q = stream_ingest(spark, landing + "/*", store, ckpt, dedup="store", max_files_per_trigger=1)
    q.awaitTermination()
    stored = spark.read.parquet(sinks.results_path(store))
    assert _rows(stored) == _rows(sinks.prepare_results(ev))


def test_two_streams_into_one_store(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    ev = fixtures.event_results(spark, SF001)
    a = ev.where(F.col("DateSampled") <= "2024-01-15")
    b = ev.where(F.col("DateSampled") > "2024-01-15")
    for name, part in (("a", a), ("b", b)):
        landing = os.path.join(tmpdir_path, f"landing_{name}")
        os.makedirs(landing)
        _land(part, landing, "f")
        stream_ingest(spark, landing + "/*", store, os.path.join(tmpdir_path, f"ckpt_{name}")).awaitTermination()
    assert spark.read.parquet(sinks.results_path(store)).count() == ev.count()
