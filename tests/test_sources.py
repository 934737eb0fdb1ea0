"""Readers, sinks and the freshness-aware refresh (round trips in temp dirs)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fieldlab import fixtures
from fieldlab import schema as S
from fieldlab.sources import sinks
from fieldlab.sources import tables as TB
from fieldlab.sources.refresh import refresh
from conftest import SF001


def test_append_aligns_columns(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    sinks.overwrite(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    sinks.append(spark.createDataFrame([("b", 2.0)], "v string, extra double"), path)
    rows = sorted(spark.read.parquet(path).select("k", "v").collect(), key=lambda r: r["v"])
    assert [tuple(r) for r in rows] == [(1, "a"), (None, "b")]


def test_export_csv_all_rows(spark, tmpdir_path):
    df = fixtures.results(spark, SF001).limit(100)
    path = os.path.join(tmpdir_path, "csv")
    sinks.export_csv(df, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 100 and back.columns == df.columns


def test_station_csv_traps(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "stations.csv")
    row1 = {c: "" for c in S.STATION_CSV_COLUMNS}
    row1.update({"Org_Identifier": "ORG1", "Location_Identifier": "ST-1",
                 "Location_Name": '"Creek, upper reach"', "Location_CountyCode": "007",
                 "Location_Latitude": "35.25", "Location_Longitude": "-92.5"})
    row2 = {c: "" for c in S.STATION_CSV_COLUMNS}
    row2.update({"Org_Identifier": "ORG1", "Location_Identifier": "ST-2", "Location_CountyCode": "120"})
    with open(path, "w") as f:
        f.write(",".join(S.STATION_CSV_COLUMNS) + "\n")
        for r in (row1, row2):
            f.write(",".join(r[c] for c in S.STATION_CSV_COLUMNS) + "\n")
    df = TB.read_station_csv(spark, path).orderBy("Location_Identifier").collect()
    assert len(df) == 2
    assert df[0]["Location_Name"] == "Creek, upper reach"
    assert df[0]["Location_CountyCode"] == "007"
    assert df[0]["Location_Latitude"] == 35.25 and df[1]["Location_Latitude"] is None


def test_fallback_and_updated(spark, tmpdir_path):
    df, which = TB.read_with_fallback(lambda: spark.read.parquet(os.path.join(tmpdir_path, "nope")),
                                      lambda: fixtures.stations(spark, SF001))
    assert which == "fallback" and df.count() > 0
    upd = spark.createDataFrame([(dt.datetime(2024, 5, 1, 8, 0),)], "Updated timestamp")
    assert TB.source_updated(upd).first()["Updated"] == dt.datetime(2024, 5, 1, 8, 0)


def test_read_since_text_and_date(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("2024-01-10",)], "DateSampled string")
    assert TB.read_since(df, dt.date(2024, 1, 5)).count() == 1
    assert TB.read_since(df, dt.date(2024, 1, 5), lookback_days=3).count() == 2
    d = df.select(F.col("DateSampled").cast("date").alias("DateSampled"))
    assert TB.read_since(d, "2024-01-01").count() == 2


def _source(spark, upto):
    res = fixtures.event_results(spark, SF001)
    res = res.where(F.col("DateSampled") <= upto).withColumnRenamed("SamplingPoint", "StationID")
    st = fixtures.stations(spark, SF001)
    return res, st


def test_refresh_cycle(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    all_n = fixtures.event_results(spark, SF001).count()
    first_n = fixtures.event_results(spark, SF001).where(F.col("DateSampled") <= "2024-01-15").count()

    r1 = refresh(spark, lambda: _source(spark, "2024-01-15"), store, "2024-01-20 00:00:00")
    assert (r1.action, r1.rows_loaded) == ("full_load", first_n)
    assert r1.message.startswith("Using most recent version of the database: <br>Data available between  ")

    r2 = refresh(spark, lambda: _source(spark, "2024-01-15"), store, "2024-01-20 00:00:00")
    assert r2.action == "cached" and r2.age_days == 5.0
    assert r2.message == "Using cached database. Data available between 2024-01-01 and 2024-01-15"

    r3 = refresh(spark, lambda: _source(spark, "2024-01-15"), store, "2024-02-01 00:00:00")
    assert (r3.action, r3.rows_loaded) == ("no_new_data", 0)

    r4 = refresh(spark, lambda: _source(spark, "2024-12-31"), store, "2024-02-02 00:00:00")
    assert (r4.action, r4.rows_loaded) == ("appended", all_n - first_n)
    assert spark.read.parquet(sinks.results_path(store)).count() == all_n

    # The same load again (e.g. a retry) replaces its own folder: no duplicates.
    refresh(spark, lambda: _source(spark, "2024-12-31"), store, "2024-02-02 00:00:00")
    assert spark.read.parquet(sinks.results_path(store)).count() == all_n

    def broken():
        raise RuntimeError("source down")
    r6 = refresh(spark, broken, store, "2024-03-01 00:00:00")
    assert r6.action == "fallback"
    st = spark.read.parquet(sinks.stations_path(store))
    assert st.where(F.col("StationID") != F.trim("StationID")).count() == 0


def test_refresh_lookback_picks_late_rows(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    src = fixtures.event_results(spark, SF001).withColumnRenamed("SamplingPoint", "StationID")
    early = src.where(F.col("DateSampled") <= "2024-01-15")
    late_extra = src.where(F.col("DateSampled") == "2024-01-14").limit(5) \
        .withColumn("WebResult", F.concat(F.col("WebResult"), F.lit("1")))
    refresh(spark, lambda: (early, fixtures.stations(spark, SF001)), store, "2024-01-20 00:00:00")
    r = refresh(spark, lambda: (early.unionByName(late_extra), fixtures.stations(spark, SF001)),
                store, "2024-02-20 00:00:00", lookback_days=3)
    assert (r.action, r.rows_loaded) == ("appended", 5)


def test_store_write_splits_hot_series(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    rows = sinks.prepare_results(fixtures.results_hot(spark, SF001))
    total = rows.count()
    sinks.write_results(rows, store, "full", partitions=8)
    per_file = (spark.read.parquet(sinks.results_path(store))
                .where((F.col("SamplingPoint") == "ST00001") & (F.col("WebParameter") == "Param AF"))
                .groupBy(F.input_file_name()).count().collect())
    hot = sum(r["count"] for r in per_file)
    assert hot > total / 4
    assert len(per_file) > 3 and max(r["count"] for r in per_file) < hot / 2


def test_refresh_retry_is_idempotent(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    all_n = fixtures.event_results(spark, SF001).count()
    refresh(spark, lambda: _source(spark, "2024-01-15"), store, "2024-01-20 00:00:00")
    r = refresh(spark, lambda: _source(spark, "2024-12-31"), store, "2024-03-01 00:00:00")
    assert r.action == "appended"
    # The same load runs again (as after a failure late in the first run):
    # it must rebuild the same increment, not an empty one.
    again = refresh(spark, lambda: _source(spark, "2024-12-31"), store, "2024-03-01 00:00:00", ttl_days=0)
    assert (again.action, again.rows_loaded) == ("appended", r.rows_loaded)
    assert spark.read.parquet(sinks.results_path(store)).count() == all_n


def test_refresh_dedup_drops_repeats(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    src = fixtures.event_results(spark, SF001).dropDuplicates().withColumnRenamed("SamplingPoint", "StationID")
    early = src.where(F.col("DateSampled") <= "2024-01-15")
    late = src.where(F.col("DateSampled") > "2024-01-15")
    refresh(spark, lambda: (early, fixtures.stations(spark, SF001)), store, "2024-01-20 00:00:00")
    # The source now repeats part of the new rows twice.
    doubled = early.unionByName(late).unionByName(late.limit(30))
    r = refresh(spark, lambda: (doubled, fixtures.stations(spark, SF001)), store, "2024-02-20 00:00:00",
                dedup=True)
    assert (r.action, r.rows_loaded) == ("appended", late.count())
    assert spark.read.parquet(sinks.results_path(store)).count() == src.count()


def test_export_csv_single_file_is_bounded(spark, tmpdir_path):
    path, rows = os.path.join(tmpdir_path, "csv"), fixtures.results(spark, SF001).limit(50)
    with pytest.raises(ValueError, match="over 49 rows"):
        sinks.export_csv(rows, path, single_file=True, most_rows=49)
    assert not os.path.exists(path)
    sinks.export_csv(rows, path, single_file=True, most_rows=50)
    assert spark.read.option("header", True).csv(path).count() == 50


def test_export_csv_single_file(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "one")
    sinks.export_csv(fixtures.results(spark, SF001).limit(50), path, single_file=True)
    parts = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(parts) == 1
    with open(os.path.join(path, parts[0])) as f:
        lines = f.read().splitlines()
    assert lines[0].startswith("SamplingPoint,") and len(lines) == 51
