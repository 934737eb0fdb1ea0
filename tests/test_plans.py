"""Plan shape: no Python in the hot path, broadcasts where bounded,
pushdown into the store scan, no shuffle of the exploded LOESS grid."""

import os

from pyspark.sql import functions as F

from fieldlab import fixtures
from fieldlab.operators import lines as L
from fieldlab.operators import trend
from fieldlab.operators.select import filter_dates
from fieldlab.plans import catalog
from fieldlab.sources import sinks
from fieldlab.sources.tables import load_store, read_since
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_has_no_python_udf(spark):
    p = _plan(catalog.clean_all(spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_station_join_is_broadcast(spark):
    res, st = catalog.store_tables(spark, SF001)
    from fieldlab.operators.select import select_results
    p = _plan(select_results(res, st, ["ST00001"], ["Param AF"]))
    assert "BroadcastHashJoin" in p


def test_store_scan_pushdown(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    sinks.write_results(sinks.prepare_results(fixtures.results(spark, SF001)), store, "full")
    df = spark.read.parquet(sinks.results_path(store))
    q = df.where((F.col("SamplingPoint") == "ST00001") & (F.col("DateSampled") >= "1998-01-01")
                 & (F.col("sample_year") >= 1998)).select("SamplingPoint", "DateSampled", "WebResult")
    p = _plan(q)
    assert "PushedFilters: [IsNotNull(SamplingPoint), IsNotNull(DateSampled), EqualTo(SamplingPoint,ST00001)" in p
    assert "PartitionFilters: [isnotnull(sample_year" in p
    assert "ReadSchema: struct<SamplingPoint:string,DateSampled:date,WebResult:string>" in p


def test_date_ranges_read_the_years_of_the_store_only(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "store")
    rows = sinks.prepare_results(fixtures.results(spark, SF001))
    sinks.write_results(rows, store, "full")
    df = load_store(spark, store)
    for got, want in ((filter_dates(df, "1996-03-01", "1997-05-31"), rows.where("DateSampled between '1996-03-01' and '1997-05-31'")),
                      (read_since(df, "1997-05-31"), rows.where("DateSampled > '1997-05-31'")),
                      (read_since(df, "1997-01-03", lookback_days=7), rows.where("DateSampled >= '1996-12-27'"))):
        p = _plan(got)
        assert "PartitionFilters: [isnotnull(sample_year" in p and "sample_year#" in p.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert got.count() == want.count() > 0
    # Frames without the store's year column, or with another date column, keep every row in the range.
    other = df.withColumnRenamed("DateSampled", "d")
    assert filter_dates(other, "1996-03-01", "1997-05-31", "d").count() == filter_dates(df, "1996-03-01", "1997-05-31").count()
    assert filter_dates(df.drop("sample_year"), None, "1997-05-31").count() == 0


def test_linear_stats_partial_aggregation(spark):
    p = _plan(trend.linear_stats(catalog.clean_all(spark, SF001)))
    assert "partial_regr_" in p or "partial_" in p


def test_loess_grid_not_shuffled(spark):
    p = _plan(L.loess_line(catalog.clean_all(spark, SF001)))
    above_generate = p.split("Generate")[0]
    assert "Exchange" not in above_generate


def test_incremental_read_pushed_to_scan(spark, tmpdir_path):
    from fieldlab.sources.tables import read_since
    store = os.path.join(tmpdir_path, "store")
    sinks.write_results(sinks.prepare_results(fixtures.results(spark, SF001)), store, "full")
    df = read_since(spark.read.parquet(sinks.results_path(store)), "1998-06-30")
    p = _plan(df)
    assert "GreaterThan(DateSampled,1998-06-30)" in p
    assert df.where(F.col("DateSampled") <= F.lit("1998-06-30").cast("date")).count() == 0


def test_freshness_reads_newest_partition_only(spark, tmpdir_path):
    from fieldlab.sources.tables import newest_partition
    store = os.path.join(tmpdir_path, "store")
    sinks.write_results(sinks.prepare_results(fixtures.results(spark, SF001)), store, "full")
    df = spark.read.parquet(sinks.results_path(store))
    newest = newest_partition(df)
    top = df.agg(F.max("sample_year")).first()[0]
    p = _plan(newest.agg(F.max("DateSampled")))
    assert f"PartitionFilters: [isnotnull(sample_year" in p and f"(sample_year#" in p and f"= {top})" in p
    assert newest.agg(F.max("DateSampled")).first()[0] == df.agg(F.max("DateSampled")).first()[0]
