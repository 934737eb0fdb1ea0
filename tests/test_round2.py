"""Long keys, empty selections, partial dates, broadcast bounds, checkpoint folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldlab import fixtures
from fieldlab.functions.cleaning import to_sample_date
from fieldlab.operators import coverage as CV
from fieldlab.operators import directory as D
from fieldlab.operators import joins
from fieldlab.session import checkpoint_dir
from fieldlab.sources.tables import read_parquet


def test_long_keys_stay_apart(spark):
    keys = spark.createDataFrame([(7,), (12345,), (123456,), (123457,)], "k int")
    assert [r[0] for r in keys.select(fixtures._site_code(F.col("k"))).collect()] == ["ST00007", "ST12345", "ST123456", "ST123457"]


def test_offered_pairs_are_not_cut(spark):
    options = spark.range(1500).select(F.format_string("P%05d", "id").alias("WebParameter"))
    got = CV.offered_pairs(options, ["b", "a"])
    assert got.count() == 3000 and got.agg(F.max("p_pos")).first()[0] == 1500
    assert {(r.Site, r.s_pos) for r in got.select("Site", "s_pos").distinct().collect()} == {("b", 1), ("a", 2)}


def test_offered_pairs_are_numbered_in_many_tasks(spark):
    options = spark.range(1500).select(F.format_string("P%05d", F.col("id") * 7 % 1500).alias("WebParameter"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = CV.offered_pairs(options, ["a"]).select("Parameter", "p_pos", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set(key, before)
    assert len({r.task for r in got}) > 1
    assert [r.Parameter for r in sorted(got, key=lambda r: r.p_pos)] == [f"P{i:05d}" for i in range(1500)]
    assert sorted(r.p_pos for r in got) == list(range(1, 1501))


def test_empty_selections(spark):
    assert CV.requested_pairs(spark, ["a"], []).count() == 0
    none = spark.createDataFrame([], "x string")
    one = spark.createDataFrame([("a",)], "x string")
    assert D.same_set(none, none, "x").first().same is True and D.same_set(none, one, "x").first().same is False


def test_partial_dates_are_no_dates(spark):
    got = spark.createDataFrame([("2020",), ("2020-05",), ("2020-05-06",), ("2020-05-06 07:08:09",), ("2020/05/06",)], "d string")
    assert [str(r[0]) for r in got.select(to_sample_date("d")).collect()] == ["None", "None", "2020-05-06", "2020-05-06", "2020-05-06"]


def test_broadcast_bounds(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(joins.bounded_broadcast(wide)) and not hint(joins.bounded_broadcast(wide, max_rows=9))
    assert not hint(joins.bounded_broadcast(wide, max_bytes=5000))


def test_reader_pushes_filters(spark, tmpdir_path):
    spark.range(100).write.mode("overwrite").parquet(tmpdir_path)
    plan = read_parquet(spark, tmpdir_path).where("id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and "Exchange" not in plan


def test_cluster_without_shared_folder_is_an_error():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:1")
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_number_text_forms(spark):
    from fieldlab.functions.cleaning import number_text
    cases = [(0.0005, "5e-04"), (0.00051, "0.00051"), (0.001, "0.001"), (100000.0, "1e+05"), (123456.0, "123456"),
             (12345678.0, "12345678"), (0.1, "0.1"), (12.3, "12.3"), (-0.25, "-0.25"), (1e-15, "1e-15"),
             (1e100, "1e+100"), (1234567.891, "1234567.891"), (0.0, "0"), (45.0, "45"), (1 / 3, "0.333333333333333"),
             (float("nan"), "NaN"), (float("-inf"), "-Inf"), (None, "NA")]
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double").select(
        "i", number_text("v").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in cases]


def _rows(spark, days):
    return spark.createDataFrame([("S1", d, "P", "1", None, None) for d in days],
                                 "StationID string, DateSampled string, WebParameter string, WebResult string, "
                                 "Qualifier string, RelativeDepthSample string")


def test_refresh_reports_read_errors_and_raises_write_errors(spark, tmp_path, monkeypatch):
    import pytest
    from fieldlab.sources import refresh as R
    store, later = str(tmp_path / "store"), "2021-01-01 00:00:00"
    st = spark.createDataFrame([("S1", "x")], "StationID string, Description string")
    R.refresh(spark, lambda: (_rows(spark, ["2020-01-01"]), st), store, "2020-01-02 00:00:00")

    def broken():
        raise OSError("no route")
    rep = R.refresh(spark, broken, store, later)
    assert rep.action == "fallback" and "no route" in rep.error
    unreadable = _rows(spark, ["2020-02-01"]).selectExpr("* except (WebResult)", "raise_error('bad page') AS WebResult")
    rep = R.refresh(spark, lambda: (unreadable, st), store, later)
    assert rep.action == "fallback" and "bad page" in rep.error
    def full(*a, **k):
        raise RuntimeError("disk full")
    monkeypatch.setattr(R.sinks, "overwrite", full)
    with pytest.raises(RuntimeError, match="disk full"):
        R.refresh(spark, lambda: (_rows(spark, ["2020-02-01"]), st), store, later)


def test_stream_dedup_reads_only_the_batch_years(spark, tmp_path):
    from fieldlab.sources import sinks
    from fieldlab.streaming.ingest import drop_stored
    store = str(tmp_path / "store")
    sinks.write_results(sinks.prepare_results(_rows(spark, ["2019-05-01", "2020-05-01", "2021-05-01", None])), store, "full")
    batch = sinks.prepare_results(_rows(spark, ["2020-05-01", "2020-06-01", None]))
    out = drop_stored(batch, store)
    assert [str(r["DateSampled"]) for r in out.collect()] == ["2020-06-01"]
    plan = out._jdf.queryExecution().toString()
    part = plan[plan.index("PartitionFilters"):]
    assert "sample_year" in part[:200]


def test_loess_draws_small_series(spark):
    from fieldlab.operators import lines as L
    rows = [(f"S{n} - P", f"2020-01-{d + 1:02d}", float(d * d)) for n in (4, 5, 7) for d in range(n)]
    df = spark.createDataFrame(rows, "SiteParam string, d string, FinalResult double").selectExpr(
        "SiteParam", "cast(d as date) AS DateSampled", "FinalResult")
    out = L.loess_line(df, points=5)
    fits = {r["SiteParam"]: r["n"] for r in out.groupBy("SiteParam").agg({"yhat": "count"}).withColumnRenamed(
        "count(yhat)", "n").collect()}
    assert set(fits) == {"S5 - P", "S7 - P"} and all(n > 0 for n in fits.values())
