"""Work done once a row, and LOESS lines as one streamed pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions import loess
from fieldlab.functions.cleaning import number_text
from fieldlab.operators import lines as L
from fieldlab.operators import order as OR
from fieldlab.operators import trend


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_number_text_formats_once(spark):
    df = spark.createDataFrame([(1.5,)], "v double").select(number_text("v").alias("t"))
    assert _plan(df).count("%.14e") == 1


def test_number_text_at_the_borders(spark):
    want = {1e5: "1e+05", 123456.0: "123456", 1e15: "1e+15", 123456789012345.0: "123456789012345", 1e-4: "1e-04",
            1.2e-4: "0.00012", 9.99e-5: "9.99e-05", 0.001: "0.001", 99999.5: "99999.5", -1.25e9: "-1.25e+09",
            0.1 + 0.2: "0.3", 1e-99: "1e-99", 1e-100: "1e-100", 1e100: "1e+100", 12345678.5: "12345678.5", 120.0: "120",
            1200000000.0: "1.2e+09", -0.0: "0"}
    rows = spark.createDataFrame([(v,) for v in want], "v double").select("v", number_text("v").alias("t")).collect()
    assert {r.v: r.t for r in rows} == want


def test_order_key_is_computed_once_a_row(spark):
    df = spark.createDataFrame([(f"x{i}",) for i in range(50)], "t string")
    df = df.select(F.regexp_replace("t", "x", "").alias("t"))
    index = OR.build_index(df, rows_per_range=5)
    plan = _plan(df.select(index.range_of().alias("r")))
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("aggregate("):]


def test_large_statistics_are_not_sorted_into_the_join(spark):
    df = spark.createDataFrame([(str(i), "p", "a") for i in range(20)], "SamplingPoint string, WebParameter string, x string")
    stats = df.select("SamplingPoint", "WebParameter", F.lit(3).alias("N"))
    out = df.join(trend.small_side(stats, max_rows=5), ["SamplingPoint", "WebParameter"], "left")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and out.where("N = 3").count() == 20


def _series(spark, n=9, dates=23):
    rng = np.random.default_rng(5)
    rows = [(f"s{s:02d}", int(d), float(rng.normal(10, 2))) for s in range(n) for d in rng.choice(900, dates + s, replace=False)]
    rows += [(None, d, 1.0) for d in range(12)] + [("few", 1, 1.0)]
    df = spark.createDataFrame(rows, "SiteParam string, d int, FinalResult double")
    return df.withColumn("DateSampled", F.date_add(F.lit("1990-01-01").cast("date"), F.col("d")))


def test_loess_line_is_one_pass_over_sorted_series(spark):
    plan = L.loess_line(_series(spark), band=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("records", [1, 7, 10_000])
def test_loess_series_across_arrow_batches(spark, records):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = _series(spark)
    spark.conf.set(key, str(records))
    try:
        got = L.loess_line(df, band=True, points=6, partitions=2).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 9 * 6 and {r.SiteParam for r in got} == {f"s{s:02d}" for s in range(9)}
    per = {}
    for r in df.where("SiteParam LIKE 's%'").select("SiteParam", F.unix_date("DateSampled").alias("x"), "FinalResult").collect():
        per.setdefault(r.SiteParam, []).append((r.x, r.FinalResult))
    for s, points in per.items():
        x, y = map(np.array, zip(*sorted(points)))
        want = loess.direct(x.astype(float), np.ones(len(x)), y, y * y, 6, 0.8, True)
        some = sorted((r for r in got if r.SiteParam == s), key=lambda r: r.i)
        assert np.allclose([r.yhat for r in some], want["yhat"]) and np.allclose([r.df for r in some], want["df"])


def test_direct_fit_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = np.arange(0.0, 300.0, 7), rng.normal(0, 1, 43)
    whole = loess.direct(x, np.ones(43), y, y * y, 80, 0.8, True)
    monkeypatch.setattr(loess, "MOST_CELLS", 100)
    part = loess.direct(x, np.ones(43), y, y * y, 80, 0.8, True)
    assert all(np.allclose(whole[k], part[k]) for k in ("x", "yhat", "norm", "s", "df"))
