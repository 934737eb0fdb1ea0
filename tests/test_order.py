"""Row numbers and pages from an order index, against a plain sort."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import frames as FM
from fieldlab.operators import order as OR
from fieldlab.plans import catalog
from fieldlab.sources import sinks
from fieldlab import fixtures
from conftest import SF001

SCHEMA = "`a b` string, d date, x double, n int"


def rows(hot=0):
    rng = random.Random(hot)
    some = [(rng.choice([None, "", "A", "a", "é", "ß'", 'q"`', "Zz\\"]), rng.choice([None, dt.date(2001, 2, 3), dt.date(1969, 5, 6)]),
             rng.choice([None, -1.5, 0.1 + 0.2, 1e300, math.inf, 7.0]), rng.choice([None, -3, 0, 9])) for _ in range(400)]
    return some + [("M", dt.date(2001, 1, 1), 1.0, 1)] * hot


def key(r):
    return tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in r)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.mark.parametrize("hot,per", [(0, 30), (900, 25), (0, 10_000)])
def test_pages_and_numbers(spark, hot, per):
    data = sorted(rows(hot), key=key)
    df = frame(spark, data)
    index = OR.build_index(df, rows_per_range=per)
    assert index.rows == len(data) and (len(index.counts) > 5) == (per < 100) and len(index.counts) <= -(-len(data) // per)
    pages = [p for p in range(index.pages(37)) if p % 4 == 0 or p == index.pages(37) - 1]
    for p in pages:
        assert [tuple(r) for r in OR.page_at(df, index, p, 37).collect()] == data[p * 37:(p + 1) * 37]
    assert OR.page_at(df, index, index.pages(37), 37).count() == 0 == OR.page_at(df, index, -1, 37).count()
    for hot_rows in (10, 10_000):
        got = OR.number_rows(df, out="id", index=index, hot_rows=hot_rows).collect()
        assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.id)] == data
        assert sorted(r.id for r in got) == list(range(1, len(data) + 1))


def test_a_page_over_many_ranges(spark):
    data = sorted(rows(), key=key)
    index = OR.build_index(frame(spark, data), rows_per_range=10)
    assert [tuple(r) for r in OR.page_at(frame(spark, data), index, 1, 150).collect()] == data[150:300]


def test_some_order_columns(spark):
    data = rows(50)
    df = frame(spark, data)
    index = OR.build_index(df, ["n", "a b"], rows_per_range=40)
    got = sorted(OR.number_rows(df, out="id", index=index).collect(), key=lambda r: r.id)
    assert [key((r["n"], r["a b"])) for r in got] == sorted(key((r[3], r[0])) for r in data)
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, data))


def test_empty_table(spark):
    df = frame(spark, rows()).where("false")
    index = OR.build_index(df)
    assert index.counts == (0,) and index.pages(10) == 0
    assert OR.page_at(df, index, 0, 10).count() == 0 and OR.number_rows(df, index=index).count() == 0


def test_the_index_is_bounded(spark):
    index = OR.build_index(frame(spark, rows()), rows_per_range=1, most=8)
    assert len(index.splitters) <= 7 and index.rows == 400


def test_a_deep_page_reads_one_range(spark, tmpdir_path):
    """Bounds on the first order column reach the scan; no offset over earlier rows."""
    path = f"{tmpdir_path}/store"
    sinks.write_results(sinks.prepare_results(fixtures.results(spark, SF001)), path, "full")
    df = spark.read.parquet(sinks.results_path(path)).select("SamplingPoint", "WebParameter", "DateSampled", "WebResult")
    index = OR.build_index(df, rows_per_range=200)
    last = OR.page_at(df, index, index.pages(10) - 1, 10)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(SamplingPoint,{index.splitters[-1][0]})" in plan
    assert "Offset" not in plan and "Limit" not in plan and "checkpoint" not in plan.lower()
    assert last.collect() == FM.page(df, index.pages(10) - 1, 10).collect()


def test_point_ids_store_nothing(spark):
    df = catalog.clean_all(spark, SF001)
    index = OR.build_index(df, FM.CLEAN_ORDER, rows_per_range=500)
    plan = FM.point_id(df, index=index)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "rangepartitioning" not in plan
    assert "Exchange hashpartitioning(_range" in plan


def test_default_order_is_every_column(spark):
    df = frame(spark, rows())
    assert OR.build_index(df).order == tuple(df.columns)
    assert OR.number_rows(df).agg(F.max("row_id")).first()[0] == 400
