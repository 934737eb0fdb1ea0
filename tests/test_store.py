"""Kept statistics, zones and merged loads of the store."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fieldlab import fixtures
from fieldlab.operators import freshness as FR
from fieldlab.operators import lines as L
from fieldlab.operators import moments as M
from fieldlab.operators import trend
from fieldlab.operators.clean import clean
from fieldlab.operators.select import RAW_COLUMNS
from fieldlab.sources import files, sinks
from fieldlab.sources import store as ST
from fieldlab.sources import tables as TB
from fieldlab.streaming.ingest import drop_stored, stream_ingest
from conftest import SF001

COLUMNS = [*RAW_COLUMNS, "sample_year"]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def close(got, want, keys=2):
    key = lambda r: repr(tuple(r)[:keys])
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert [r[:keys] for r in got] == [r[:keys] for r in want] and got
    for a, b in zip(got, want):
        for x, y in zip(a[keys:], b[keys:]):
            assert x == (None if y is None else pytest.approx(y, rel=1e-7, abs=1e-12))


@pytest.fixture()
def loaded(spark, tmpdir_path):
    """A store of three loads and one without rows."""
    store = os.path.join(tmpdir_path, "store")
    rows = sinks.prepare_results(fixtures.results(spark, SF001))
    day = F.col("DateSampled")
    for tag, cond in (("full", day < "1994-01-01"), ("inc-1", day.between("1994-01-01", "1996-06-30")),
                      ("inc-2", day > "1996-06-30"), ("inc-3", day > "2999-01-01")):
        sinks.write_results(rows.where(cond), store, tag)
    return store, rows


def test_statistics_and_lines_from_moments(spark, loaded):
    store, rows = loaded
    df = clean(rows.select(*RAW_COLUMNS))
    kept = ST.moments(spark, store)
    close(trend.stats_from_moments(kept, min_n=8).collect(), trend.linear_stats(df).collect())
    plan = trend.stats_from_moments(ST.moments(spark, store), min_n=8)._jdf.queryExecution().executedPlan().toString()
    assert "/moments" in plan and "/results" not in plan
    by = ["SamplingPoint", "WebParameter"]
    close(L.line_from_moments(kept.where("N >= 8"), by, band=True).collect(), L.linear_line(df, by, band=True).collect(), keys=3)


def test_replayed_load_replaces_its_moments(spark, loaded):
    store, rows = loaded
    before = ST.moments(spark, store).count()
    less = rows.where((F.col("DateSampled") > "1996-06-30") & (F.col("WebParameter") == "Param NO"))
    sinks.write_results(less, store, "inc-2")
    assert "inc-2" not in ST._names(spark, f"{store}/moments") and before > 0
    now = clean(ST.read_results(spark, store).select(*RAW_COLUMNS))
    close(trend.stats_from_moments(ST.moments(spark, store), min_n=8).collect(), trend.linear_stats(now).collect())


def test_moments_of_odd_series(spark):
    """One date, constant results, missing dates, and loads of one row each."""
    day = lambda k: dt.date(2001, 1, 1) + dt.timedelta(days=k)
    data = [("a", "p", day(k), 7.0) for k in range(9)] + [("b", "p", day(3), float(k)) for k in range(9)]
    data += [("c", "p", None, 1.0)] * 4 + [("c", "p", day(k * k), 1e6 + k) for k in range(12)] + [("d", "p", None, 2.0)]
    df = spark.createDataFrame([(*r, "Measured value") for r in data],
                               "SamplingPoint string, WebParameter string, DateSampled date, FinalResult double, DL string")
    parts = [M.partial_moments(df.where(F.pmod(F.xxhash64("DateSampled", "FinalResult"), F.lit(5)) == k)) for k in range(5)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    for n in (0, 8):
        close(trend.stats_from_moments(M.merged(states), min_n=n).collect(), trend.linear_stats(df, min_n=n).collect())


def test_zones_answer_coverage(spark, loaded):
    store, rows = loaded
    z = ST.zones(spark, store)
    assert FR.date_coverage(z, "min_date", "max_date").collect() == FR.date_coverage(rows).collect()
    for kind in ("cached", "reloaded"):
        assert FR.coverage_message(z, kind, "min_date", "max_date").collect() == FR.coverage_message(rows, kind).collect()
    assert FR.is_fresh(z, "1999-01-01", col="max_date").collect() == FR.is_fresh(rows, "1999-01-01").collect()
    assert z.agg(F.sum("n")).first()[0] == rows.count()
    plan = z.agg(F.max("max_date"))._jdf.queryExecution().executedPlan().toString()
    assert "/zones" in plan and "/results" not in plan
    one = ST.zones(spark, store, exclude=("inc-2",)).agg(F.max("max_date")).first()[0]
    assert one == rows.where("DateSampled <= '1996-06-30'").agg(F.max("DateSampled")).first()[0]


def test_missing_entries_are_made_again(spark, loaded):
    store, rows = loaded
    whole = ST.zones(spark, store).count()
    sinks.forget(spark, store, "inc-1")          # as after a failure between a load and its entries
    assert ST.zones(spark, store).count() == whole
    assert ST.moments(spark, store).agg(F.sum("N")).first()[0] == clean(rows.select(*RAW_COLUMNS)).where(
        "DL = 'Measured value'").count()


def test_merged_loads(spark, tmpdir_path, monkeypatch):
    store, landing = os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "landing")
    ev = fixtures.event_results(spark, SF001)
    want = rows_of(sinks.prepare_results(ev))
    for k in range(4):
        ev.where(F.pmod(F.xxhash64("SamplingPoint"), F.lit(4)) == k).write.parquet(f"{landing}/part{k}")
    run = lambda: stream_ingest(spark, landing + "/*", store, os.path.join(tmpdir_path, "ckpt"),
                                max_files_per_trigger=1).awaitTermination()
    run()
    tags = ST.loads(spark, store)
    assert len(tags) > 1 and rows_of(ST.read_results(spark, store)) == want
    early = ST.read_results(spark, store)          # a reader from before the merge
    # A run that stops before its marker changes nothing.
    monkeypatch.setattr(files, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ST.merge_loads(spark, store, "one")
    assert rows_of(ST.read_results(spark, store)) == want and ST.loads(spark, store) == tags
    monkeypatch.undo()
    assert ST.merge_loads(spark, store, "one") == "merge-one"
    assert ST.loads(spark, store) == ["merge-one"]
    assert rows_of(ST.read_results(spark, store)) == want and rows_of(early) == want
    assert rows_of(TB.load_store(spark, store)) == want
    # A replay of a replaced load adds nothing, before and after the old folders go.
    for _ in range(2):
        again = sinks.prepare_results(ev.limit(30))
        sinks.write_results(again, store, tags[0])
        assert rows_of(ST.read_results(spark, store)) == want
        assert drop_stored(again, store).count() == 0
        assert ST.drop_replaced(spark, store) == tags
    assert ST._names(spark, sinks.results_path(store)) == {"merge-one"}
    assert ST.zones(spark, store).agg(F.sum("n")).first()[0] == len(want)
    # The stream goes on; a later merge may take in an earlier one.
    ev.limit(7).write.parquet(f"{landing}/part9")
    run()
    assert len(ST.loads(spark, store)) == 2
    ST.merge_loads(spark, store, "two", tags=ST.loads(spark, store))
    assert ST.loads(spark, store) == ["merge-two"] and ST.read_results(spark, store).count() == len(want) + 7
    assert ST.merge_loads(spark, store, "three") is None
    with pytest.raises(ValueError):
        ST.merge_loads(spark, store, "four", tags=["merge-one", "merge-two"])


def test_replaced_table_survives_failures(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "stations")
    one, two = spark.createDataFrame([("a",)], "StationID string"), spark.createDataFrame([("b",), ("c",)], "StationID string")
    sinks.overwrite(one, path)
    bad = one.select(F.raise_error(F.lit("lost")).cast("string").alias("StationID"))
    with pytest.raises(Exception, match="lost"):
        sinks.overwrite(bad, path)
    assert spark.read.parquet(path).count() == 1
    # Stopped between the renames: the old table is put back by the next reader or writer.
    step = files.rename
    calls = []

    def once(s, a, b):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        step(s, a, b)
    monkeypatch.setattr(files, "rename", once)
    with pytest.raises(OSError):
        sinks.overwrite(two, path)
    monkeypatch.undo()
    assert not os.path.exists(path)
    assert TB.load_store(spark, tmpdir_path, "stations").count() == 1
    sinks.overwrite(two, path)
    sinks.overwrite(spark.read.parquet(path).where("StationID = 'c'"), path)     # from itself
    assert [r[0] for r in spark.read.parquet(path).collect()] == ["c"]
