"""The composed display action on the driver tables."""

from fieldlab.plans import catalog
from fieldlab.plans.report import selection_report
from conftest import SF01


def test_selection_report(spark):
    res, st = catalog.store_tables(spark, SF01)
    sites, params = ["ST00001", "ST00002", "ST99999"], ["Param AF", "Param ZZ"]
    rep = selection_report(res, st, sites, params, "1996-01-01", "2000-12-31")
    assert rep.message.first()["message"].startswith("No data available for the following")
    assert rep.bounds.first()["min_date"] is not None
    n = rep.clean.count()
    assert rep.table.count() == n and rep.points.count() == n
    assert {r["point_id"] for r in rep.points.collect()} == set(range(1, n + 1))
    stats = rep.stats.collect()
    assert {(r["Site"], r["Parameter"]) for r in stats} == {("ST00001", "Param AF"), ("ST00002", "Param AF")}
    assert rep.status.first()["status"].startswith("Note:")
    assert rep.line.count() == 2 * 80
    loess = selection_report(res, st, sites, params, trend_kind="loess", with_points=False)
    assert loess.status.first()["status"].startswith("LOESS is exploratory")
    assert loess.line.where("yhat IS NOT NULL").count() > 0


def test_empty_selection(spark):
    res, st = catalog.store_tables(spark, SF01)
    rep = selection_report(res, st, [], ["Param AF"], with_points=False)
    assert rep.clean.count() == 0
    assert rep.message.first()["message"] == "No data available for selected sites and parameters."
    assert rep.stats.count() == 0
    assert rep.status.first()["status"].startswith("No groups have 8 or more")
    assert rep.line.count() == 0
