"""End-to-end flow on the driver tables, as the application runs it.

refresh the store -> site directory -> options for the selected sites ->
retrieve and clean -> date bounds and gaps -> trend statistics, lines ->
plot points and a display page -> CSV export.

Usage: python scripts/demo.py [sf_dir] [out_dir]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fieldlab import fixtures  # noqa: E402
from fieldlab.operators import coverage, directory, frames, lines, trend  # noqa: E402
from fieldlab.operators.clean import clean  # noqa: E402
from fieldlab.operators.select import filter_dates, select_results  # noqa: E402
from fieldlab.session import get_spark  # noqa: E402
from fieldlab.sources import sinks  # noqa: E402
from fieldlab.sources.refresh import refresh  # noqa: E402
from fieldlab.sources.tables import load_store  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="fieldlab-demo-", dir="/tmp")
    spark = get_spark("local[8]", 16)
    store = f"{out}/store"

    # The source system: results with the server's key name, and stations.
    def source():
        raw = fixtures.results(spark, sf_dir).withColumnRenamed("SamplingPoint", "StationID")
        return raw, fixtures.stations(spark, sf_dir)

    report = refresh(spark, source, store, "2001-11-20 08:00:00")
    print(f"refresh: {report.action}, {report.rows_loaded} rows; {report.message}")

    results = load_store(spark, store, "results")
    stations = load_store(spark, store, "stations")
    site_dir = directory.site_directory(results, stations)
    print("sites:", site_dir.count())

    sites = ["ST00001", "ST00002", "ST00013"]
    params = [r[0] for r in directory.available_params(results, sites).collect()][:3] + ["Param ZZ"]
    print("descriptions:", [tuple(r) for r in directory.describe_sites(spark, site_dir, sites).collect()])

    df = clean(select_results(results, stations, sites, params))
    bounds = coverage.date_bounds(df).first()
    print("dates:", bounds["min_date"], "to", bounds["max_date"])
    print(coverage.missing_message(df, sites, params).first()["message"])

    df = filter_dates(df, "1996-01-01", "2000-12-31")
    trend.stats_table(trend.linear_stats(df)).orderBy("Site", "Parameter").show(truncate=False)
    print(trend.stats_status(trend.linear_stats(df)).first()["status"])
    band = lines.loess_line(df, band=True, partitions=8)
    band.where(F.col("i").isin(0, 40, 79)).orderBy("SiteParam", "i").show(6)

    points = frames.points_frame(df)
    points.select("point_id", "facet", "colour", "shape", "size", "label").orderBy("point_id").show(3, truncate=60)
    frames.page(frames.display_table(df), 0).show(truncate=False)

    sinks.export_csv(frames.display_table(df), f"{out}/table_csv")
    print("csv written to", f"{out}/table_csv")
    spark.stop()


if __name__ == "__main__":
    main()
