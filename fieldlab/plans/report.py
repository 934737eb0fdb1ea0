"""The application's "display data" action as one composed plan.

Given the stored results and stations, a site and parameter selection, an
optional date range and the trend kind, ``selection_report`` returns every
frame the application shows: the gap message, the date bounds, the cleaned
rows, the display table, the plot points, the trend statistics with their
status text, and the fitted lines.  All frames are lazy; nothing is
collected except the one-row facet/size decisions of the points frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldlab.operators import coverage, frames, lines, trend
from fieldlab.operators.clean import clean
from fieldlab.operators.select import filter_dates, select_results


@dataclass
class SelectionReport:
    clean: DataFrame          # cleaned rows of the selection (and date range)
    message: DataFrame        # one row: gap text, no-data text or NULL
    bounds: DataFrame         # one row: first and last sample date (before the range filter)
    table: DataFrame          # display table (display names)
    points: DataFrame | None  # plot points (facet, colour, shape, size, label, id)
    stats: DataFrame          # Site, Parameter, N, R_squared, p_value (4 decimals)
    status: DataFrame         # one row: status text of the trend
    line: DataFrame           # fitted line (and band) per series


def selection_report(results: DataFrame, stations: DataFrame, sites, params, start=None, end=None,
                     trend_kind: str = "linear", band: bool = True, facet: str | None = None,
                     profile: str = "current", with_points: bool = True) -> SelectionReport:
    """Everything the display action shows for one selection."""
    if trend_kind not in ("linear", "loess"):
        raise ValueError("trend_kind must be 'linear' or 'loess'")
    sites, params = list(sites), list(params)
    raw = select_results(results, stations, sites, params)
    df = clean(raw, profile)
    message = coverage.missing_message(df, sites, params)
    bounds = coverage.date_bounds(df)
    if start is not None and end is not None:
        df = filter_dates(df, start, end)
    stats = trend.linear_stats(df)
    if trend_kind == "linear":
        line = lines.linear_line(df, band=band)
        status = trend.stats_status(stats, "linear")
    else:
        line = lines.loess_surface(df, band=band)
        status = trend.stats_status(stats, "loess")
    return SelectionReport(
        clean=df, message=message, bounds=bounds, table=frames.display_table(df),
        points=frames.points_frame(df, facet, profile) if with_points else None,
        stats=trend.stats_table(stats), status=status, line=line)


__all__ = ["SelectionReport", "selection_report"]
