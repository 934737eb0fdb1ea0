"""Registered queries: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the driver's tables
(through the fixture adapter), paired with its DuckDB twin in
``SQL``.  Queries run over whole tables; fixed selections appear only where
selecting is the operator being shown (retrieval, option lists, gaps).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import fixtures
from fieldlab.fixtures import PARAMS, SITES
from fieldlab.operators.clean import clean
from fieldlab.operators.keys import trim_keys
from fieldlab.operators.select import select_results
from fieldlab.operators import trend
from fieldlab.plans import oracle as O
from fieldlab import schema as S
from fieldlab.functions import cleaning as CF
from fieldlab.functions.cleaning import to_sample_date
from fieldlab.operators import coverage as CV
from fieldlab.operators import directory as D
from fieldlab.operators import frames as FM
from fieldlab.operators import freshness as FR
from fieldlab.operators import lines as L
from fieldlab.operators import order as OR
from fieldlab.operators import search as SE
from fieldlab.operators.clean import drop_unparsed, factor_code
from fieldlab.operators.joins import values_frame
from fieldlab.operators.keys import align_columns, dates_as_text
from fieldlab.operators.select import RAW_COLUMNS, filter_dates, has_rows, with_station
from fieldlab.session import checkpoint_dir
from fieldlab.sources import sinks
from fieldlab.sources import store as store_loads
from fieldlab.sources import tables as TB
from fieldlab.sources.refresh import refresh
from fieldlab.streaming.ingest import stream_ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared inputs
# ---------------------------------------------------------------------------

def store_tables(spark: SparkSession, sf_dir: str):
    """Results and stations with trimmed keys (the store's state after
    ingest; the results side is materialized once per session)."""
    res = fixtures.results_store(spark, sf_dir)
    st = trim_keys(fixtures.stations(spark, sf_dir), "StationID")
    return res, st


def clean_all(spark: SparkSession, sf_dir: str, profile: str = "current") -> DataFrame:
    res, st = store_tables(spark, sf_dir)
    return clean(select_results(res, st), profile)


def clean_selected(spark: SparkSession, sf_dir: str, profile: str = "current") -> DataFrame:
    res, st = store_tables(spark, sf_dir)
    return clean(select_results(res, st, SITES, PARAMS), profile)


# ---------------------------------------------------------------------------
# Flagship: whole-table linear trend statistics
# ---------------------------------------------------------------------------

@register("a7_stats_table", O.with_clean() + ",\n" + O.stats_cte() + """
SELECT Site, Parameter, N, round(R_squared, 4) AS R_squared, round(p_value, 4) AS p_value FROM stats""")
def q_stats_table(spark, sf_dir):
    return trend.stats_table(trend.linear_stats(clean_all(spark, sf_dir)))


@register("a6_linear_stats", O.with_clean() + ",\n" + O.stats_cte() + """
SELECT Site, Parameter, N, round(R_squared, 9) AS R_squared, round(p_value, 9) AS p_value FROM stats""")
def q_linear_stats(spark, sf_dir):
    s = trend.linear_stats(clean_all(spark, sf_dir))
    return s.withColumns({"R_squared": F.round("R_squared", 9), "p_value": F.round("p_value", 9)})


# ---------------------------------------------------------------------------
# Cleaning (three profiles) and retrieval
# ---------------------------------------------------------------------------

_CLEAN_COLS = ("SamplingPoint, RelativeDepthComments, DateSampled, WebParameter, FinalResult, "
               "Qualifiers, Description, DL, legend_shape, SiteParam")

for _prof in ("current", "v2", "v1"):
    def _mk(profile):
        def q(spark, sf_dir):
            return clean_all(spark, sf_dir, profile)
        return q
    register(f"c16_clean_{_prof}", O.with_clean(_prof) + f"\nSELECT {_CLEAN_COLS} FROM clean")(_mk(_prof))


@register("q2_select_results", "WITH " + O.FIXTURE_CTE + ",\n" + O.raw_cte(O.selection_where())
          + "\nSELECT * FROM raw")
def q_select_results(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return select_results(res, st, SITES, PARAMS)


# ---------------------------------------------------------------------------
# Retrieval variants (Q1, Q3-Q5, Q8, Q9)
# ---------------------------------------------------------------------------


_RAW_SELECT = "SELECT * FROM raw"


@register("q1_with_station", "WITH " + O.FIXTURE_CTE + ",\n" + O.raw_cte() + "\n" + _RAW_SELECT)
def q_with_station(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return with_station(res.select(*RAW_COLUMNS), st)


@register("q3_sites_one_param", "WITH " + O.FIXTURE_CTE + ",\n"
          + O.raw_cte(f"r.SamplingPoint IN ({O.SITES_SQL}) AND r.WebParameter = 'Param NO'") + "\n" + _RAW_SELECT)
def q_sites_one_param(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return select_results(res, st, SITES, "Param NO")


@register("q4_one_site_params", "WITH " + O.FIXTURE_CTE + ",\n"
          + O.raw_cte(f"r.SamplingPoint = 'ST00002' AND r.WebParameter IN ({O.PARAMS_SQL})") + "\n" + _RAW_SELECT)
def q_one_site_params(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return select_results(res, st, "ST00002", PARAMS)


@register("q5_one_site_one_param", "WITH " + O.FIXTURE_CTE + ",\n"
          + O.raw_cte("r.SamplingPoint = 'ST00003' AND r.WebParameter = 'Param AF'") + "\n" + _RAW_SELECT)
def q_one_site_one_param(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return select_results(res, st, "ST00003", "Param AF")


@register("q8_has_rows", "WITH " + O.FIXTURE_CTE + ",\n" + O.raw_cte(O.selection_where())
          + "\nSELECT count(*) > 0 AS has_rows FROM raw")
def q_has_rows(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return has_rows(select_results(res, st, SITES, PARAMS))


@register("q8_has_rows_empty", "WITH " + O.FIXTURE_CTE + ",\n"
          + O.raw_cte("r.SamplingPoint = 'ST99999'") + "\nSELECT count(*) > 0 AS has_rows FROM raw")
def q_has_rows_empty(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return has_rows(select_results(res, st, "ST99999"))


_DATE_LO, _DATE_HI = "1996-01-01", "1997-12-31"


@register("q9_filter_dates", O.with_clean() + f"""
SELECT {_CLEAN_COLS} FROM clean WHERE DateSampled BETWEEN DATE '{_DATE_LO}' AND DATE '{_DATE_HI}'""")
def q_filter_dates(spark, sf_dir):
    return filter_dates(clean_all(spark, sf_dir), _DATE_LO, _DATE_HI)


# ---------------------------------------------------------------------------
# Directory and option lists
# ---------------------------------------------------------------------------


_DIR_SQL = ("dir AS (SELECT DISTINCT r.SamplingPoint, s.Description FROM "
            "(SELECT DISTINCT SamplingPoint FROM r_t) r LEFT JOIN s_t s ON r.SamplingPoint = s.StationID)")
_WITH_DIR = "WITH " + O.FIXTURE_CTE + ",\n" + _DIR_SQL


def _values_sql(name: str, col: str, values) -> str:
    rows = ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(values))
    return f"{name}(pos, {col}) AS (VALUES {rows})"


def directory_of(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return D.site_directory(res, st)


@register("d1_site_directory", _WITH_DIR + "\nSELECT SamplingPoint, Description FROM dir")
def q_site_directory(spark, sf_dir):
    return directory_of(spark, sf_dir)


@register("d2_available_params", "WITH " + O.FIXTURE_CTE + f"""
SELECT DISTINCT WebParameter FROM r_t WHERE SamplingPoint IN ({O.SITES_SQL}) AND WebParameter IS NOT NULL""")
def q_available_params(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    return D.available_params(res, SITES)


@register("d3_available_params_one_site", "WITH " + O.FIXTURE_CTE + """
SELECT DISTINCT WebParameter FROM r_t WHERE SamplingPoint = 'ST00002' AND WebParameter IS NOT NULL""")
def q_available_params_one(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    return D.available_params(res, "ST00002")


_CUR_PARAMS = ["Param RF", "Param ZZ", "Param AF", "Param NO", "Param AF"]


@register("d4_valid_selection", "WITH " + O.FIXTURE_CTE + ",\n" + _values_sql("cur", "WebParameter", _CUR_PARAMS)
          + f""",
opts AS (SELECT DISTINCT WebParameter FROM r_t WHERE SamplingPoint IN ({O.SITES_SQL}))
SELECT min(pos) AS pos, WebParameter FROM cur WHERE WebParameter IN (SELECT WebParameter FROM opts)
GROUP BY WebParameter""")
def q_valid_selection(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    return D.valid_selection(spark, _CUR_PARAMS, D.available_params(res, SITES), "WebParameter")


_SEL_SITES = ["ST00013", "ST00001", "ST00002", "ST00011", "ST00003", "ST99999", "ST00001"]


@register("d5_describe_sites", _WITH_DIR + ",\n" + _values_sql("sel", "SamplingPoint", _SEL_SITES) + """,
firsts AS (SELECT sel.pos, sel.SamplingPoint, min(dir.Description) AS Description
  FROM sel JOIN dir ON sel.SamplingPoint = dir.SamplingPoint GROUP BY sel.pos, sel.SamplingPoint)
SELECT min(pos) AS pos, Description FROM firsts GROUP BY Description""")
def q_describe_sites(spark, sf_dir):
    return D.describe_sites(spark, directory_of(spark, sf_dir), _SEL_SITES)


_SEL_DESCS = ["Reach 3", "Reach 17", "Reach 0", "Reach 99", "Reach 3"]


@register("d6_sites_for", _WITH_DIR + ",\n" + _values_sql("sel", "Description", _SEL_DESCS) + """
SELECT min(sel.pos) AS pos, dir.SamplingPoint FROM sel JOIN dir ON sel.Description = dir.Description
GROUP BY dir.SamplingPoint""")
def q_sites_for(spark, sf_dir):
    return D.sites_for(spark, directory_of(spark, sf_dir), _SEL_DESCS)


@register("d7_first_site", _WITH_DIR + ",\n" + _values_sql("sel", "Description", _SEL_DESCS) + """,
firsts AS (SELECT sel.pos, min(dir.SamplingPoint) AS SamplingPoint FROM sel JOIN dir
  ON sel.Description = dir.Description GROUP BY sel.pos, sel.Description)
SELECT min(pos) AS pos, SamplingPoint FROM firsts GROUP BY SamplingPoint""")
def q_first_site(spark, sf_dir):
    return D.sites_for(spark, directory_of(spark, sf_dir), _SEL_DESCS, first=True)


@register("d7_first_description", _WITH_DIR + """
SELECT min(Description) AS Description FROM dir WHERE SamplingPoint = 'ST00002' HAVING count(*) > 0""")
def q_first_description(spark, sf_dir):
    return D.first_description(directory_of(spark, sf_dir), "ST00002")


@register("d8_same_set", "WITH " + O.FIXTURE_CTE + """,
a AS (SELECT DISTINCT SamplingPoint AS v FROM r_t WHERE WebParameter = 'Param AF'),
b AS (SELECT DISTINCT SamplingPoint AS v FROM r_t WHERE WebParameter = 'Param NO')
SELECT (SELECT count(*) FROM (SELECT v FROM a EXCEPT SELECT v FROM b))
     + (SELECT count(*) FROM (SELECT v FROM b EXCEPT SELECT v FROM a)) = 0 AS same""")
def q_same_set(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    return D.same_set(res.where(F.col("WebParameter") == "Param AF"),
                      res.where(F.col("WebParameter") == "Param NO"), "SamplingPoint")


@register("d8_same_set_selection", _WITH_DIR + ",\n" + _values_sql("sel", "SamplingPoint", _SEL_SITES) + """,
a AS (SELECT DISTINCT SamplingPoint AS v FROM dir WHERE Description IN ('Reach 3', 'Reach 17')),
b AS (SELECT DISTINCT SamplingPoint AS v FROM sel)
SELECT (SELECT count(*) FROM (SELECT v FROM a EXCEPT SELECT v FROM b))
     + (SELECT count(*) FROM (SELECT v FROM b EXCEPT SELECT v FROM a)) = 0 AS same""")
def q_same_set_selection(spark, sf_dir):
    d = directory_of(spark, sf_dir)
    a = d.where(F.col("Description").isin("Reach 3", "Reach 17"))
    return D.same_set(a, values_frame(spark, "SamplingPoint", _SEL_SITES), "SamplingPoint")


@register("d9_search_sites", _WITH_DIR + """
SELECT DISTINCT SamplingPoint FROM dir WHERE SamplingPoint IS NOT NULL
  AND contains(lower(SamplingPoint), 'st0001') ORDER BY SamplingPoint""")
def q_search_sites(spark, sf_dir):
    return D.search_sites(directory_of(spark, sf_dir), "ST0001")


@register("d9_search_params", "WITH " + O.FIXTURE_CTE + """
SELECT DISTINCT WebParameter FROM r_t WHERE WebParameter IS NOT NULL
  AND contains(lower(WebParameter), 'f') ORDER BY WebParameter""")
def q_search_params(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    return D.search_params(res, "F")


# ---------------------------------------------------------------------------
# Coverage (A1-A5b)
# ---------------------------------------------------------------------------


_WITH_SEL_CLEAN = O.with_clean(where=O.selection_where())


def _req_sql() -> str:
    s = ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(SITES))
    p = ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(PARAMS))
    return (f"ss(s_pos, Site) AS (VALUES {s}),\npp(p_pos, Parameter) AS (VALUES {p}),\n"
            "req AS (SELECT Site, Parameter, s_pos, p_pos FROM ss, pp)")


@register("a1_date_bounds", O.with_clean() + "\nSELECT min(DateSampled) AS min_date, max(DateSampled) AS max_date FROM clean")
def q_date_bounds(spark, sf_dir):
    return CV.date_bounds(clean_all(spark, sf_dir))


@register("a1_date_bounds_selected", _WITH_SEL_CLEAN
          + "\nSELECT min(DateSampled) AS min_date, max(DateSampled) AS max_date FROM clean")
def q_date_bounds_selected(spark, sf_dir):
    return CV.date_bounds(clean_selected(spark, sf_dir))


def _offered_params_sql() -> str:
    return (f"pp AS (SELECT CAST(row_number() OVER (ORDER BY WebParameter) AS INTEGER) AS p_pos, WebParameter AS Parameter "
            f"FROM (SELECT DISTINCT WebParameter FROM r_t WHERE SamplingPoint IN ({O.SITES_SQL}) "
            f"AND WebParameter IS NOT NULL))")


@register("a2_requested_pairs", "WITH " + O.FIXTURE_CTE + ",\n"
          + "ss(s_pos, Site) AS (VALUES " + ", ".join(f"({i + 1}, '{v}')" for i, v in enumerate(SITES)) + "),\n"
          + _offered_params_sql() + "\nSELECT Site, Parameter, s_pos, p_pos FROM ss, pp")
def q_requested_pairs(spark, sf_dir):
    # The selected sites with every parameter offered for them.
    res, _ = store_tables(spark, sf_dir)
    return CV.offered_pairs(D.available_params(res, SITES), SITES)


@register("a3_observed_pairs", O.with_clean()
          + "\nSELECT DISTINCT SamplingPoint AS Site, WebParameter AS Parameter FROM clean")
def q_observed_pairs(spark, sf_dir):
    return CV.observed_pairs(clean_all(spark, sf_dir))


@register("a4_missing_pairs", _WITH_SEL_CLEAN + ",\n" + _req_sql() + """
SELECT * FROM req WHERE NOT EXISTS (SELECT 1 FROM clean c
  WHERE c.SamplingPoint = req.Site AND c.WebParameter = req.Parameter)""")
def q_missing_pairs(spark, sf_dir):
    return CV.missing_pairs(clean_selected(spark, sf_dir), SITES, PARAMS)


@register("a5_missing_sites", O.with_clean(where="r.WebParameter = 'Param AF'") + ",\n"
          + _values_sql("w", "SamplingPoint", SITES) + """
SELECT min(pos) AS pos, SamplingPoint FROM w WHERE SamplingPoint NOT IN
  (SELECT SamplingPoint FROM clean WHERE SamplingPoint IS NOT NULL) GROUP BY SamplingPoint""")
def q_missing_sites(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    df = clean(select_results(res, st, SITES, "Param AF"))
    return CV.missing_values(df, "SamplingPoint", SITES)


@register("a5_missing_params", O.with_clean(where="r.SamplingPoint = 'ST00001'") + ",\n"
          + _values_sql("w", "WebParameter", PARAMS) + """
SELECT min(pos) AS pos, WebParameter FROM w WHERE WebParameter NOT IN
  (SELECT WebParameter FROM clean WHERE WebParameter IS NOT NULL) GROUP BY WebParameter""")
def q_missing_params(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    df = clean(select_results(res, st, "ST00001", PARAMS))
    return CV.missing_values(df, "WebParameter", PARAMS)


def _msg_sql(where: str) -> str:
    return (O.with_clean(where=where) + ",\n" + _req_sql() + """,
miss AS (SELECT * FROM req WHERE NOT EXISTS (SELECT 1 FROM clean c
  WHERE c.SamplingPoint = req.Site AND c.WebParameter = req.Parameter))""" + f"""
SELECT CASE WHEN (SELECT count(*) FROM clean) = 0 THEN '{S.MSG_NO_DATA}'
            WHEN (SELECT count(*) FROM miss) > 0 THEN concat('{S.MSG_GAPS}',
                 (SELECT string_agg(concat(Site, ' (', Parameter, ')'), ', ' ORDER BY p_pos, s_pos) FROM miss), '.')
       END AS message""")


@register("a5b_missing_message", _msg_sql(O.selection_where()))
def q_missing_message(spark, sf_dir):
    return CV.missing_message(clean_selected(spark, sf_dir), SITES, PARAMS)


@register("a5b_missing_message_no_data", _msg_sql(
    f"r.SamplingPoint IN ({O.SITES_SQL}) AND r.WebParameter IN ({O.PARAMS_SQL}) AND r.SamplingPoint = 'ST99999'"))
def q_missing_message_no_data(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    df = clean(select_results(res, st, ["ST99999"], PARAMS))
    return CV.missing_message(df, SITES, PARAMS)


# ---------------------------------------------------------------------------
# Freshness
# ---------------------------------------------------------------------------


AS_OF = "2001-11-10 06:00:00"
STORE_CUT = "1999-06-30"


def typed_store(spark, sf_dir):
    """The stored results with typed sample dates."""
    res, _ = store_tables(spark, sf_dir)
    return res.withColumn("DateSampled", to_sample_date(F.col("DateSampled")))


_STORE_SQL = "store AS (SELECT * REPLACE (try_cast(DateSampled AS DATE) AS DateSampled) FROM r_t)"
_WITH_STORE = "WITH " + O.FIXTURE_CTE + ",\n" + _STORE_SQL
_AGE_SQL = (f"(epoch_us(TIMESTAMP '{AS_OF}') - date_diff('day', DATE '1970-01-01', max(DateSampled))"
            f" * 86400000000) / 86400000000.0")


@register("f1_date_coverage", _WITH_STORE + "\nSELECT min(DateSampled) AS min_date, max(DateSampled) AS max_date FROM store")
def q_date_coverage(spark, sf_dir):
    return FR.date_coverage(typed_store(spark, sf_dir))


@register("f2_staleness", _WITH_STORE + f"""
SELECT max(DateSampled) AS max_date, {_AGE_SQL} AS age_days, round({_AGE_SQL}, 1) AS age_days_1 FROM store""")
def q_staleness(spark, sf_dir):
    return FR.staleness(typed_store(spark, sf_dir), AS_OF)


@register("f3_is_fresh", _WITH_STORE + f"""
SELECT max(DateSampled) AS max_date, {_AGE_SQL} AS age_days, round({_AGE_SQL}, 1) AS age_days_1,
  coalesce({_AGE_SQL} < 10, false) AS fresh FROM store""")
def q_is_fresh(spark, sf_dir):
    return FR.is_fresh(typed_store(spark, sf_dir), AS_OF)


@register("f5_new_row_count", _WITH_STORE + f""",
old AS (SELECT * FROM store WHERE DateSampled <= DATE '{STORE_CUT}')
SELECT count(*) AS n_new, count(*) > 0 AS has_new FROM store
WHERE DateSampled > (SELECT max(DateSampled) FROM old)""")
def q_new_row_count(spark, sf_dir):
    full = typed_store(spark, sf_dir)
    # The store as it stood at the cut date; the source is the whole table.
    old = full.where(F.col("DateSampled") <= F.lit(STORE_CUT).cast("date"))
    return FR.new_row_count(full, old)


@register("f6_coverage_message_cached", _WITH_STORE + """
SELECT min(DateSampled) AS min_date, max(DateSampled) AS max_date,
  concat_ws(' ', 'Using cached database. Data available between', strftime(min(DateSampled), '%Y-%m-%d'),
            'and', strftime(max(DateSampled), '%Y-%m-%d')) AS message FROM store""")
def q_coverage_cached(spark, sf_dir):
    return FR.coverage_message(typed_store(spark, sf_dir), "cached")


@register("f6_coverage_message_reloaded", _WITH_STORE + """
SELECT min(DateSampled) AS min_date, max(DateSampled) AS max_date,
  concat_ws(' ', 'Using most recent version of the database:', '<br>Data available between ',
            strftime(min(DateSampled), '%m-%d-%Y'), ' and ', strftime(max(DateSampled), '%m-%d-%Y')) AS message
FROM store""")
def q_coverage_reloaded(spark, sf_dir):
    return FR.coverage_message(typed_store(spark, sf_dir), "reloaded")


# ---------------------------------------------------------------------------
# Trend lines (L1-L3)
# ---------------------------------------------------------------------------


def _round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("l1_linear_line", O.linear_line_sql(band=False))
def q_linear_line(spark, sf_dir):
    return _round_cols(L.linear_line(clean_all(spark, sf_dir)), ["x", "yhat", "lo", "hi"])


@register("l2_linear_band", O.linear_line_sql(band=True))
def q_linear_band(spark, sf_dir):
    return _round_cols(L.linear_line(clean_all(spark, sf_dir), band=True), ["x", "yhat", "lo", "hi"])


@register("l3_loess_line", O.loess_line_sql())
def q_loess_line(spark, sf_dir):
    return _round_cols(L.loess_line(clean_all(spark, sf_dir)), ["x", "yhat"])


# ---------------------------------------------------------------------------
# Statistics extras
# ---------------------------------------------------------------------------


@register("a6b_min_group", O.with_clean() + f""",
big AS (SELECT SamplingPoint, WebParameter FROM clean WHERE DL = 'Measured value'
  GROUP BY SamplingPoint, WebParameter HAVING count(*) >= 8)
SELECT {_CLEAN_COLS} FROM clean c WHERE DL = 'Measured value'
  AND EXISTS (SELECT 1 FROM big WHERE big.SamplingPoint = c.SamplingPoint AND big.WebParameter = c.WebParameter)""")
def q_min_group(spark, sf_dir):
    return trend.min_group(trend.model_rows(clean_all(spark, sf_dir)))


@register("a9_attach_stats", O.with_clean() + ",\n" + O.stats_cte() + f"""
SELECT {_CLEAN_COLS}, N, round(R_squared, 9) AS R_squared, round(p_value, 9) AS p_value
FROM clean c LEFT JOIN stats s ON c.SamplingPoint = s.Site AND c.WebParameter = s.Parameter""")
def q_attach_stats(spark, sf_dir):
    c = clean_all(spark, sf_dir)
    out = trend.attach_stats(c, trend.linear_stats(c))
    return out.withColumns({"R_squared": F.round("R_squared", 9), "p_value": F.round("p_value", 9)})


@register("a7b_stats_status", O.with_clean() + ",\n" + O.stats_cte() + f"""
SELECT count(*) AS n_groups, CASE WHEN count(*) = 0 THEN '{S.MSG_NO_GROUP}'
  ELSE '{S.MSG_LINEAR_NOTE}' END AS status FROM stats""")
def q_stats_status(spark, sf_dir):
    return trend.stats_status(trend.linear_stats(clean_all(spark, sf_dir)))


@register("a7b_stats_status_none", O.with_clean() + ",\n" + O.stats_cte().replace(
    "HAVING count(*) >= 8", "HAVING count(*) >= 1000000") + f"""
SELECT count(*) AS n_groups, CASE WHEN count(*) = 0 THEN '{S.MSG_NO_GROUP}'
  ELSE '{S.MSG_LINEAR_NOTE}' END AS status FROM stats""")
def q_stats_status_none(spark, sf_dir):
    # A minimum group size no series reaches: the warning text.
    return trend.stats_status(trend.linear_stats(clean_all(spark, sf_dir), min_n=1000000))


@register("a7b_loess_status", O.with_clean() + ",\n" + O.stats_cte() + f"""
SELECT count(*) AS n_groups, '{S.MSG_LOESS_NOTE}' AS status FROM stats""")
def q_loess_status(spark, sf_dir):
    return trend.stats_status(trend.linear_stats(clean_all(spark, sf_dir)), "loess")


_FMT = "CASE WHEN {x} IS NULL THEN 'NA' ELSE printf('%.{d}f', {x}) END"


@register("a8_trend_label", O.with_clean() + ",\n" + O.stats_cte() + """
SELECT Site, Parameter, N, round(R_squared, 9) AS R_squared, round(p_value, 9) AS p_value,
  concat('Trend line<br>Site: ', Site, '<br>Parameter: ', Parameter, '<br>N: ', CAST(N AS VARCHAR),
         '<br>R²: ', """ + _FMT.format(x="R_squared", d=3) + """,
         '<br>p-value: ', """ + _FMT.format(x="p_value", d=4) + """) AS tooltip FROM stats""")
def q_trend_label(spark, sf_dir):
    out = trend.trend_label(trend.linear_stats(clean_all(spark, sf_dir)))
    return out.withColumns({"R_squared": F.round("R_squared", 9), "p_value": F.round("p_value", 9)})


@register("a16_series_count", O.with_clean() + """
SELECT SiteParam, SamplingPoint, WebParameter, count(*) AS N,
  concat('LOESS trend<br>Site: ', SamplingPoint, '<br>Parameter: ', WebParameter, '<br>N: ',
         CAST(count(*) AS VARCHAR)) AS tooltip
FROM clean WHERE FinalResult IS NOT NULL GROUP BY SiteParam, SamplingPoint, WebParameter""")
def q_series_count(spark, sf_dir):
    return trend.loess_label(trend.series_count(clean_all(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Plot frames and display
# ---------------------------------------------------------------------------


def _num_sql(x: str) -> str:
    """Number text: the shorter of the general and the scientific form."""
    general = f"printf('%.15g', {x})"
    sci = f"regexp_replace(printf('%.14e', {x}), '\\.?0+e', 'e')"
    return f"coalesce(CASE WHEN length({general}) <= length({sci}) THEN {general} ELSE {sci} END, 'NA')"


_NUMTXT = _num_sql("FinalResult")
_ISO = "coalesce(strftime(DateSampled, '%Y-%m-%d'), 'NA')"
_ORDER_SQL = ", ".join(f"{c} NULLS FIRST" for c in FM.CLEAN_ORDER)


def _facet_sql(where: str = "") -> str:
    return (O.with_clean(where=where) + """
SELECT count(DISTINCT SamplingPoint) AS n_sites, count(DISTINCT WebParameter) AS n_params,
  CASE WHEN count(DISTINCT SamplingPoint) > 1 AND count(DISTINCT WebParameter) = 1 THEN 'Parameter'
       ELSE 'Site' END AS facet FROM clean""")


@register("a10_default_facet", _facet_sql())
def q_default_facet(spark, sf_dir):
    return FM.default_facet(clean_all(spark, sf_dir))


@register("a10_default_facet_one_param", _facet_sql(f"r.SamplingPoint IN ({O.SITES_SQL}) AND r.WebParameter = 'Param AF'"))
def q_default_facet_one_param(spark, sf_dir):
    res, st = store_tables(spark, sf_dir)
    return FM.default_facet(clean(select_results(res, st, SITES, "Param AF")))


@register("a11_facet_columns", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, WebParameter AS facet, SamplingPoint AS colour FROM clean""")
def q_facet_columns(spark, sf_dir):
    return FM.facet_columns(clean_all(spark, sf_dir), "Parameter")


@register("a11_colour_by_series", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, CAST(NULL AS VARCHAR) AS facet, SiteParam AS colour FROM clean""")
def q_colour_by_series(spark, sf_dir):
    return FM.facet_columns(clean_all(spark, sf_dir), None, "series")


for _prof, _cond in (("current", "RelativeDepthComments <> 'surface'"),
                     ("v2", "RelativeDepthComments <> 'N/A'"),
                     ("v1", "RelativeDepthComments IS NOT NULL")):
    def _mk_depth(profile):
        def q(spark, sf_dir):
            return FM.has_depth(clean_all(spark, sf_dir, profile), profile)
        return q
    register(f"a12_has_depth_{_prof}", O.with_clean(_prof)
             + f"\nSELECT coalesce(bool_or({_cond}), false) AS use_size FROM clean")(_mk_depth(_prof))


@register("a13_point_id", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, row_number() OVER (ORDER BY {_ORDER_SQL}) AS point_id FROM clean""")
def q_point_id(spark, sf_dir):
    return FM.point_id(clean_all(spark, sf_dir))


@register("a14_value_range", O.with_clean() + """
SELECT min(FinalResult) AS min_value, max(FinalResult) AS max_value,
  min(FinalResult) - (max(FinalResult) - min(FinalResult)) * 0.15 AS lo,
  max(FinalResult) + (max(FinalResult) - min(FinalResult)) * 0.15 AS hi FROM clean""")
def q_value_range(spark, sf_dir):
    return FM.value_range(clean_all(spark, sf_dir))


_DISPLAY_SQL = """SELECT SamplingPoint AS "Site", WebParameter AS "Parameter",
  strftime(DateSampled, '%Y-%m-%d') AS "Date", FinalResult AS "Result", DL AS "Detection Limit",
  Qualifiers AS "Qualifiers", RelativeDepthComments AS "Relative Depth" FROM clean"""


@register("t1_display_table", O.with_clean() + "\n" + _DISPLAY_SQL)
def q_display_table(spark, sf_dir):
    return FM.display_table(clean_all(spark, sf_dir))


@register("t2_page", O.with_clean() + ",\ndisp AS (" + _DISPLAY_SQL + """)
SELECT * FROM disp ORDER BY "Site" NULLS FIRST, "Parameter" NULLS FIRST, "Date" NULLS FIRST,
  "Result" NULLS FIRST, "Detection Limit" NULLS FIRST, "Qualifiers" NULLS FIRST,
  "Relative Depth" NULLS FIRST LIMIT 10 OFFSET 30""")
def q_page(spark, sf_dir):
    return FM.page(FM.display_table(clean_all(spark, sf_dir)), 3)


@register("t2_page_v1", O.with_clean("v1") + ",\ndisp AS (" + _DISPLAY_SQL + """)
SELECT * FROM disp ORDER BY "Site" NULLS FIRST, "Parameter" NULLS FIRST, "Date" NULLS FIRST,
  "Result" NULLS FIRST, "Detection Limit" NULLS FIRST, "Qualifiers" NULLS FIRST,
  "Relative Depth" NULLS FIRST LIMIT 15 OFFSET 0""")
def q_page_v1(spark, sf_dir):
    return FM.page(FM.display_table(clean_all(spark, sf_dir, "v1")), 0, S.PAGE_SIZE_V1)


@register("t2_page_last", O.with_clean() + ",\ndisp AS (" + _DISPLAY_SQL + f""")
SELECT * FROM disp ORDER BY ALL NULLS FIRST OFFSET (SELECT (count(*) - 1) // {S.PAGE_SIZE} * {S.PAGE_SIZE} FROM disp)""")
def q_page_last(spark, sf_dir):
    # The last page by the order index: only the last range is ordered.
    disp = FM.display_table(clean_all(spark, sf_dir))
    index = OR.build_index(disp, rows_per_range=2_000)
    return OR.page_at(disp, index, index.pages(S.PAGE_SIZE) - 1, S.PAGE_SIZE)


@register("t2_page_middle_hot", O.with_clean(hot=True) + ",\ndisp AS (" + _DISPLAY_SQL + f""")
SELECT * FROM disp ORDER BY ALL NULLS FIRST LIMIT {S.PAGE_SIZE} OFFSET (SELECT count(*) // {2 * S.PAGE_SIZE} * {S.PAGE_SIZE} FROM disp)""")
def q_page_middle_hot(spark, sf_dir):
    disp = FM.display_table(clean_hot(spark, sf_dir))
    index = OR.build_index(disp, rows_per_range=2_000)
    return OR.page_at(disp, index, index.rows // (2 * S.PAGE_SIZE), S.PAGE_SIZE)


def _label_sql(profile: str) -> str:
    nn = "coalesce({}, 'NA')"
    site, param = nn.format("SamplingPoint"), nn.format("WebParameter")
    q, z = nn.format("Qualifiers"), nn.format("RelativeDepthComments")
    if profile == "current":
        parts = ["'Site: '", site, "'<br>Parameter: '", param, "'<br>Date: '", _ISO, "'<br>Result: '",
                 _NUMTXT, "'<br>Qualifier: '", q, "'<br>Depth: '", z]
    elif profile == "v3_site":
        parts = ["'Site: '", site, "'<br>Date: '", _ISO, "'<br>Result: '", _NUMTXT, "'<br>Qualifier: '",
                 q, "'<br>Depth: '", z]
    elif profile == "v3_param":
        parts = ["'Parameter: '", param, "'<br>Date: '", _ISO, "'<br>Result: '", _NUMTXT, "'<br>Qualifier: '",
                 q, "'<br>Depth: '", z]
    else:
        d = _ISO if profile == "v2" else "coalesce(strftime(DateSampled, '%m-%d-%Y'), 'NA')"
        parts = ["'Date: '", d, "' <br>Result: '", _NUMTXT, "' <br>Qualifiers: '", q,
                 "' <br>Relative Depth: '", z]
    return f"concat({', '.join(parts)})"


for _prof, _clean_prof in (("current", "current"), ("v3_site", "current"), ("v3_param", "current"), ("v2", "v2"), ("v1", "v1")):
    def _mk_label(profile, cprof):
        def q(spark, sf_dir):
            return FM.point_label(clean_all(spark, sf_dir, cprof), profile)
        return q
    register(f"t3_point_label_{_prof}", O.with_clean(_clean_prof)
             + f"\nSELECT {_CLEAN_COLS}, {_label_sql(_prof)} AS label FROM clean")(_mk_label(_prof, _clean_prof))


def _case_sql(col: str, mapping: dict, cast: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CAST(CASE {whens} END AS {cast})"


@register("t4_shape_code", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, {_case_sql('legend_shape', S.SHAPES, 'INTEGER')} AS shape FROM clean""")
def q_shape_code(spark, sf_dir):
    return FM.shape_code(clean_all(spark, sf_dir))


@register("t4_shape_code_v1", O.with_clean("v1") + f"""
SELECT {_CLEAN_COLS}, {_case_sql('DL', S.SHAPES_V1, 'INTEGER')} AS shape FROM clean""")
def q_shape_code_v1(spark, sf_dir):
    return FM.shape_code(clean_all(spark, sf_dir, "v1"), "v1")


for _prof, _map in (("current", S.DEPTH_SIZES), ("v2", S.DEPTH_SIZES_V2), ("v1", S.DEPTH_SIZES_V1)):
    def _mk_size(profile):
        def q(spark, sf_dir):
            return FM.size_code(clean_all(spark, sf_dir, profile), profile)
        return q
    register(f"t5_size_code_{_prof}", O.with_clean(_prof) + f"""
SELECT {_CLEAN_COLS}, {_case_sql('RelativeDepthComments', _map, 'DOUBLE')} AS size FROM clean""")(_mk_size(_prof))


@register("t6_image_path", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, {_case_sql('legend_shape', S.IMAGES, 'VARCHAR')} AS point_image FROM clean""")
def q_image_path(spark, sf_dir):
    return FM.image_path(clean_all(spark, sf_dir))


@register("t7_points_frame", O.with_clean() + f"""
SELECT {_CLEAN_COLS}, SamplingPoint AS facet, WebParameter AS colour, SiteParam AS "group",
  {_case_sql('legend_shape', S.SHAPES, 'INTEGER')} AS shape,
  {_case_sql('RelativeDepthComments', S.DEPTH_SIZES, 'DOUBLE')} AS size,
  {_label_sql('current')} AS label,
  row_number() OVER (ORDER BY {_ORDER_SQL}) AS point_id FROM clean""")
def q_points_frame(spark, sf_dir):
    return FM.points_frame(clean_all(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scalar cleaning functions (C1-C15, C18, C19) as input -> output mappings
# over the whole results table, and key maintenance (K3-K5)
# ---------------------------------------------------------------------------


_WITH_FX = "WITH " + O.FIXTURE_CTE
_STRIP_SQL = "regexp_replace(WebResult, '[^0-9.<>=]', '', 'g')"
_NUM = O.NUM


def _parse_sql(txt: str, half: bool) -> str:
    body = f"regexp_replace({txt}, '^[<>]', '')"
    val = f"CASE WHEN regexp_matches({body}, {_NUM}) THEN try_cast({body} AS DOUBLE) END"
    return f"CASE WHEN starts_with({txt}, '<') THEN ({val}) / 2 ELSE ({val}) END" if half else val


def _raw_results(spark, sf_dir):
    return store_tables(spark, sf_dir)[0]


@register("c1_to_sample_date", _WITH_FX + """
SELECT DISTINCT DateSampled AS date_text,
  coalesce(try_cast(DateSampled AS DATE), try_strptime(DateSampled, '%Y/%m/%d')::DATE) AS sample_date FROM r_t""")
def q_to_sample_date(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        F.col("DateSampled").alias("date_text"), CF.to_sample_date("DateSampled").alias("sample_date")).distinct()


@register("c2_strip_result", _WITH_FX + f"\nSELECT DISTINCT WebResult, {_STRIP_SQL} AS stripped FROM r_t")
def q_strip_result(spark, sf_dir):
    return _raw_results(spark, sf_dir).select("WebResult", CF.strip_result("WebResult").alias("stripped")).distinct()


@register("c3_dl_class", _WITH_FX + f"""
SELECT DISTINCT WebResult, CASE WHEN starts_with({_STRIP_SQL}, '>') THEN '>DL'
  WHEN starts_with({_STRIP_SQL}, '<') THEN '<DL' ELSE 'Measured value' END AS DL FROM r_t""")
def q_dl_class(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        "WebResult", CF.dl_class(CF.strip_result("WebResult")).alias("DL")).distinct()


@register("c4_parse_result", _WITH_FX + f"\nSELECT DISTINCT WebResult, {_parse_sql(_STRIP_SQL, False)} AS value FROM r_t")
def q_parse_result(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        "WebResult", CF.parse_result(CF.strip_result("WebResult")).alias("value")).distinct()


@register("c5_parse_result_half", _WITH_FX + f"\nSELECT DISTINCT WebResult, {_parse_sql(_STRIP_SQL, True)} AS value FROM r_t")
def q_parse_result_half(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        "WebResult", CF.parse_result(CF.strip_result("WebResult"), "half").alias("value")).distinct()


_RAW_BODY = f"trim(regexp_replace(WebResult, '^[<>]', ''), {O.WS})"


@register("c6_parse_result_raw", _WITH_FX + f"""
SELECT DISTINCT WebResult, CASE WHEN starts_with(WebResult, '<')
  THEN (CASE WHEN regexp_matches({_RAW_BODY}, {O.SNUM}) THEN try_cast({_RAW_BODY} AS DOUBLE) END) / 2
  ELSE (CASE WHEN regexp_matches({_RAW_BODY}, {O.SNUM}) THEN try_cast({_RAW_BODY} AS DOUBLE) END) END AS value
FROM r_t""")
def q_parse_result_raw(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        "WebResult", CF.parse_result_raw("WebResult").alias("value")).distinct()


@register("c7_qualifier_or_none", _WITH_FX + """
SELECT DISTINCT Qualifier,
  CASE WHEN Qualifier IS NULL OR Qualifier = '' THEN 'None' ELSE Qualifier END AS Qualifiers,
  CASE WHEN Qualifier = '' THEN 'None' ELSE Qualifier END AS Qualifiers_v1 FROM r_t""")
def q_qualifier_or_none(spark, sf_dir):
    return _raw_results(spark, sf_dir).select(
        "Qualifier", CF.qualifier_or_none("Qualifier").alias("Qualifiers"),
        CF.qualifier_or_none("Qualifier", keep_null=True).alias("Qualifiers_v1")).distinct()


_DT = f"trim(RelativeDepthSample, {O.WS})"
_DEPTH_SQL = {
    "current": f"CASE WHEN {_DT} IS NULL OR {_DT} = '' THEN 'surface' ELSE lower({_DT}) END",
    "v2": f"CASE WHEN {_DT} IS NULL OR {_DT} = '' THEN 'N/A' ELSE upper({_DT}) END",
    "v1": f"CASE WHEN {_DT} IS NULL OR {_DT} = '' THEN NULL ELSE upper({_DT}) END",
}

for _id, _prof in (("c8", "current"), ("c9", "v2"), ("c10", "v1")):
    def _mk_dl(profile):
        def q(spark, sf_dir):
            return _raw_results(spark, sf_dir).select(
                "RelativeDepthSample", CF.depth_label("RelativeDepthSample", profile).alias("depth")).distinct()
        return q
    register(f"{_id}_depth_label_{_prof}", _WITH_FX + f"""
SELECT DISTINCT RelativeDepthSample, {_DEPTH_SQL[_prof]} AS depth FROM r_t""")(_mk_dl(_prof))


@register("c11_depth_category", _WITH_FX + f""",
d AS (SELECT DISTINCT RelativeDepthSample, {_DEPTH_SQL['current']} AS label FROM r_t)
SELECT RelativeDepthSample, CASE WHEN label IN ({O.LEVELS_SQL}) THEN label END AS depth,
  CAST(CASE WHEN list_position([{O.LEVELS_SQL}], label) > 0 THEN list_position([{O.LEVELS_SQL}], label) END
       AS INTEGER) AS depth_rank FROM d""")
def q_depth_category(spark, sf_dir):
    lab = CF.depth_label("RelativeDepthSample")
    return _raw_results(spark, sf_dir).select(
        "RelativeDepthSample", CF.depth_category(lab).alias("depth"), CF.depth_rank(lab).alias("depth_rank")).distinct()


@register("c12_factor_code", O.with_clean() + """,
ql AS (SELECT Qualifiers, CAST(dense_rank() OVER (ORDER BY Qualifiers) AS INTEGER) AS Qualifiers_code
  FROM (SELECT DISTINCT Qualifiers FROM clean WHERE Qualifiers IS NOT NULL)),
dl AS (SELECT DL, CAST(dense_rank() OVER (ORDER BY DL) AS INTEGER) AS DL_code
  FROM (SELECT DISTINCT DL FROM clean WHERE DL IS NOT NULL)),
coded AS (SELECT c.Qualifiers, ql.Qualifiers_code, c.DL, dl.DL_code FROM clean c
  LEFT JOIN ql ON c.Qualifiers = ql.Qualifiers LEFT JOIN dl ON c.DL = dl.DL)
SELECT Qualifiers, Qualifiers_code, DL, DL_code, count(*) AS n FROM coded
GROUP BY Qualifiers, Qualifiers_code, DL, DL_code""")
def q_factor_code(spark, sf_dir):
    coded = factor_code(factor_code(clean_all(spark, sf_dir), "Qualifiers"), "DL")
    return coded.groupBy("Qualifiers", "Qualifiers_code", "DL", "DL_code").agg(F.count(F.lit(1)).alias("n"))


@register("c13_legend_class", O.with_clean() + """
SELECT DISTINCT Qualifiers, DL, legend_shape FROM clean""")
def q_legend_class(spark, sf_dir):
    c = clean_all(spark, sf_dir)
    return c.select("Qualifiers", "DL", CF.legend_class("Qualifiers", "DL").alias("legend_shape")).distinct()


@register("c14_drop_unparsed", O.with_clean("v1") + """
SELECT DL, count(*) AS n FROM clean WHERE FinalResult IS NOT NULL GROUP BY DL""")
def q_drop_unparsed(spark, sf_dir):
    return drop_unparsed(clean_all(spark, sf_dir, "v1")).groupBy("DL").agg(F.count(F.lit(1)).alias("n"))


@register("c15_series_key", O.with_clean() + "\nSELECT DISTINCT SamplingPoint, WebParameter, SiteParam FROM clean")
def q_series_key(spark, sf_dir):
    c = clean_all(spark, sf_dir)
    return c.select("SamplingPoint", "WebParameter", CF.series_key().alias("SiteParam")).distinct()


@register("c18_date_text", O.with_clean() + """
SELECT DISTINCT DateSampled, strftime(DateSampled, '%Y-%m-%d') AS iso,
  strftime(DateSampled, '%m-%d-%Y') AS mdy FROM clean""")
def q_date_text(spark, sf_dir):
    c = clean_all(spark, sf_dir)
    return c.select("DateSampled", CF.date_text("DateSampled").alias("iso"),
                    CF.date_text("DateSampled", "MM-dd-yyyy").alias("mdy")).distinct()


@register("c19_fixed_decimals", O.with_clean() + ",\n" + O.stats_cte() + """
SELECT Site, Parameter, """ + _FMT.format(x="R_squared", d=3) + """ AS r2_text, """
          + _FMT.format(x="p_value", d=4) + """ AS p_text FROM stats""")
def q_fixed_decimals(spark, sf_dir):
    s = trend.linear_stats(clean_all(spark, sf_dir))
    return s.select("Site", "Parameter", CF.fixed_decimals("R_squared", 3).alias("r2_text"),
                    CF.fixed_decimals("p_value", 4).alias("p_text"))


@register("k3_trim_keys", "WITH " + O.FIXTURE_CTE + """
SELECT DISTINCT SamplingPoint AS raw_key, trim(SamplingPoint) AS SamplingPoint FROM results""")
def q_trim_keys(spark, sf_dir):
    res = fixtures.results(spark, sf_dir)
    return trim_keys(res.select(F.col("SamplingPoint").alias("raw_key"), "SamplingPoint"),
                     "SamplingPoint").distinct()


@register("k4_align_columns", "WITH " + O.FIXTURE_CTE + """
SELECT SamplingPoint, DateSampled, WebParameter, WebResult, Qualifier, RelativeDepthSample FROM r_t""")
def q_align_columns(spark, sf_dir):
    # A server-side extract names the key StationID; align it to the store's name.
    server = _raw_results(spark, sf_dir).withColumnRenamed("SamplingPoint", "StationID")
    return align_columns(server, S.SERVER_RENAMES).select(*S.RESULTS_SCHEMA.fieldNames())


@register("k5_date_text", O.with_clean() + """
SELECT DISTINCT SamplingPoint, strftime(DateSampled, '%Y-%m-%d') AS DateSampled FROM clean""")
def q_dates_as_text(spark, sf_dir):
    c = clean_all(spark, sf_dir).select("SamplingPoint", "DateSampled")
    return dates_as_text(c).distinct()


@register("l4_loess_band", O.loess_band_sql())
def q_loess_band(spark, sf_dir):
    return _round_cols(L.loess_line(clean_all(spark, sf_dir), band=True),
                       ["x", "yhat", "se", "lo", "hi", "df"])


# ---------------------------------------------------------------------------
# Sources (S1, S2, S4, S5)
# ---------------------------------------------------------------------------


WATERMARK = "1999-06-30"


@register("s1_read_table", "WITH " + O.FIXTURE_CTE + "\nSELECT * FROM r_t")
def q_read_table(spark, sf_dir):
    li = TB.read_table(spark, sf_dir, "lineitem.parquet")
    return trim_keys(fixtures.results_from(li), "SamplingPoint")


@register("s2_read_since", "WITH " + O.FIXTURE_CTE + f"\nSELECT * FROM r_t WHERE DateSampled > '{WATERMARK}'")
def q_read_since(spark, sf_dir):
    # The source keeps text dates: the bound is compared as ISO text.
    return TB.read_since(_raw_results(spark, sf_dir), WATERMARK)


@register("s2_read_since_lookback", "WITH " + O.FIXTURE_CTE + """
SELECT * FROM r_t WHERE DateSampled >= strftime(DATE '1999-06-30' - INTERVAL 7 DAY, '%Y-%m-%d')""")
def q_read_since_lookback(spark, sf_dir):
    return TB.read_since(_raw_results(spark, sf_dir), WATERMARK, lookback_days=7)


@register("s4_read_legacy_clean_v1", O.with_clean("v1") + f"\nSELECT {_CLEAN_COLS} FROM clean")
def q_read_legacy(spark, sf_dir):
    # A first-version extract names the result columns FinalResult,
    # Qualifiers and RelativeDepthComments; it is cleaned with the v1 rules.
    res, st = store_tables(spark, sf_dir)
    legacy = select_results(res, st).withColumnsRenamed({v: k for k, v in S.LEGACY_RENAMES.items()})
    return clean(legacy, "v1")


@register("s5_source_updated", "SELECT max(ts) AS Updated FROM events")
def q_source_updated(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events").select(F.col("ts").alias("Updated"))
    return TB.source_updated(ev)


# ---------------------------------------------------------------------------
# Skew: one series holds a third of all rows
# ---------------------------------------------------------------------------

def clean_hot(spark, sf_dir):
    st = trim_keys(fixtures.stations(spark, sf_dir), "StationID")
    res = fixtures.results_store(spark, sf_dir, hot=True)
    return clean(select_results(res, st))


@register("a7_stats_table_hot", O.with_clean(hot=True) + ",\n" + O.stats_cte() + """
SELECT Site, Parameter, N, round(R_squared, 4) AS R_squared, round(p_value, 4) AS p_value FROM stats""")
def q_stats_table_hot(spark, sf_dir):
    return trend.stats_table(trend.linear_stats(clean_hot(spark, sf_dir)))


@register("a6b_min_group_hot", O.with_clean(hot=True) + f""",
big AS (SELECT SamplingPoint, WebParameter FROM clean WHERE DL = 'Measured value'
  GROUP BY SamplingPoint, WebParameter HAVING count(*) >= 8)
SELECT {_CLEAN_COLS} FROM clean c WHERE DL = 'Measured value'
  AND EXISTS (SELECT 1 FROM big WHERE big.SamplingPoint = c.SamplingPoint AND big.WebParameter = c.WebParameter)""")
def q_min_group_hot(spark, sf_dir):
    return trend.min_group(trend.model_rows(clean_hot(spark, sf_dir)))


@register("a9_attach_stats_hot", O.with_clean(hot=True) + ",\n" + O.stats_cte() + f"""
SELECT {_CLEAN_COLS}, N, round(R_squared, 9) AS R_squared, round(p_value, 9) AS p_value
FROM clean c LEFT JOIN stats s ON c.SamplingPoint = s.Site AND c.WebParameter = s.Parameter""")
def q_attach_stats_hot(spark, sf_dir):
    c = clean_hot(spark, sf_dir)
    out = trend.attach_stats(c, trend.linear_stats(c))
    return out.withColumns({"R_squared": F.round("R_squared", 9), "p_value": F.round("p_value", 9)})


@register("l3_loess_line_hot", O.loess_line_sql(hot=True))
def q_loess_line_hot(spark, sf_dir):
    return _round_cols(L.loess_line(clean_hot(spark, sf_dir)), ["x", "yhat"])


# ---------------------------------------------------------------------------
# Streaming ingest (X1-X3): events arrive as files, one micro-batch each
# ---------------------------------------------------------------------------


_STORE_KEYS = ["SamplingPoint", "DateSampled", "WebParameter", "WebResult", "Qualifier",
               "RelativeDepthSample", "sample_year"]
_ALL_STATIONS_SQL = """SELECT printf('ST%05d', CAST(s_suppkey AS BIGINT)) AS StationID,
  concat('Reach ', CAST(s_nationkey AS VARCHAR)) AS Description FROM supplier"""
_EVENTS_SQL = """ev AS (SELECT printf('U%05d', CAST(user_id AS BIGINT)) AS SamplingPoint,
    try_cast(strftime(ts, '%Y-%m-%d') AS DATE) AS DateSampled, event_type AS WebParameter,
    CAST(value AS VARCHAR) AS WebResult, CAST(NULL AS VARCHAR) AS Qualifier,
    CAST(NULL AS VARCHAR) AS RelativeDepthSample FROM events)"""
_EVENT_SELECT = "SamplingPoint, DateSampled, WebParameter, WebResult, Qualifier, RelativeDepthSample, " \
                "CAST(year(DateSampled) AS INTEGER) AS sample_year"


def _stream_run(spark, sf_dir, repeat_share: bool, dedup, table: str = "results", dedup_days=None, merge: bool = False):
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    landing, store, ckpt = f"{base}/landing", f"{base}/store", f"{base}/checkpoint"
    ev = fixtures.event_results(spark, sf_dir)
    day = F.col("DateSampled")
    chunks = [ev.where(day <= "2024-01-10"), ev.where((day > "2024-01-10") & (day <= "2024-01-20")),
              ev.where(day > "2024-01-20")]
    if repeat_share:
        chunks.append(ev)          # everything delivered a second time
    for k, c in enumerate(chunks):
        c.write.mode("overwrite").parquet(f"{landing}/part{k}")
    q = stream_ingest(spark, landing + "/*", store, ckpt, dedup=dedup, dedup_days=dedup_days, max_files_per_trigger=1,
                      stations=lambda: fixtures.all_stations(spark, sf_dir))
    q.awaitTermination()
    if table == "stations":
        return spark.read.parquet(sinks.stations_path(store))
    if merge:
        store_loads.merge_loads(spark, store, "all")
    return TB.load_store(spark, store).select(*_STORE_KEYS)


@register("x1_stream_ingest", "WITH " + _EVENTS_SQL + f"\nSELECT {_EVENT_SELECT} FROM ev")
def q_stream_ingest(spark, sf_dir):
    # Three files arrive, each a micro-batch; the store then holds every row once.
    return _stream_run(spark, sf_dir, repeat_share=False, dedup=None)


@register("x1_stream_merged", SQL["x1_stream_ingest"])
def q_stream_merged(spark, sf_dir):
    # The micro-batches' folders merged into one load that replaces them.
    return _stream_run(spark, sf_dir, repeat_share=False, dedup=None, merge=True)


@register("x2_stream_dedup", "WITH " + _EVENTS_SQL + f"\nSELECT DISTINCT {_EVENT_SELECT} FROM ev")
def q_stream_dedup(spark, sf_dir):
    # The same rows arrive twice; exact de-duplication against the store.
    return _stream_run(spark, sf_dir, repeat_share=True, dedup="store")


@register("x2_stream_dedup_watermark", "WITH " + _EVENTS_SQL + f"""
SELECT DISTINCT {_EVENT_SELECT} FROM ev WHERE DateSampled > DATE '2024-01-02'""")
def q_stream_dedup_watermark(spark, sf_dir):
    # Four scheduled runs of one stream.  The last brings everything again:
    # rows within 15 days of the newest date are known repeats, older repeats
    # and the first two days (which come for the first time) are too late.
    base = _scratch(spark, "stream")
    store = f"{base}/store"
    ev = fixtures.event_results(spark, sf_dir)
    day = F.col("DateSampled")
    chunks = [ev.where(day.between("2024-01-03", "2024-01-10")), ev.where(day.between("2024-01-11", "2024-01-20")),
              ev.where(day > "2024-01-20"), ev]
    dropped = 0
    for k, c in enumerate(chunks):
        c.write.parquet(f"{base}/landing/part{k}")
        q = stream_ingest(spark, f"{base}/landing/*", store, f"{base}/checkpoint", dedup_days=15)
        q.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    if not dropped:
        raise RuntimeError("the watermark dropped no late row")
    return TB.load_store(spark, store).select(*_STORE_KEYS)


# ---------------------------------------------------------------------------
# Older line rules: grouped by site or by parameter, all points, no minimum
# beyond a fit (linear)
# ---------------------------------------------------------------------------


@register("l1_linear_line_by_site_all_points", O.linear_line_sql(
    band=True, keys="SamplingPoint", min_n=3, measured_only=False))
def q_linear_line_by_site(spark, sf_dir):
    out = L.linear_line(clean_all(spark, sf_dir), by="SamplingPoint", band=True,
                        min_n=3, measured_only=False)
    return _round_cols(out, ["x", "yhat", "lo", "hi"])


@register("l3_loess_line_by_site", O.loess_line_sql(keys="SamplingPoint"))
def q_loess_line_by_site(spark, sf_dir):
    return _round_cols(L.loess_line(clean_all(spark, sf_dir), by="SamplingPoint"), ["x", "yhat"])


@register("a14_value_range_no_pad", O.with_clean() + """
SELECT min(FinalResult) AS min_value, max(FinalResult) AS max_value,
  min(FinalResult) - (max(FinalResult) - min(FinalResult)) * 0.0 AS lo,
  max(FinalResult) + (max(FinalResult) - min(FinalResult)) * 0.0 AS hi FROM clean""")
def q_value_range_no_pad(spark, sf_dir):
    # The older tabs draw the plain range, without padding.
    return FM.value_range(clean_all(spark, sf_dir), pad=0.0)


# ---------------------------------------------------------------------------
# Sinks as round trips (K1, K2, K6): write, read back, compare
# ---------------------------------------------------------------------------


_DISPLAY_SCHEMA = T.StructType([
    T.StructField("Site", T.StringType()), T.StructField("Parameter", T.StringType()),
    T.StructField("Date", T.StringType()), T.StructField("Result", T.DoubleType()),
    T.StructField("Detection Limit", T.StringType()), T.StructField("Qualifiers", T.StringType()),
    T.StructField("Relative Depth", T.StringType())])


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@register("k6_export_csv", O.with_clean() + "\n" + _DISPLAY_SQL)
def q_export_csv(spark, sf_dir):
    # The whole display table written as CSV part files, read back as typed.
    path = _scratch(spark, "csv")
    sinks.export_csv(FM.display_table(clean_all(spark, sf_dir)), path)
    return spark.read.schema(_DISPLAY_SCHEMA).option("header", True).csv(path)


@register("k2_store_append", "WITH " + O.FIXTURE_CTE + """
SELECT SamplingPoint, try_cast(DateSampled AS DATE) AS DateSampled, WebParameter, WebResult, Qualifier,
  RelativeDepthSample, CAST(year(try_cast(DateSampled AS DATE)) AS INTEGER) AS sample_year FROM r_t""")
def q_store_append(spark, sf_dir):
    # A full load up to a cut date, then an increment appended above it.
    store = _scratch(spark, "store")
    rows = sinks.prepare_results(fixtures.results(spark, sf_dir))
    cut = F.lit(STORE_CUT).cast("date")
    sinks.write_results(rows.where(F.col("DateSampled") <= cut), store, "full")
    sinks.write_results(rows.where(F.col("DateSampled") > cut), store, "inc-1")
    return spark.read.parquet(sinks.results_path(store)).drop("ingest_batch")


@register("k1_overwrite_stations", _ALL_STATIONS_SQL)
def q_overwrite_stations(spark, sf_dir):
    # Written twice: the second write replaces the first.
    path = _scratch(spark, "stations")
    st = sinks.prepare_stations(fixtures.all_stations(spark, sf_dir))
    sinks.overwrite(st, path)
    sinks.overwrite(st, path)
    return spark.read.parquet(path)


@register("f4_refresh_cycle", "WITH " + O.FIXTURE_CTE + """
SELECT SamplingPoint, try_cast(DateSampled AS DATE) AS DateSampled, WebParameter, WebResult, Qualifier,
  RelativeDepthSample, CAST(year(try_cast(DateSampled AS DATE)) AS INTEGER) AS sample_year FROM r_t""")
def q_refresh_cycle(spark, sf_dir):
    # No store: full load of what the source had at the cut date.  Later the
    # store is stale: rows after the stored maximum are appended.  The store
    # is then read back (S3).
    return TB.load_store(spark, _refreshed(spark, sf_dir)).drop("ingest_batch")


def _refreshed(spark, sf_dir) -> str:
    store = _scratch(spark, "refresh")
    raw = fixtures.results(spark, sf_dir).withColumnRenamed("SamplingPoint", "StationID")
    stations = fixtures.stations(spark, sf_dir)
    early = raw.where(F.col("DateSampled") <= STORE_CUT)
    first = refresh(spark, lambda: (early, stations), store, f"{STORE_CUT} 12:00:00")
    second = refresh(spark, lambda: (raw, stations), store, "2002-01-01 00:00:00")
    if (first.action, second.action) != ("full_load", "appended"):
        raise RuntimeError(f"unexpected refresh actions: {first.action}, {second.action}")
    return store


@register("x3_stream_stations", _ALL_STATIONS_SQL)
def q_stream_stations(spark, sf_dir):
    # The station table the stream refreshed after its micro-batches.
    return _stream_run(spark, sf_dir, repeat_share=False, dedup=None, table="stations")


@register("s8_read_with_fallback", _ALL_STATIONS_SQL)
def q_read_with_fallback(spark, sf_dir):
    # The primary source is unreadable (no such table): the fallback is used.
    missing = _scratch(spark, "missing-source")
    df, which = TB.read_with_fallback(lambda: spark.read.parquet(missing),
                                      lambda: sinks.prepare_stations(fixtures.all_stations(spark, sf_dir)))
    if which != "fallback":
        raise RuntimeError("the primary source was expected to fail")
    return df


@register("l1_linear_line_by_param_all_points", O.linear_line_sql(
    band=True, keys="WebParameter", min_n=3, measured_only=False))
def q_linear_line_by_param(spark, sf_dir):
    out = L.linear_line(clean_all(spark, sf_dir), by="WebParameter", band=True,
                        min_n=3, measured_only=False)
    return _round_cols(out, ["x", "yhat", "lo", "hi"])


@register("l3_loess_line_by_param", O.loess_line_sql(keys="WebParameter"))
def q_loess_line_by_param(spark, sf_dir):
    return _round_cols(L.loess_line(clean_all(spark, sf_dir), by="WebParameter"), ["x", "yhat"])


@register("l4_loess_band_hot", O.loess_band_sql(hot=True))
def q_loess_band_hot(spark, sf_dir):
    return _round_cols(L.loess_line(clean_hot(spark, sf_dir), band=True),
                       ["x", "yhat", "se", "lo", "hi", "df"])


@register("a13_point_id_hot", O.with_clean(hot=True) + f"""
SELECT {_CLEAN_COLS}, row_number() OVER (ORDER BY {_ORDER_SQL}) AS point_id FROM clean""")
def q_point_id_hot(spark, sf_dir):
    return FM.point_id(clean_hot(spark, sf_dir))


# ---------------------------------------------------------------------------
# Further readers and sinks: legacy extract, station CSV, append
# ---------------------------------------------------------------------------


@register("s4_read_legacy", "WITH " + O.FIXTURE_CTE + "\nSELECT * FROM r_t")
def q_read_legacy_source(spark, sf_dir):
    # An extract under the first version's column names.
    path = _scratch(spark, "legacy")
    res, _ = store_tables(spark, sf_dir)
    res.withColumnsRenamed({v: k for k, v in S.LEGACY_RENAMES.items()}).write.parquet(path)
    return TB.read_legacy(spark, path)


@register("s6_read_station_csv", """SELECT '0042' AS Org_Identifier,
  printf('ST%05d', CAST(s_suppkey AS BIGINT)) AS Location_Identifier,
  concat('Reach "', CAST(s_nationkey AS VARCHAR), '", bank ', CAST(s_suppkey AS VARCHAR)) AS Location_Name,
  printf('%03d', CAST(s_nationkey AS BIGINT)) AS Location_CountyCode,
  40 + CAST(s_suppkey AS DOUBLE) / 64 AS Location_Latitude,
  CASE WHEN s_nationkey % 2 = 0 THEN -70 - CAST(s_suppkey AS DOUBLE) / 64 END AS Location_Longitude,
  CAST(NULL AS VARCHAR) AS AlternateLocation_IdentifierContextC FROM supplier""")
def q_read_station_csv(spark, sf_dir):
    path = _scratch(spark, "station-csv")
    sinks.export_csv(fixtures.station_metadata(spark, sf_dir), path)
    return TB.read_station_csv(spark, path).select(
        "Org_Identifier", "Location_Identifier", "Location_Name", "Location_CountyCode", "Location_Latitude",
        "Location_Longitude", "AlternateLocation_IdentifierContextC")


@register("k2_append", "WITH " + O.FIXTURE_CTE + """
SELECT SamplingPoint, DateSampled, WebParameter, WebResult,
  CASE WHEN DateSampled <= '""" + STORE_CUT + """' THEN Qualifier END AS Qualifier, RelativeDepthSample FROM r_t""")
def q_append(spark, sf_dir):
    # The later rows come without the qualifier and in another column order.
    path = _scratch(spark, "append")
    res, _ = store_tables(spark, sf_dir)
    res.where(F.col("DateSampled") <= STORE_CUT).write.parquet(path)
    sinks.append(res.where(~(F.col("DateSampled") <= STORE_CUT)).drop("Qualifier").select(
        "WebResult", "DateSampled", "SamplingPoint", "WebParameter", "RelativeDepthSample"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# Number text over many magnitudes; colour choices without facets
# ---------------------------------------------------------------------------

_SCALES = [1e-7, 1e-5, 1e-4, 1e-3, 0.1, 1.0, 1000.0, 1e5, 1e9]


@register("t3_number_text", O.with_clean() + f""",
sc AS (SELECT FinalResult * f AS v FROM clean, (SELECT unnest({_SCALES!r}) AS f))
SELECT {_num_sql('v')} AS txt, count(*) AS n FROM sc GROUP BY ALL""")
def q_number_text(spark, sf_dir):
    scale = F.explode(F.array(*[F.lit(f) for f in _SCALES]))
    df = clean_all(spark, sf_dir).select("FinalResult", scale.alias("f"))
    return df.groupBy(CF.number_text(F.col("FinalResult") * F.col("f")).alias("txt")).agg(F.count("*").alias("n"))


for _by, _col in (("site", "SamplingPoint"), ("parameter", "WebParameter"), ("qualifier", "Qualifiers")):
    def _mk_colour(by):
        def q(spark, sf_dir):
            return FM.facet_columns(clean_all(spark, sf_dir), None, by)
        return q
    register(f"a11_colour_by_{_by}", O.with_clean()
             + f"\nSELECT {_CLEAN_COLS}, CAST(NULL AS VARCHAR) AS facet, {_col} AS colour FROM clean")(_mk_colour(_by))


# ---------------------------------------------------------------------------
# The display action's outputs on the date-filtered frame
# ---------------------------------------------------------------------------

_DATED = ",\ndated AS (SELECT * FROM clean WHERE DateSampled BETWEEN DATE '{}' AND DATE '{}')".format(_DATE_LO, _DATE_HI)


def _dated(spark, sf_dir):
    return filter_dates(clean_all(spark, sf_dir), _DATE_LO, _DATE_HI)


@register("a7_stats_table_dated", O.with_clean() + _DATED + ",\n" + O.stats_cte("dated") + """
SELECT Site, Parameter, N, round(R_squared, 4) AS R_squared, round(p_value, 4) AS p_value FROM stats""")
def q_stats_table_dated(spark, sf_dir):
    return trend.stats_table(trend.linear_stats(_dated(spark, sf_dir)))


@register("l3_loess_line_dated", O.with_clean() + _DATED + ",\n" + O.loess_cte("dated") + """
SELECT SiteParam, CAST(i AS INTEGER) AS i, round(g, 6) AS x, round(yhat, 6) AS yhat FROM lfit""")
def q_loess_line_dated(spark, sf_dir):
    return _round_cols(L.loess_line(_dated(spark, sf_dir)), ["x", "yhat"])


@register("t1_display_table_dated", O.with_clean() + _DATED + "\n" + _DISPLAY_SQL.replace("FROM clean", "FROM dated"))
def q_display_table_dated(spark, sf_dir):
    return FM.display_table(_dated(spark, sf_dir))


# ---------------------------------------------------------------------------
# Interpolated LOESS
# ---------------------------------------------------------------------------

_BAND_COLUMNS = ["x", "yhat", "se", "lo", "hi", "df"]


@register("l3_loess_surface", O.loess_surface_sql())
def q_loess_surface(spark, sf_dir):
    return _round_cols(L.loess_surface(clean_all(spark, sf_dir)), ["x", "yhat"])


@register("l3_loess_surface_hot", O.loess_surface_sql(hot=True))
def q_loess_surface_hot(spark, sf_dir):
    return _round_cols(L.loess_surface(clean_hot(spark, sf_dir)), ["x", "yhat"])


@register("l3_loess_surface_by_param", O.loess_surface_sql(keys="WebParameter"))
def q_loess_surface_by_param(spark, sf_dir):
    return _round_cols(L.loess_surface(clean_all(spark, sf_dir), by="WebParameter"), ["x", "yhat"])


@register("l4_loess_surface_band", O.loess_surface_band_sql())
def q_loess_surface_band(spark, sf_dir):
    return _round_cols(L.loess_surface(clean_all(spark, sf_dir), band=True), _BAND_COLUMNS)


@register("l4_loess_surface_band_hot", O.loess_surface_band_sql(hot=True))
def q_loess_surface_band_hot(spark, sf_dir):
    return _round_cols(L.loess_surface(clean_hot(spark, sf_dir), band=True), _BAND_COLUMNS)


# ---------------------------------------------------------------------------
# Answers from what the store keeps beside its loads (after a full load and
# an increment): no results are read
# ---------------------------------------------------------------------------


@register("a7_stats_table_moments", SQL["a7_stats_table"])
def q_stats_table_moments(spark, sf_dir):
    kept = store_loads.moments(spark, _refreshed(spark, sf_dir))
    return trend.stats_table(trend.stats_from_moments(kept, min_n=S.MIN_MODEL_N))


@register("l2_linear_band_moments", SQL["l2_linear_band"])
def q_linear_band_moments(spark, sf_dir):
    kept = store_loads.moments(spark, _refreshed(spark, sf_dir)).withColumn("SiteParam", CF.series_key())
    line = L.line_from_moments(kept.where(F.col("N") >= S.MIN_MODEL_N), band=True)
    return _round_cols(line, ["x", "yhat", "lo", "hi"])


@register("f1_date_coverage_zones", SQL["f1_date_coverage"])
def q_date_coverage_zones(spark, sf_dir):
    return FR.date_coverage(store_loads.zones(spark, _refreshed(spark, sf_dir)), "min_date", "max_date")


@register("f3_is_fresh_zones", SQL["f3_is_fresh"])
def q_is_fresh_zones(spark, sf_dir):
    return FR.is_fresh(store_loads.zones(spark, _refreshed(spark, sf_dir)), AS_OF, col="max_date")


@register("f6_coverage_message_zones", SQL["f6_coverage_message_reloaded"])
def q_coverage_zones(spark, sf_dir):
    return FR.coverage_message(store_loads.zones(spark, _refreshed(spark, sf_dir)), "reloaded", "min_date", "max_date")


@register("q9_filter_dates_store", SQL["q9_filter_dates"])
def q_filter_dates_store(spark, sf_dir):
    # The range is read from the refreshed store: only the folders of its years.
    res = TB.load_store(spark, _refreshed(spark, sf_dir))
    return clean(select_results(res, store_tables(spark, sf_dir)[1], dates=(_DATE_LO, _DATE_HI)))


@register("q2_select_results_dated_store", O.with_clean(where=O.selection_where()) + f"""
SELECT {_CLEAN_COLS} FROM clean WHERE DateSampled BETWEEN DATE '{_DATE_LO}' AND DATE '{_DATE_HI}'""")
def q_select_dated_store(spark, sf_dir):
    # Sites, parameters and dates together, all on the scan of the store.
    res = TB.load_store(spark, _refreshed(spark, sf_dir))
    return clean(select_results(res, store_tables(spark, sf_dir)[1], SITES, PARAMS, dates=(_DATE_LO, _DATE_HI)))


@register("s2_read_since_store", "WITH " + O.FIXTURE_CTE + f"""
SELECT trim(SamplingPoint) AS SamplingPoint, try_cast(DateSampled AS DATE) AS DateSampled, WebParameter, WebResult, Qualifier,
  RelativeDepthSample, CAST(year(try_cast(DateSampled AS DATE)) AS INTEGER) AS sample_year FROM r_t
WHERE try_cast(DateSampled AS DATE) > DATE '{WATERMARK}'""")
def q_read_since_store(spark, sf_dir):
    res = TB.load_store(spark, _refreshed(spark, sf_dir))
    return TB.read_since(res, WATERMARK).select("SamplingPoint", "DateSampled", "WebParameter", "WebResult", "Qualifier",
                                                "RelativeDepthSample", "sample_year")


# ---------------------------------------------------------------------------
# Search index, locale order and the column-wide date form
# ---------------------------------------------------------------------------


@register("d9_search_sites_index", SQL["d9_search_sites"])
def q_search_sites_index(spark, sf_dir):
    path = _scratch(spark, "search-sites")
    SE.build_search_index(directory_of(spark, sf_dir), "SamplingPoint", path)
    return SE.search(spark, path, "ST0001", "SamplingPoint")


@register("d9_search_params_index", SQL["d9_search_params"])
def q_search_params_index(spark, sf_dir):
    res, _ = store_tables(spark, sf_dir)
    path = _scratch(spark, "search-params")
    SE.build_search_index(res, "WebParameter", path)
    return SE.search(spark, path, "F", "WebParameter")


def _mixed_case(df: DataFrame) -> DataFrame:
    """Priority and status of the orders in three ways of writing."""
    name = F.concat(F.initcap("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"))
    return df.select(F.explode(F.array(name, F.lower(name), F.upper(name))).alias("name"))


# Letters compare before case, and lower case comes first.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@register("c12_factor_code_locale", f"""WITH o AS (SELECT concat(array_to_string(list_transform(string_split(lower(o_orderpriority), ' '),
    lambda w: upper(w[1]) || w[2:]), ' '), ' ', o_orderstatus) AS n FROM orders),
names AS (SELECT DISTINCT unnest([n, lower(n), upper(n)]) AS name FROM o)
SELECT name, CAST(row_number() OVER (ORDER BY lower(name),
  translate(name, '{_UPPER + _LOWER}', '{_LOWER + _UPPER}')) AS INTEGER) AS code FROM names""")
def q_factor_code_locale(spark, sf_dir):
    names = _mixed_case(fixtures.table(spark, sf_dir, "orders"))
    return factor_code(names, "name", "code", locale="UNICODE").distinct()


@register("c1_column_dates", """WITH t AS (SELECT l_orderkey * 8 + l_linenumber AS pos,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS txt
  FROM lineitem), f AS (SELECT arg_min(txt, pos) AS v FROM t WHERE txt IS NOT NULL)
SELECT pos, CASE WHEN contains(v, '/') THEN CAST(try_strptime(txt, '%Y/%m/%d') AS DATE) ELSE try_cast(CASE WHEN contains(txt, '-') THEN txt END AS DATE) END AS d
FROM t, f""")
def q_column_dates(spark, sf_dir):
    day = lambda form: F.date_format("l_shipdate", form)
    text = (F.when(F.col("l_orderkey") % 5 == 0, None).when(F.col("l_partkey") % 2 == 0, day("yyyy/MM/dd")).otherwise(day("yyyy-MM-dd")))
    rows = fixtures.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), text.alias("d"))
    return CF.column_dates(rows, "d", "pos")
