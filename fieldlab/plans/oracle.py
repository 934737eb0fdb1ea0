"""DuckDB twins of the registered queries (the correctness oracle).

Each builder returns ANSI SQL that DuckDB runs over the driver's tables
(registered as views).  The text mirrors the Spark plan's semantics, not its
code: the same adapter, cleaning rules and formulas written in SQL.
"""

from __future__ import annotations

from fieldlab import schema as S
from fieldlab.fixtures import PARAMS, SITES

# Adapter (FIXTURES.md section 3), DuckDB dialect.
FIXTURE_CTE = """
results AS (SELECT
  CASE WHEN l_linenumber % 2 = 0
       THEN concat(' ', printf('ST%05d', cast(l_suppkey as bigint)), ' ')
       ELSE printf('ST%05d', cast(l_suppkey as bigint)) END           AS SamplingPoint,
  strftime(l_shipdate,'%Y-%m-%d')                                           AS DateSampled,
  concat('Param ', l_returnflag, l_linestatus)                              AS WebParameter,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL
       WHEN l_orderkey % 19 = 0 THEN 'ND'
       WHEN l_orderkey % 17 = 0 THEN concat('<=', cast(cast(l_quantity as int) as varchar))
       WHEN l_orderkey % 13 = 0 THEN concat('>',  cast(cast(l_quantity as int) as varchar))
       WHEN l_orderkey % 11 = 0 THEN concat('< ', cast(cast(l_quantity as int) as varchar), '.5 mg/L')
       WHEN l_orderkey %  7 = 0 THEN concat('-',  cast(cast(l_quantity as int) as varchar), '.25')
       ELSE concat(' ', cast(cast(l_quantity as int) as varchar), '.', cast(l_partkey % 10 as varchar)) END AS WebResult,
  CASE l_partkey % 5 WHEN 0 THEN 'J' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE NULL END    AS Qualifier,
  CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN ' Epilimnion ' WHEN 4 THEN 'THERMOCLINE'
       WHEN 5 THEN 'Mid-Depth' WHEN 6 THEN 'hypolimnion' ELSE 'benthic' END AS RelativeDepthSample
  FROM lineitem),
stations AS (SELECT concat(printf('ST%05d', cast(s_suppkey as bigint)), ' ')   AS StationID,
                    concat('Reach ', cast(s_nationkey as varchar))              AS Description
  FROM supplier WHERE s_suppkey % 10 <> 3),
r_t AS (SELECT trim(SamplingPoint) AS SamplingPoint, DateSampled, WebParameter, WebResult,
               Qualifier, RelativeDepthSample FROM results),
s_t AS (SELECT trim(StationID) AS StationID, Description FROM stations)"""


# Skewed variant: every third line item is moved to one series.
FIXTURE_CTE_HOT = FIXTURE_CTE.replace(
    "  FROM lineitem),",
    "  FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey,\n"
    "        CASE WHEN l_orderkey % 3 = 0 THEN 'A' ELSE l_returnflag END AS l_returnflag,\n"
    "        CASE WHEN l_orderkey % 3 = 0 THEN 'F' ELSE l_linestatus END AS l_linestatus) FROM lineitem)),", 1)
assert FIXTURE_CTE_HOT != FIXTURE_CTE


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


SITES_SQL = sql_list(SITES)
PARAMS_SQL = sql_list(PARAMS)
LEVELS_SQL = sql_list(S.DEPTH_LEVELS)
WS = "' \t\r\n'"
NUM = "'^([0-9]+[.]?[0-9]*|[.][0-9]+)$'"
SNUM = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def raw_cte(where: str = "") -> str:
    """Retrieval: trimmed results left-joined to trimmed stations."""
    w = f" WHERE {where}" if where else ""
    return f"""raw AS (SELECT r.SamplingPoint, r.DateSampled, r.WebResult, r.Qualifier,
      r.RelativeDepthSample, r.WebParameter, s.Description
  FROM r_t r LEFT JOIN s_t s ON r.SamplingPoint = s.StationID{w})"""


def clean_cte(profile: str = "current", src: str = "raw", name: str = "clean") -> str:
    if profile in ("current", "v2"):
        txt = "regexp_replace(WebResult, '[^0-9.<>=]', '', 'g')"
        body = "regexp_replace(txt, '^[<>]', '')"
        val = f"CASE WHEN regexp_matches({body}, {NUM}) THEN try_cast({body} AS DOUBLE) END"
        dl_src = "txt"
    else:
        txt = "WebResult"
        body = f"trim(regexp_replace(txt, '^[<>]', ''), {WS})"
        val = f"CASE WHEN regexp_matches({body}, {SNUM}) THEN try_cast({body} AS DOUBLE) END"
        dl_src = "txt"
    if profile != "current":
        val = f"CASE WHEN starts_with(txt, '<') THEN ({val}) / 2 ELSE ({val}) END"
    dtrim = f"trim(RelativeDepthSample, {WS})"
    if profile == "current":
        depth = (f"CASE WHEN {dtrim} IS NULL OR {dtrim} = '' THEN 'surface' ELSE lower({dtrim}) END")
        depth = f"CASE WHEN ({depth}) IN ({LEVELS_SQL}) THEN ({depth}) END"
        qual = "CASE WHEN Qualifier IS NULL OR Qualifier = '' THEN 'None' ELSE Qualifier END"
    elif profile == "v2":
        depth = f"CASE WHEN {dtrim} IS NULL OR {dtrim} = '' THEN 'N/A' ELSE upper({dtrim}) END"
        qual = "CASE WHEN Qualifier IS NULL OR Qualifier = '' THEN 'None' ELSE Qualifier END"
    else:
        depth = f"CASE WHEN {dtrim} IS NULL OR {dtrim} = '' THEN NULL ELSE upper({dtrim}) END"
        qual = "CASE WHEN Qualifier = '' THEN 'None' ELSE Qualifier END"
    drop = "" if profile == "v1" else " WHERE FinalResult IS NOT NULL"
    return f"""{name}_s AS (SELECT *, {txt} AS txt FROM {src}),
{name}_v AS (SELECT SamplingPoint,
    {depth} AS RelativeDepthComments,
    coalesce(try_cast(DateSampled AS DATE), try_strptime(DateSampled, '%Y/%m/%d')::DATE) AS DateSampled,
    WebParameter,
    {val} AS FinalResult,
    {qual} AS Qualifiers,
    Description,
    CASE WHEN starts_with({dl_src}, '>') THEN '>DL' WHEN starts_with({dl_src}, '<') THEN '<DL'
         ELSE 'Measured value' END AS DL
  FROM {name}_s),
{name} AS (SELECT *,
    CASE WHEN Qualifiers <> 'None' THEN 'Qualifier' ELSE DL END AS legend_shape,
    concat_ws(' - ', coalesce(SamplingPoint, 'NA'), coalesce(WebParameter, 'NA')) AS SiteParam
  FROM {name}_v{drop})"""


def with_clean(profile: str = "current", where: str = "", hot: bool = False) -> str:
    fx = FIXTURE_CTE_HOT if hot else FIXTURE_CTE
    return "WITH " + fx + ",\n" + raw_cte(where) + ",\n" + clean_cte(profile)


def selection_where() -> str:
    return f"r.SamplingPoint IN ({SITES_SQL}) AND r.WebParameter IN ({PARAMS_SQL})"


# ---------------------------------------------------------------------------
# Statistics
# ---------------------------------------------------------------------------

def p_value_sql(r2: str, n: str) -> str:
    """Slope p-value from r2 and the fitted-row count (closed-form products)."""
    nu = f"(({n}) - 2)"
    r2c = f"least(greatest({r2}, 0.0), 1.0)"
    c2 = f"(1.0 - {r2c})"
    s = f"sqrt({r2c})"
    odd = f"({nu} % 2 = 1)"
    full = f"(CASE WHEN {odd} THEN ({nu} - 3) // 2 ELSE {nu} // 2 - 1 END)"
    cut = (f"(CASE WHEN {c2} <= 0 THEN 0 WHEN -ln({c2}) <= 1e-12 THEN {full} "
           f"ELSE ceil(40.0 / -ln({c2})) END)")
    k = f"greatest(least({full}, {cut}), 0)::BIGINT"
    even_sum = (f"coalesce(list_sum(list_transform(range(1, {k} + 1), "
                f"lambda j: pow({c2}, j) * exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()))), 0.0)")
    odd_sum = (f"coalesce(list_sum(list_transform(range(1, {k} + 1), "
               f"lambda j: pow({c2}, j) * sqrt(pi()) / 2.0 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)))), 0.0)")
    a_even = f"({s} * (1.0 + {even_sum}))"
    a_odd = (f"(CASE WHEN {nu} = 1 THEN 2.0 / pi() * asin({s}) "
             f"ELSE 2.0 / pi() * (asin({s}) + {s} * sqrt({c2}) * (1.0 + {odd_sum})) END)")
    series = f"(1.0 - CASE WHEN {odd} THEN {a_odd} ELSE {a_even} END)"
    return f"(CASE WHEN {nu} >= 1 AND {r2} IS NOT NULL AND NOT isnan({r2}) THEN greatest({series}, 0.0) END)"


XDAYS = "CAST(date_diff('day', DATE '1970-01-01', DateSampled) AS DOUBLE)"


def moments_cte(src: str = "clean", name: str = "mom", min_n: int = S.MIN_MODEL_N,
                measured_only: bool = True, keys=("SamplingPoint", "WebParameter")) -> str:
    where = " WHERE DL = 'Measured value'" if measured_only else ""
    k = ", ".join(keys)
    return f"""{name} AS (SELECT {k}, count(*) AS N,
    regr_count(FinalResult, {XDAYS}) AS n_fit,
    regr_r2(FinalResult, {XDAYS}) AS r2_raw,
    regr_sxx(FinalResult, {XDAYS}) AS sxx,
    regr_syy(FinalResult, {XDAYS}) AS syy,
    regr_sxy(FinalResult, {XDAYS}) AS sxy,
    regr_avgx(FinalResult, {XDAYS}) AS xbar,
    regr_avgy(FinalResult, {XDAYS}) AS ybar,
    min({XDAYS}) AS xmin, max({XDAYS}) AS xmax
  FROM {src}{where} GROUP BY {k} HAVING count(*) >= {min_n})"""


def stats_cte(src: str = "clean", name: str = "stats") -> str:
    r2 = "CASE WHEN sxx > 0 AND syy > 0 THEN r2_raw END"
    return (moments_cte(src) + f""",
{name}_r AS (SELECT SamplingPoint, WebParameter, N, n_fit, {r2} AS R_squared FROM mom),
{name} AS (SELECT SamplingPoint AS Site, WebParameter AS Parameter, N, R_squared,
    {p_value_sql('R_squared', 'n_fit')} AS p_value FROM {name}_r)""")


def quantile_cte(src: str, level: float = 0.95) -> str:
    """CTE ``qtab(qdf, qtq)``: t quantiles of the distinct ``df`` of ``src``,
    by bisection.  From two degrees of freedom on, P(|T| <= t) is summed as a
    power series in y = t^2 / (df + t^2); below, P(|T| > t) as one in 1 - y."""
    inner = ("2.0 * c * exp(0.5 * ln({y}) + df / 2.0 * ln(1.0 - {y})) * list_sum(list_transform(range(0, 400), "
             "lambda j: exp(lgamma(df / 2.0 + 0.5 + j) - lgamma(df / 2.0 + 0.5) + lgamma(1.5) - lgamma(j + 1.5) "
             "+ j * ln({y}))))").format(y="mid")
    outer = ("c * list_sum(list_transform(range(0, 60), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) "
             "+ (j + df / 2.0) * mid) / sqrt(pi()) / (df / 2.0 + j)))")
    return f"""qd AS (SELECT DISTINCT CAST(df AS DOUBLE) AS df FROM {src} WHERE df > 0),
qc AS (SELECT df, exp(lgamma(df / 2.0 + 0.5) - lgamma(df / 2.0)) / sqrt(pi()) AS c FROM qd),
qbis AS (SELECT df, c, 0 AS k, CASE WHEN df >= 2 THEN 0.0::DOUBLE ELSE -800.0::DOUBLE END AS lo,
    CASE WHEN df >= 2 THEN 18.6 / (df + 18.6) ELSE ln(0.2) END AS hi FROM qc
  UNION ALL
  SELECT df, c, k + 1, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END
  FROM (SELECT *, CASE WHEN df >= 2 THEN {inner} < {level!r} ELSE {outer} < {1 - level!r} END AS low
        FROM (SELECT *, (lo + hi) / 2.0 AS mid FROM qbis WHERE k < 62))),
qtab AS (SELECT df AS qdf, CASE WHEN df >= 2 THEN sqrt(df * lo / (1.0 - lo))
    ELSE sqrt(df * (1.0 - exp(lo)) / exp(lo)) END AS qtq FROM qbis WHERE k = 62)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# ---------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------

def linear_line_sql(band: bool, points: int = S.LINE_POINTS, keys: str = "SiteParam",
                    min_n: int = S.MIN_MODEL_N, measured_only: bool = True, where: str = "") -> str:
    head = (with_clean(where=where) + ",\n" + moments_cte(keys=(keys,), min_n=min_n, measured_only=measured_only)
            + ",\n" + quantile_cte("(SELECT n_fit - 2 AS df FROM mom)"))
    grid = f"""g0 AS (SELECT {keys}, n_fit, xbar, ybar, sxx, syy, sxy,
    CASE WHEN sxx > 0 THEN sxy / sxx END AS b1, xmin, xmax, unnest(range(0, {points})) AS i FROM mom),
g1 AS (SELECT *, xmin + i * (xmax - xmin) / {float(points - 1)!r} AS x FROM g0),
g2 AS (SELECT *, ybar + b1 * (x - xbar) AS yhat, n_fit - 2 AS df FROM g1),
g3 AS (SELECT g2.*, qtab.qtq AS tq FROM g2 LEFT JOIN qtab ON g2.df = qtab.qdf),
g4 AS (SELECT *, CASE WHEN sxx > 0 AND df > 0 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / df)
         * sqrt(1.0 / n_fit + pow(x - xbar, 2) / sxx) END AS se FROM g3)"""
    if band:
        sel = "round(yhat - tq * se, 6) AS lo, round(yhat + tq * se, 6) AS hi"
    else:
        sel = "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi"
    return recursive(head + ",\n" + grid + f"""
SELECT {keys}, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(yhat, 6) AS yhat, {sel} FROM g4""")


def loess_cte(src: str = "clean", keys: str = "SiteParam", span: float = S.LOESS_SPAN,
              points: int = S.LINE_POINTS, min_n: int = S.LOESS_MIN_N) -> str:
    """LOESS sums and fit per (series, grid point) -> CTE ``lfit``."""
    upow = ["1.0", "u", "(u * u)", "(u * u) * u", "(u * u) * (u * u)"]
    sums = ",\n    ".join(
        [f"sum((w * c) * {upow[k]}) AS S{k}" for k in range(5)]
        + [f"sum((w * sy) * {upow[k]}) AS T{k}" for k in range(3)]
        + [f"sum((w * w * c) * {upow[k]}) AS V{k}" for k in range(5)]
        + ["sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS n_pos", "first(h) AS h", "first(N) AS N"])
    det = "(S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2))"
    num = "(T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2))"
    h = (f"min(CASE WHEN cum >= floor(N * {span!r}) THEN dist END) OVER (PARTITION BY {keys}, i)"
         if span <= 1.0 else f"max(dist) OVER (PARTITION BY {keys}, i) * {span!r}")
    return f"""lp0 AS (SELECT {keys}, {XDAYS} AS x, count(*) AS c, sum(FinalResult) AS sy,
    sum(FinalResult * FinalResult) AS syy
  FROM {src} WHERE FinalResult IS NOT NULL AND DateSampled IS NOT NULL GROUP BY {keys}, x),
lp1 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {keys}) AS BIGINT) AS N,
    min(x) OVER (PARTITION BY {keys}) AS xmin, max(x) OVER (PARTITION BY {keys}) AS xmax FROM lp0),
lp2 AS (SELECT *, unnest(range(0, {points})) AS i FROM lp1 WHERE N >= {min_n}),
lp3 AS (SELECT *, xmin + i * (xmax - xmin) / {float(points - 1)!r} AS g FROM lp2),
lp4 AS (SELECT *, abs(x - g) AS dist FROM lp3),
lp5 AS (SELECT *, sum(c) OVER (PARTITION BY {keys}, i ORDER BY dist) AS cum FROM lp4),
lp6 AS (SELECT *, {h} AS h FROM lp5),
lp7 AS (SELECT *,
    CASE WHEN h > 0 THEN CASE WHEN dist / h < 1.0 THEN (1.0 - (dist / h) * (dist / h) * (dist / h))
           * (1.0 - (dist / h) * (dist / h) * (dist / h)) * (1.0 - (dist / h) * (dist / h) * (dist / h)) ELSE 0.0 END
         ELSE CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END END AS w,
    CASE WHEN h > 0 THEN (x - g) / h ELSE 0.0 END AS u FROM lp6),
lsum AS (SELECT {keys}, i, g,
    {sums}
  FROM lp7 GROUP BY {keys}, i, g),
lfit AS (SELECT *, {det} AS det,
    CASE WHEN n_pos >= 3 AND abs({det}) > 1e-12 * pow(S0, 3) THEN {num} / {det} END AS yhat FROM lsum)"""


def loess_line_sql(keys: str = "SiteParam", hot: bool = False, where: str = "") -> str:
    return (with_clean(hot=hot, where=where) + ",\n" + loess_cte(keys=keys) + f"""
SELECT {keys}, CAST(i AS INTEGER) AS i, round(g, 6) AS x, round(yhat, 6) AS yhat FROM lfit""")


def loess_band_sql(keys: str = "SiteParam", points: int = S.LINE_POINTS, hot: bool = False) -> str:
    a0 = "(S2 * S4 - S3 * S3) / det"
    a1 = "(-(S1 * S4 - S3 * S2)) / det"
    a2 = "(S1 * S3 - S2 * S2) / det"
    kn2 = ("(a0 * a0 * V0 + a1 * a1 * V2 + a2 * a2 * V4 + 2.0 * a0 * a1 * V1 + 2.0 * a0 * a2 * V2"
           " + 2.0 * a1 * a2 * V3)")
    step = f"((xmax - xmin) / {float(points - 1)!r})"
    lin = "({a} + ({b} - {a}) * t)"
    return recursive(with_clean(hot=hot) + ",\n" + loess_cte(keys=keys) + f""",
fa AS (SELECT {keys}, i, g, yhat, V0, V1, V2, V3, V4,
    CASE WHEN yhat IS NOT NULL THEN {a0} END AS a0,
    CASE WHEN yhat IS NOT NULL THEN {a1} END AS a1,
    CASE WHEN yhat IS NOT NULL THEN {a2} END AS a2 FROM lfit),
fk AS (SELECT {keys}, i, g, yhat, a0 AS l00, {kn2} AS kn2 FROM fa),
seg AS (SELECT * FROM (SELECT {keys}, i, g, yhat, l00, kn2,
    lead(yhat) OVER (PARTITION BY {keys} ORDER BY i) AS yhat_n,
    lead(l00) OVER (PARTITION BY {keys} ORDER BY i) AS l00_n,
    lead(kn2) OVER (PARTITION BY {keys} ORDER BY i) AS kn2_n,
    lead(g) OVER (PARTITION BY {keys} ORDER BY i) AS g_n FROM fk) WHERE i < {points - 1}),
pk AS (SELECT {keys}, x, c, sy, syy, N,
    CAST(CASE WHEN {step} > 0 THEN least(floor((x - xmin) / {step}), {points - 2}) ELSE 0 END AS INTEGER) AS i
  FROM lp1 WHERE N >= {S.LOESS_MIN_N}),
pj AS (SELECT pk.*, seg.g, seg.g_n, seg.yhat, seg.yhat_n, seg.l00, seg.l00_n, seg.kn2, seg.kn2_n,
    CASE WHEN seg.g_n > seg.g THEN (pk.x - seg.g) / (seg.g_n - seg.g) ELSE 0.0 END AS t
  FROM pk JOIN seg ON pk.{keys} = seg.{keys} AND pk.i = seg.i),
pi AS (SELECT *, {lin.format(a='yhat', b='yhat_n')} AS yd, {lin.format(a='l00', b='l00_n')} AS ld,
    {lin.format(a='kn2', b='kn2_n')} AS kd FROM pj),
per AS (SELECT {keys}, sum(syy - 2.0 * yd * sy + c * yd * yd) AS rss, sum(c * ld) AS nu1,
    sum(c * kd) AS nu2, sum(CASE WHEN yd IS NULL OR ld IS NULL OR kd IS NULL THEN 1 ELSE 0 END) AS n_unfit,
    first(N) AS N FROM pi GROUP BY {keys}),
per2 AS (SELECT *, N - 2.0 * nu1 + nu2 AS delta1 FROM per),
{quantile_cte("(SELECT delta1 AS df FROM per2)")},
per3 AS (SELECT per2.*, CASE WHEN delta1 > 0 AND n_unfit = 0 THEN sqrt(greatest(rss, 0.0) / delta1) END AS s,
    qtab.qtq AS tq FROM per2 LEFT JOIN qtab ON qtab.qdf = per2.delta1),
band AS (SELECT fk.{keys}, fk.i, fk.g, fk.yhat, per3.s * sqrt(greatest(fk.kn2, 0.0)) AS se, per3.tq,
    per3.delta1 AS df FROM fk LEFT JOIN per3 ON fk.{keys} = per3.{keys})
SELECT {keys}, CAST(i AS INTEGER) AS i, round(g, 6) AS x, round(yhat, 6) AS yhat, round(se, 6) AS se,
  round(yhat - tq * se, 6) AS lo, round(yhat + tq * se, 6) AS hi, round(df, 6) AS df FROM band""")


def loess_surface_cte(src: str = "clean", keys: str = "SiteParam", span: float = S.LOESS_SPAN, cell: float = 0.2,
                      margin: float = 0.005, points: int = S.LINE_POINTS, min_n: int = S.LOESS_MIN_N) -> str:
    """Interpolated LOESS: cells by recursion over (first rank, last rank), the
    vertices, each vertex's regression as one row per (vertex, date), and the
    blended line -> CTEs ``sop`` (regression coefficients), ``sfit`` (value and
    slope of every vertex) and ``sline``."""
    k = keys
    det = "(S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2))"
    sums = ", ".join(f"sum(w * c * pow(u, {p})) AS S{p}" for p in range(5))
    blend = """CASE k WHEN 0 THEN pow(1 - t, 2) * (1 + 2 * t) WHEN 1 THEN t * t * (3 - 2 * t)
      WHEN 2 THEN t * pow(1 - t, 2) * width ELSE -t * t * (1 - t) * width END"""
    return f"""sp0 AS (SELECT {k}, {XDAYS} AS x, count(*) AS c, sum(FinalResult) AS sy, sum(FinalResult * FinalResult) AS syy
  FROM {src} WHERE FinalResult IS NOT NULL AND DateSampled IS NOT NULL GROUP BY {k}, x),
sp1 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {k}) AS BIGINT) AS N, min(x) OVER (PARTITION BY {k}) AS xmin,
    max(x) OVER (PARTITION BY {k}) AS xmax FROM sp0),
sp AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {k} ORDER BY x) AS BIGINT) AS upto, lead(x) OVER (PARTITION BY {k} ORDER BY x) AS nx
  FROM sp1 WHERE N >= {min_n}),
sbox AS (SELECT DISTINCT {k}, N, xmin, xmax, xmin - mu AS lo, xmax + mu AS hi
  FROM (SELECT *, {margin!r} * greatest(xmax - xmin, greatest(abs(xmin), abs(xmax)) * 1e-3 + 1e-30) AS mu FROM sp)),
scell AS (SELECT {k}, N, 1::BIGINT AS l, N AS r, lo AS a, hi AS b FROM sbox
  UNION ALL
  SELECT {k}, N, CASE WHEN side = 0 THEN l ELSE g.cut + 1 END, CASE WHEN side = 0 THEN g.cut ELSE r END,
    CASE WHEN side = 0 THEN a ELSE g.t END, CASE WHEN side = 0 THEN g.t ELSE b END
  FROM (SELECT q.{k}, q.N, q.l, q.r, q.a, q.b,
        arg_min({{'cut': sp.upto, 't': (sp.x + sp.nx) / 2.0}}, 2 * abs(sp.upto - (q.l + q.r) // 2) - CASE WHEN sp.upto > (q.l + q.r) // 2 THEN 1 ELSE 0 END) AS g
      FROM scell q JOIN sp ON sp.{k} = q.{k} AND sp.upto >= q.l AND sp.upto < q.r
      WHERE q.r - q.l + 1 > floor(q.N * {span!r} * {cell!r}) GROUP BY ALL) cut, (VALUES (0), (1)) s(side)),
sver AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS vi FROM
  (SELECT DISTINCT {k}, N, v FROM (SELECT {k}, N, a AS v FROM scell UNION ALL SELECT {k}, N, b FROM scell))),
sint AS (SELECT * FROM (SELECT {k}, vi, v AS a, lead(v) OVER (PARTITION BY {k} ORDER BY vi) AS b FROM sver) WHERE b IS NOT NULL),
sd0 AS (SELECT sver.{k}, sver.N, vi, v, x, c, sy, abs(x - v) AS dist,
    CAST(sum(c) OVER (PARTITION BY sver.{k}, vi ORDER BY abs(x - v)) AS BIGINT) AS held FROM sver JOIN sp USING ({k})),
sd1 AS (SELECT *, min(CASE WHEN held >= least(N, floor(N * {span!r} + 1e-5)) THEN dist END) OVER (PARTITION BY {k}, vi) AS h FROM sd0),
sd2 AS (SELECT *, CASE WHEN dist < h THEN pow(1.0 - pow(dist / h, 3), 3) ELSE 0.0 END AS w,
    CASE WHEN h > 0 THEN (x - v) / h ELSE x - v END AS u FROM sd1),
ssum AS (SELECT *, {det} AS det, n_pos >= 3 AND abs({det}) > 1e-12 * pow(S0, 3) AS fit FROM
  (SELECT {k}, vi, v, any_value(h) AS h, {sums}, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS n_pos FROM sd2 GROUP BY ALL)),
sop AS (SELECT d.{k}, d.vi, d.x, d.c, d.sy, s.fit, CASE WHEN s.fit THEN
      d.w * ((S2 * S4 - S3 * S3) + (S3 * S2 - S1 * S4) * d.u + (S1 * S3 - S2 * S2) * d.u * d.u) / s.det END AS lv,
    CASE WHEN s.fit THEN
      d.w * ((S3 * S2 - S1 * S4) + (S0 * S4 - S2 * S2) * d.u + (S1 * S2 - S0 * S3) * d.u * d.u) / s.det / d.h END AS ls
  FROM sd2 d JOIN ssum s ON d.{k} = s.{k} AND d.vi = s.vi),
sfit AS (SELECT {k}, vi, sum(lv * sy) AS val, sum(ls * sy) AS slope FROM sop GROUP BY ALL),
sgrid AS (SELECT {k}, i, xmin + i * (xmax - xmin) / {float(points - 1)!r} AS g FROM
  (SELECT {k}, xmin, xmax, unnest(range(0, {points})) AS i FROM sbox)),
sat AS (SELECT *, (pos - a) / (b - a) AS t, b - a AS width FROM
  (SELECT {k}, 0 AS kind, i AS id, g AS pos FROM sgrid UNION ALL SELECT {k}, 1, x, x FROM sp) p JOIN sint USING ({k}) WHERE pos > a AND pos <= b),
sbl AS (SELECT {k}, kind, id, pos, vi + k % 2 AS vi, k // 2 AS slope, {blend} AS e FROM sat, (VALUES (0), (1), (2), (3)) z(k)),
sev AS (SELECT b.{k}, kind, id, any_value(pos) AS pos, CASE WHEN bool_and(val IS NOT NULL OR e = 0) THEN
    sum(CASE WHEN e = 0 THEN 0 WHEN b.slope = 1 THEN e * f.slope ELSE e * val END) END AS y
  FROM sbl b JOIN sfit f ON b.{k} = f.{k} AND b.vi = f.vi GROUP BY b.{k}, kind, id)"""


def loess_surface_sql(keys: str = "SiteParam", hot: bool = False) -> str:
    return recursive(with_clean(hot=hot) + ",\n" + loess_surface_cte(keys=keys) + f"""
SELECT {keys}, CAST(id AS INTEGER) AS i, round(pos, 6) AS x, round(y, 6) AS yhat FROM sev WHERE kind = 0""")


def loess_surface_band_sql(keys: str = "SiteParam", hot: bool = False) -> str:
    """The band from the traces of L = E V, with the small matrices as tables
    of (row, column, value) and their products as joins."""
    k = keys

    def product(a: str, b: str) -> str:
        return (f"(SELECT l.{k}, l.i, r.j, sum(l.m * r.m) AS m FROM {a} l JOIN {b} r ON l.{k} = r.{k} AND l.j = r.i GROUP BY ALL)")

    def trace(t: str) -> str:
        return f"(SELECT {k}, sum(m) AS m FROM {t} WHERE i = j GROUP BY ALL)"

    return recursive(with_clean(hot=hot) + ",\n" + loess_surface_cte(keys=keys) + f""",
vop AS (SELECT {k}, vi * 2 AS i, x, c, lv AS m FROM sop UNION ALL SELECT {k}, vi * 2 + 1, x, c, ls FROM sop),
eop AS (SELECT {k}, id AS x, vi * 2 + slope AS i, e AS m FROM sbl WHERE kind = 1),
ma AS MATERIALIZED (SELECT p.{k}, p.i, q.i AS j, sum(p.m * q.m * sp.c) AS m FROM eop p JOIN eop q ON p.{k} = q.{k} AND p.x = q.x
  JOIN sp ON sp.{k} = p.{k} AND sp.x = p.x GROUP BY ALL),
mb AS MATERIALIZED (SELECT p.{k}, p.i, q.i AS j, sum(p.m * q.m * p.c) AS m FROM vop p JOIN vop q ON p.{k} = q.{k} AND p.x = q.x GROUP BY ALL),
mc AS MATERIALIZED (SELECT p.{k}, p.i, q.i AS j, sum(p.m * q.m * p.c) AS m FROM vop p JOIN eop q ON p.{k} = q.{k} AND p.x = q.x GROUP BY ALL),
mab AS MATERIALIZED {product('ma', 'mb')}, mac AS MATERIALIZED {product('ma', 'mc')},
whole AS (SELECT {k}, bool_and(fit) AS fit FROM sop GROUP BY ALL),
scale AS (SELECT whole.{k}, N - 2 * tc.m + tab.m AS delta1,
    N - 4 * tc.m + 2 * tcc.m + 4 * tab.m + tabab.m - 4 * tacb.m AS delta2, rss FROM whole
  JOIN (SELECT DISTINCT {k}, N FROM sbox) n USING ({k})
  JOIN {trace('mc')} tc USING ({k}) JOIN {trace('mab')} tab USING ({k})
  JOIN {trace(product('mc', 'mc'))} tcc USING ({k}) JOIN {trace(product('mab', 'mab'))} tabab USING ({k})
  JOIN {trace(product('mac', 'mb'))} tacb USING ({k})
  JOIN (SELECT sp.{k}, sum(syy - 2 * y * sy + c * y * y) AS rss FROM sp JOIN sev ON sev.kind = 1 AND sp.{k} = sev.{k} AND sp.x = sev.id
        GROUP BY ALL) r USING ({k}) WHERE whole.fit),
freedom AS (SELECT {k}, CASE WHEN delta1 > 0 THEN sqrt(greatest(rss, 0.0) / delta1) END AS s,
    CASE WHEN delta1 > 0 AND delta2 > 0 THEN delta1 * delta1 / delta2 END AS df FROM scale),
{quantile_cte("freedom")},
norms AS (SELECT p.{k}, p.id, sqrt(greatest(sum(p.e * b.m * q.e), 0.0)) AS norm FROM sbl p
  JOIN mb b ON b.{k} = p.{k} AND b.i = p.vi * 2 + p.slope
  JOIN sbl q ON q.{k} = p.{k} AND q.kind = 0 AND q.id = p.id AND b.j = q.vi * 2 + q.slope WHERE p.kind = 0 GROUP BY ALL)
SELECT sev.{k}, CAST(sev.id AS INTEGER) AS i, round(pos, 6) AS x, round(y, 6) AS yhat, round(s * norm, 6) AS se,
  round(y - qtq * s * norm, 6) AS lo, round(y + qtq * s * norm, 6) AS hi, round(df, 6) AS df
FROM sev LEFT JOIN freedom ON sev.{k} = freedom.{k} LEFT JOIN norms ON norms.{k} = sev.{k} AND norms.id = sev.id
  LEFT JOIN qtab ON qtab.qdf = freedom.df WHERE sev.kind = 0""")
