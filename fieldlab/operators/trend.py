"""Per-series linear trend statistics.

The regression moments are algebraic, so ``linear_stats`` is a single hash
aggregation with map-side partial aggregation: a series holding a third of
all rows still ships only one partial row per map task.  The p-value is
then evaluated once per series on the aggregated frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab import schema as S
from fieldlab.functions.cleaning import days_since_epoch, fixed_decimals, na_text
from fieldlab.functions.tdist import slope_p_value
from fieldlab.operators.joins import BROADCAST_MAX_ROWS, bounded_broadcast
from fieldlab.session import checkpoint_dir

SERIES = ["SamplingPoint", "WebParameter"]


def model_rows(df: DataFrame, measured_only: bool = True) -> DataFrame:
    """Rows entering a linear model: measured values only (qualified rows
    are kept)."""
    return df.where(F.col("DL") == S.DL_MEASURED) if measured_only else df


def small_side(agg: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A per-series aggregate prepared for joining back to the rows: cut
    from its lineage (reliable checkpoint, so the source is not scanned
    again) and broadcast when its row count is within the bound; otherwise
    it is the hash table of a shuffle join (it has one row per series, so the
    rows need no sort) with AQE skew splitting.  Deciding before
    planning the join spares the rows side a shuffle whenever the aggregate
    is small."""
    checkpoint_dir(agg.sparkSession)
    kept = agg.checkpoint(eager=True)
    small = bounded_broadcast(kept, max_rows)
    return kept.hint("shuffle_hash") if small is kept else small


def min_group(df: DataFrame, keys=SERIES, n: int = S.MIN_MODEL_N) -> DataFrame:
    """Keep the rows of groups with at least ``n`` rows.

    Counted by an aggregation (partial per map task, so a hot group costs
    one row per task) and joined back with a semi join instead of a per-key
    window, so a hot group is never gathered into one task."""
    keys = list(keys)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(small_side(big), keys, "left_semi")


def _moments(df: DataFrame, keys, y: str = "FinalResult", x: str = "DateSampled") -> DataFrame:
    xd = days_since_epoch(F.col(x))
    yv = F.col(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("N"),
        F.regr_count(yv, xd).alias("n_fit"),
        F.regr_r2(yv, xd).alias("_r2"),
        F.regr_sxx(yv, xd).alias("sxx"),
        F.regr_syy(yv, xd).alias("syy"),
        F.regr_sxy(yv, xd).alias("sxy"),
        F.regr_avgx(yv, xd).alias("xbar"),
        F.regr_avgy(yv, xd).alias("ybar"),
        F.min(xd).alias("xmin"),
        F.max(xd).alias("xmax"),
    )


def series_moments(df: DataFrame, keys=SERIES, min_n: int = S.MIN_MODEL_N,
                   measured_only: bool = True) -> DataFrame:
    """Regression sums per series (groups with at least ``min_n`` rows)."""
    m = _moments(model_rows(df, measured_only), list(keys))
    return m.where(F.col("N") >= min_n)


def _r2_expr():
    # Constant x: no slope (NULL).  Constant y: the fit is undefined; Spark's
    # regr_r2 would report 1.0, the model reports NaN -> NULL here.
    return F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("_r2"))


def linear_stats(df: DataFrame, min_n: int = S.MIN_MODEL_N, measured_only: bool = True,
                 keys=SERIES) -> DataFrame:
    """Site, Parameter, N, R_squared, p_value per series with >= ``min_n``
    measured rows (x = days since 1970-01-01, y = result)."""
    return stats_from_moments(series_moments(df, keys, min_n, measured_only), keys=keys)


def stats_from_moments(m: DataFrame, min_n: int = 0, keys=SERIES) -> DataFrame:
    """``linear_stats`` from regression sums per series, such as those kept
    with the store (``sources.store.moments``)."""
    keys = list(keys)
    if "_r2" not in m.columns:
        m = m.where(F.col("N") >= min_n).withColumn(
            "_r2", F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))))
    m = m.withColumn("R_squared", _r2_expr())
    out = m.select(*keys, F.col("N"), F.col("R_squared"),
                   slope_p_value(F.col("R_squared"), F.col("n_fit")).alias("p_value"))
    if keys == SERIES:
        out = out.withColumnsRenamed({"SamplingPoint": "Site", "WebParameter": "Parameter"})
    return out


def stats_table(stats: DataFrame, digits: int = 4) -> DataFrame:
    """Statistics as displayed: R_squared and p_value rounded to 4 decimals."""
    return stats.withColumns({"R_squared": F.round("R_squared", digits),
                              "p_value": F.round("p_value", digits)})


def stats_status(stats: DataFrame, kind: str = "linear") -> DataFrame:
    """One row: ``n_groups`` and the status text shown with the trend.

    linear: a warning when no series qualifies, else the exclusion note;
    loess: the exploratory note."""
    n = stats.agg(F.count(F.lit(1)).alias("n_groups"))
    if kind == "loess":
        return n.withColumn("status", F.lit(S.MSG_LOESS_NOTE))
    if kind != "linear":
        raise ValueError("kind must be 'linear' or 'loess'")
    return n.withColumn("status", F.when(F.col("n_groups") == 0, F.lit(S.MSG_NO_GROUP))
                        .otherwise(F.lit(S.MSG_LINEAR_NOTE)))


def trend_label(stats: DataFrame, site: str = "Site", param: str = "Parameter") -> DataFrame:
    """Attach the hover text of a linear trend line."""
    label = F.concat(
        F.lit("Trend line<br>Site: "), na_text(F.col(site)),
        F.lit("<br>Parameter: "), na_text(F.col(param)),
        F.lit("<br>N: "), na_text(F.col("N")),
        F.lit("<br>R²: "), fixed_decimals(F.col("R_squared"), 3),
        F.lit("<br>p-value: "), fixed_decimals(F.col("p_value"), 4))
    return stats.withColumn("tooltip", label)


def loess_label(counts: DataFrame, site: str = "SamplingPoint", param: str = "WebParameter") -> DataFrame:
    """Attach the hover text of a LOESS line."""
    label = F.concat(F.lit("LOESS trend<br>Site: "), na_text(F.col(site)),
                     F.lit("<br>Parameter: "), na_text(F.col(param)),
                     F.lit("<br>N: "), na_text(F.col("N")))
    return counts.withColumn("tooltip", label)


def attach_stats(df: DataFrame, stats: DataFrame, keys=SERIES) -> DataFrame:
    """Left-join per-series statistics onto the rows (the statistics are
    checkpointed and broadcast when their size check passes, see
    ``small_side``)."""
    keys = list(keys)
    st = stats
    if "Site" in st.columns and "SamplingPoint" not in st.columns:
        st = st.withColumnsRenamed({"Site": "SamplingPoint", "Parameter": "WebParameter"})
    return df.join(small_side(st), keys, "left")


def series_count(df: DataFrame) -> DataFrame:
    """Rows per series with a parsed result (the LOESS hover N)."""
    return (df.where(F.col("FinalResult").isNotNull())
            .groupBy("SiteParam", "SamplingPoint", "WebParameter")
            .agg(F.count(F.lit(1)).alias("N")))
