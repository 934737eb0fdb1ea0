"""Date bounds and site x parameter coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab import schema as S
from fieldlab.operators.order import number_options


def date_bounds(df: DataFrame, col: str = "DateSampled") -> DataFrame:
    """First and last sample date (NULL dates ignored)."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def requested_pairs(spark: SparkSession, sites, params) -> DataFrame:
    """Every requested (Site, Parameter) with positions; sites vary fastest.

    Built by exploding the (bounded) parameter selection onto the site
    frame, not by a join."""
    sites, params = list(sites), list(params)
    schema = T.StructType([T.StructField("s_pos", T.IntegerType()), T.StructField("Site", T.StringType())])
    sdf = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sites)], schema)
    plist = F.array(*[F.struct(F.lit(j + 1).alias("p_pos"), F.lit(p).alias("Parameter"))
                      for j, p in enumerate(params)]).cast("array<struct<p_pos: int, Parameter: string>>")
    return (sdf.select("s_pos", "Site", F.explode(plist).alias("_p"))
            .select("Site", F.col("_p.Parameter").alias("Parameter"), "s_pos", F.col("_p.p_pos").alias("p_pos")))


def offered_pairs(options: DataFrame, sites, col: str = "WebParameter") -> DataFrame:
    """Every (Site, Parameter) of the selected sites and a frame of distinct
    options, with positions (options sorted).  The selection is exploded onto
    the options, which never leave the cluster and are not cut.  The options
    are numbered by ``number_options``: sorted by range, no window over them."""
    numbered = (number_options(options.select(F.col(col).alias("Parameter")), ["Parameter"], "p_pos")
                .withColumn("p_pos", F.col("p_pos").cast("int")))
    slist = F.array(*[F.struct(F.lit(i + 1).alias("s_pos"), F.lit(s).alias("Site"))
                      for i, s in enumerate(sites)]).cast("array<struct<s_pos: int, Site: string>>")
    return (numbered.select("Parameter", "p_pos", F.explode(slist).alias("_s"))
            .select(F.col("_s.Site").alias("Site"), "Parameter", F.col("_s.s_pos").alias("s_pos"), "p_pos"))


def observed_pairs(df: DataFrame) -> DataFrame:
    """Distinct (Site, Parameter) that have rows."""
    return df.select(F.col("SamplingPoint").alias("Site"),
                     F.col("WebParameter").alias("Parameter")).distinct()


def missing_pairs(df: DataFrame, sites, params) -> DataFrame:
    """Requested pairs without any row (anti join), with positions."""
    req = requested_pairs(df.sparkSession, sites, params)
    return req.join(observed_pairs(df), ["Site", "Parameter"], "left_anti")


def missing_values(df: DataFrame, col: str, wanted) -> DataFrame:
    """Wanted values (first position kept) that never occur in ``col``."""
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField(col, T.StringType())])
    w = df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(wanted)], schema)
    w = w.groupBy(col).agg(F.min("pos").alias("pos"))
    present = df.select(col).where(F.col(col).isNotNull()).distinct()
    return w.join(present, col, "left_anti").select("pos", col)


def missing_message(df: DataFrame, sites, params) -> DataFrame:
    """One row ``message``: the gap text, the no-data text, or NULL.

    The gap list is ordered as the request grid (sites fastest) and is as
    long as the selection, never the data."""
    gaps = missing_pairs(df, sites, params).select(
        F.lit(0).alias("_kind"), "p_pos", "s_pos",
        F.concat(F.col("Site"), F.lit(" ("), F.col("Parameter"), F.lit(")")).alias("_txt"))
    probe = df.select(F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("p_pos"),
                      F.lit(None).cast("int").alias("s_pos"),
                      F.lit(None).cast("string").alias("_txt")).limit(1)
    agg = gaps.unionByName(probe).agg(
        F.max(F.col("_kind")).alias("_has_data"),
        F.array_sort(F.collect_list(F.when(F.col("_kind") == 0, F.struct("p_pos", "s_pos", "_txt"))))
        .alias("_gaps"))
    text = F.array_join(F.transform(F.col("_gaps"), lambda g: g["_txt"]), ", ")
    return agg.select(
        F.when(F.coalesce(F.col("_has_data"), F.lit(0)) == 0, F.lit(S.MSG_NO_DATA))
        .when(F.size("_gaps") > 0, F.concat(F.lit(S.MSG_GAPS), text, F.lit(".")))
        .alias("message"))
