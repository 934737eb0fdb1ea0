"""Site directory, option lists and selection lookups.

Selections are user input (bounded by the option caps) and become small
frames with their position, so selection-order rules are joins and
aggregations rather than driver loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab import schema as S
from fieldlab.operators.joins import bounded_broadcast, keep_values, values_frame
from fieldlab.operators.order import in_locale


def site_directory(results: DataFrame, stations: DataFrame, locale: str | None = None) -> DataFrame:
    """Distinct (SamplingPoint, Description) of sites that have results,
    ordered by site.  Distinct first so the join sees one row per site;
    distinct again because duplicate stations fan out.  The order is binary, or
    that of ``locale`` (see ``order.in_locale``)."""
    sites = results.select("SamplingPoint").distinct()
    st = bounded_broadcast(stations.select("StationID", "Description"))
    return (sites.join(st, sites["SamplingPoint"] == st["StationID"], "left")
            .select("SamplingPoint", "Description").distinct()
            .orderBy(*[k.asc_nulls_last() for c in ("SamplingPoint", "Description") for k in in_locale(c, locale)]))


def sorted_options(df: DataFrame, col: str, locale: str | None = None) -> DataFrame:
    """Distinct non-NULL values (an option list) in binary order, or in that of
    ``locale`` (see ``order.in_locale``)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(*in_locale(col, locale))


def available_params(results: DataFrame, sites, locale: str | None = None) -> DataFrame:
    """Sorted distinct parameters measured at the given site(s)."""
    sites = [sites] if isinstance(sites, str) else list(sites)
    return sorted_options(keep_values(results, "SamplingPoint", sites), "WebParameter", locale)


def valid_selection(spark: SparkSession, current, options: DataFrame, col: str) -> DataFrame:
    """The current selection restricted to values still offered, in the
    selection's order: (pos, col)."""
    sel = values_frame(spark, col, current, with_pos=True)
    sel = sel.groupBy(col).agg(F.min("pos").alias("pos"))
    return (sel.join(options.select(col).distinct(), col, "left_semi")
            .select("pos", col).orderBy("pos"))


def describe_sites(spark: SparkSession, directory: DataFrame, sites) -> DataFrame:
    """Selected sites -> their first description each, de-duplicated, in
    selection order: (pos, Description).  'First' is the smallest
    description of a site; sites absent from the directory give nothing."""
    sel = values_frame(spark, "SamplingPoint", sites, with_pos=True)
    first = (sel.join(directory, "SamplingPoint", "inner")
             .groupBy("pos", "SamplingPoint").agg(F.min("Description").alias("Description")))
    return (first.groupBy("Description").agg(F.min("pos").alias("pos"))
            .select("pos", "Description").orderBy("pos"))


def sites_for(spark: SparkSession, directory: DataFrame, descriptions, first: bool = False) -> DataFrame:
    """Selected descriptions -> all their sites (or the first, with
    ``first=True``), de-duplicated, in selection then site order:
    (pos, SamplingPoint) where pos is the description's position."""
    sel = values_frame(spark, "Description", descriptions, with_pos=True)
    hits = sel.join(directory.where(F.col("Description").isNotNull()), "Description", "inner")
    if first:
        hits = hits.groupBy("pos", "Description").agg(F.min("SamplingPoint").alias("SamplingPoint"))
    return (hits.groupBy("SamplingPoint").agg(F.min("pos").alias("pos"))
            .select("pos", "SamplingPoint").orderBy("pos", "SamplingPoint"))


def first_description(directory: DataFrame, site: str) -> DataFrame:
    """The first description of one site (one row, or none)."""
    return (directory.where(F.col("SamplingPoint") == site)
            .agg(F.min("Description").alias("Description"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 0).drop("_n"))


def same_set(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """One row ``same``: whether two columns hold the same set of values
    (duplicates ignored, NULL equal to NULL)."""
    fa = a.select(F.col(col).alias("_a")).distinct().withColumn("_in_a", F.lit(True))
    fb = b.select(F.col(col).alias("_b")).distinct().withColumn("_in_b", F.lit(True))
    j = fa.join(fb, fa["_a"].eqNullSafe(fb["_b"]), "full_outer")
    differing = F.sum(F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), 1).otherwise(0))
    return j.agg((F.coalesce(differing, F.lit(0)) == 0).alias("same"))      # two empty sets are equal


def search_options(df: DataFrame, col: str, text: str, limit: int | None = None) -> DataFrame:
    """Options containing ``text`` (case-insensitive), sorted; cut only when
    the caller asks for the first ``limit`` of them."""
    found = (df.select(col).where(F.col(col).isNotNull()
                                  & F.lower(F.col(col)).contains(text.lower()))
             .distinct().orderBy(col))
    return found if limit is None else found.limit(limit)


def search_sites(directory: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return search_options(directory, "SamplingPoint", text, limit)


def search_params(results: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return search_options(results, "WebParameter", text, limit)
