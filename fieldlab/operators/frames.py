"""Plot-ready point frames and the display table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab import schema as S
from fieldlab.functions.cleaning import date_text, na_text, number_text
from fieldlab.operators.order import OrderIndex, number_rows

CLEAN_ORDER = ["SamplingPoint", "WebParameter", "DateSampled", "FinalResult", "Qualifiers",
               "RelativeDepthComments", "DL", "Description"]


def default_facet(df: DataFrame) -> DataFrame:
    """Distinct site and parameter counts and the default facet: by
    parameter only for several sites and one parameter, else by site."""
    c = df.agg(F.countDistinct("SamplingPoint").alias("n_sites"),
               F.countDistinct("WebParameter").alias("n_params"))
    return c.withColumn("facet", F.when((F.col("n_sites") > 1) & (F.col("n_params") == 1),
                                        F.lit("Parameter")).otherwise(F.lit("Site")))


def facet_columns(df: DataFrame, by: str | None = "Site", colour_by: str = "site") -> DataFrame:
    """Attach ``facet`` and ``colour``.  Facet by parameter colours by site,
    facet by site colours by parameter; without facets (``by=None``) colour
    by 'site', 'parameter', 'series' or 'qualifier' (first versions)."""
    if by == "Parameter":
        return df.withColumns({"facet": F.col("WebParameter"), "colour": F.col("SamplingPoint")})
    if by == "Site":
        return df.withColumns({"facet": F.col("SamplingPoint"), "colour": F.col("WebParameter")})
    if by is not None:
        raise ValueError("by must be 'Site', 'Parameter' or None")
    colour = {"site": "SamplingPoint", "parameter": "WebParameter", "series": "SiteParam",
              "qualifier": "Qualifiers"}[colour_by]
    return df.withColumns({"facet": F.lit(None).cast("string"), "colour": F.col(colour)})


def has_depth(df: DataFrame, profile: str = "current") -> DataFrame:
    """One row ``use_size``: whether any depth differs from the default
    (current: not 'surface'; v2: not 'N/A'; v1: any non-NULL)."""
    d = F.col("RelativeDepthComments")
    if profile == "current":
        cond = d != "surface"
    elif profile == "v2":
        cond = d != "N/A"
    elif profile == "v1":
        cond = d.isNotNull()
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("use_size"))


def point_id(df: DataFrame, order=CLEAN_ORDER, out: str = "point_id", index: OrderIndex | None = None) -> DataFrame:
    """Consecutive 1..N row id in a total order: each range of the order index
    is numbered on its own (see ``operators.order``); nothing is stored."""
    return number_rows(df, [c for c in order if c in df.columns], out, index)


def value_range(df: DataFrame, pad: float = S.RANGE_PAD, col: str = "FinalResult") -> DataFrame:
    """Value range padded by ``pad`` of its width on both sides."""
    r = df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))
    width = F.col("max_value") - F.col("min_value")
    return r.withColumns({"lo": F.col("min_value") - width * pad,
                          "hi": F.col("max_value") + width * pad})


def display_table(df: DataFrame) -> DataFrame:
    """The seven display columns under their display names (date as text)."""
    names = S.DISPLAY_NAMES
    return df.select(F.col("SamplingPoint").alias(names[0]), F.col("WebParameter").alias(names[1]),
                     date_text(F.col("DateSampled")).alias(names[2]), F.col("FinalResult").alias(names[3]),
                     F.col("DL").alias(names[4]), F.col("Qualifiers").alias(names[5]),
                     F.col("RelativeDepthComments").alias(names[6]))


def page(df: DataFrame, n: int, size: int = S.PAGE_SIZE, order=None) -> DataFrame:
    """Page ``n`` (0-based) of ``size`` rows in a total order (all columns
    by default): a top-k sort, not a full one, for pages near the start;
    ``order.page_at`` reads any page from an order index."""
    order = list(order or df.columns)
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).offset(n * size).limit(size)


def point_label(df: DataFrame, profile: str = "current") -> DataFrame:
    """Attach the point hover text ``label``."""
    site, param = na_text(F.col("SamplingPoint")), na_text(F.col("WebParameter"))
    res = number_text(F.col("FinalResult"))
    q, z = na_text(F.col("Qualifiers")), na_text(F.col("RelativeDepthComments"))
    iso = F.coalesce(date_text(F.col("DateSampled")), F.lit("NA"))
    if profile == "current":
        parts = ["Site: ", site, "<br>Parameter: ", param, "<br>Date: ", iso, "<br>Result: ", res,
                 "<br>Qualifier: ", q, "<br>Depth: ", z]
    elif profile == "v3_site":
        parts = ["Site: ", site, "<br>Date: ", iso, "<br>Result: ", res, "<br>Qualifier: ", q,
                 "<br>Depth: ", z]
    elif profile == "v3_param":
        parts = ["Parameter: ", param, "<br>Date: ", iso, "<br>Result: ", res, "<br>Qualifier: ", q,
                 "<br>Depth: ", z]
    elif profile in ("v2", "v1"):
        d = iso if profile == "v2" else F.coalesce(date_text(F.col("DateSampled"), "MM-dd-yyyy"), F.lit("NA"))
        parts = ["Date: ", d, " <br>Result: ", res, " <br>Qualifiers: ", q, " <br>Relative Depth: ", z]
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return df.withColumn("label", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _lookup(col: Column, mapping: dict, cast: str) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.cast(cast)


def shape_code(df: DataFrame, profile: str = "current") -> DataFrame:
    """Attach the point shape code (legend class; DL class in v1/v2)."""
    if profile == "current":
        return df.withColumn("shape", _lookup(F.col("legend_shape"), S.SHAPES, "int"))
    return df.withColumn("shape", _lookup(F.col("DL"), S.SHAPES_V1, "int"))


def size_code(df: DataFrame, profile: str = "current") -> DataFrame:
    """Attach the point size of the depth level (NULL for other depths)."""
    mapping = {"current": S.DEPTH_SIZES, "v2": S.DEPTH_SIZES_V2, "v1": S.DEPTH_SIZES_V1}[profile]
    return df.withColumn("size", _lookup(F.col("RelativeDepthComments"), mapping, "double"))


def image_path(df: DataFrame) -> DataFrame:
    """Attach the point image of the legend class."""
    return df.withColumn("point_image", _lookup(F.col("legend_shape"), S.IMAGES, "string"))


def points_frame(df: DataFrame, facet: str | None = None, profile: str = "current") -> DataFrame:
    """Everything a point layer needs: facet, colour, group, shape, size,
    label and a point id.  The facet defaults to the data's default facet
    and the size is by depth only when some depth is not the default
    (two one-row aggregates read on the driver)."""
    if facet is None:
        facet = default_facet(df).first()["facet"]
    use_size = has_depth(df, profile).first()["use_size"]
    out = facet_columns(point_id(df), facet).withColumn("group", F.col("SiteParam"))
    out = shape_code(out, profile)
    out = size_code(out, profile) if use_size else out.withColumn("size", F.lit(2.5))
    out = point_label(out, profile)
    return out.select(*[c for c in out.columns if c != "point_id"], "point_id")
