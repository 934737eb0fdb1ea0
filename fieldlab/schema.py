"""Column names, schemas and the fixed values the results must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values.  These literals must equal the studied application's for
# equal results; they are listed here in their natural order.
# --------------------------------------------------------------------------

# Relative-depth levels, in category order.
DEPTH_LEVELS = ["surface", "epilimnion", "thermocline", "mid-depth", "hypolimnion"]

# Point sizes by depth: current profile, the upper-case v2 profile (adds N/A)
# and the v1 profile (no surface level).
DEPTH_SIZES = {"surface": 2.5, "epilimnion": 2.5, "thermocline": 4.0,
               "mid-depth": 4.0, "hypolimnion": 5.5}
DEPTH_SIZES_V2 = {"EPILIMNION": 2.5, "HYPOLIMNION": 5.5, "THERMOCLINE": 4.0,
                  "MID-DEPTH": 4.0, "N/A": 7.0}
DEPTH_SIZES_V1 = {"EPILIMNION": 2.5, "HYPOLIMNION": 5.5, "THERMOCLINE": 4.0,
                  "MID-DEPTH": 4.0}

# Detection-limit classes and the legend class of qualified rows.
DL_ABOVE = ">DL"
DL_BELOW = "<DL"
DL_MEASURED = "Measured value"
QUALIFIER_CLASS = "Qualifier"
NO_QUALIFIER = "None"

# Point shape codes: current profile, and v1/v2 (keyed by DL).
SHAPES = {"Measured value": 16, "<DL": 25, ">DL": 24, "Qualifier": 5}
SHAPES_V1 = {"Measured value": 16, "<DL": 17, ">DL": 17}

# Point image paths by legend class.
IMAGES = {"Measured value": "www/measured.png", "<DL": "www/below_dl.png",
          ">DL": "www/above_dl.png", "Qualifier": "www/above_dl.png"}

# Characters kept by the result strip step.
RESULT_KEEP_PATTERN = "[^0-9.<>=]"

# Trend settings: minimum measured rows for a linear model, the refresh
# interval in days, the padding of the value range, LOESS span, grid points
# of a fitted line and its confidence level.
MIN_MODEL_N = 8
# Fewest rows for which a local quadratic at the span below has three rows of
# positive weight (floor(0.8 * 5) = 4 nearest rows, the outermost of weight 0).
LOESS_MIN_N = 5
REFRESH_TTL_DAYS = 10
RANGE_PAD = 0.15
LOESS_SPAN = 0.8
LINE_POINTS = 80
CONF_LEVEL = 0.95

# Option-list caps of the selection inputs.
MAX_SITE_OPTIONS = 10000
MAX_PARAM_OPTIONS = 1000

# Display names of the data table, in column order.
DISPLAY_NAMES = ["Site", "Parameter", "Date", "Result", "Detection Limit",
                 "Qualifiers", "Relative Depth"]
PAGE_SIZE = 10
PAGE_SIZE_V1 = 15

# Message texts.
MSG_GAPS = "No data available for the following site-parameter combinations: "
MSG_NO_DATA = "No data available for selected sites and parameters."
MSG_NO_GROUP = ("No groups have 8 or more measured values. "
                "Linear model statistics are not available.")
MSG_LINEAR_NOTE = ("Note: Values below or above detection limits were excluded from "
                   "linear model analyses. Minimum of 8 samples required.")
MSG_LOESS_NOTE = ("LOESS is exploratory only. Detection limit values are included but "
                  "formal statistics are not applicable. Minimum of 8 samples required.")
MSG_CACHED = "Using cached database. Data available between"
MSG_RELOADED = "Using most recent version of the database:"
MSG_RELOADED_RANGE = "<br>Data available between "

# Column names of the legacy (first-version) source.
LEGACY_RENAMES = {"FinalResult": "WebResult", "Qualifiers": "Qualifier",
                  "RelativeDepthComments": "RelativeDepthSample"}
# Station key name on the server side.
SERVER_RENAMES = {"StationID": "SamplingPoint"}

# Station-metadata CSV header (water-quality exchange station export).
STATION_CSV_COLUMNS = [
    "Org_Identifier", "Org_FormalName", "ProviderName", "Location_Identifier",
    "Location_Name", "Location_Type", "Location_Description", "Location_State",
    "Location_CountryName", "Location_CountyName", "Location_CountryCode",
    "Location_StatePostalCode", "Location_CountyCode", "Location_HUCEightDigitCode",
    "Location_HUCTwelveDigitCode", "Location_TribalLandIndicator", "Location_TribalLand",
    "Location_Latitude", "Location_Longitude", "Location_HorzCoordReferenceSystemDatum",
    "Location_LatitudeStandardized", "Location_LongitudeStandardized",
    "Location_HorzCoordStandardizedDatum", "Location_SourceMapScale",
    "Location_HorzAccuracyMeasure", "Location_HorzAccuracyMeasureUnit",
    "Location_HorzCollectionMethod", "Location_VerticalMeasure",
    "Location_VerticalMeasureUnit", "Location_VerticalAccuracyMeasure",
    "Location_VerticalAccuracyMeasureUnit", "Location_VertCollectionMethod",
    "Location_VertCoordReferenceSystemDatum", "Location_WellType", "Location_AquiferType",
    "Location_NationalAquifer", "Location_LocalAquiferCode",
    "Location_LocalAquiferCodeContext", "Location_LocalAquifer",
    "Location_LocalAquiferDescription", "Location_AquiferFormationType",
    "Location_WellHoleDepthMeasure", "Location_WellHoleDepthUnit",
    "Location_WellContructionDate", "Location_WellDepthMeasure",
    "Location_WellDepthMeasureUnit", "Location_DrainageAreaMeasure",
    "Location_DrainageAreaMeasureUnit", "Location_ContributingDrainageAreaMeasure",
    "Location_ContributingDrainageAreaMeasureUnit", "AlternateLocation_IdentifierA",
    "AlternateLocation_IdentifierContextA", "AlternateLocation_IdentifierB",
    "AlternateLocation_IdentifierContextB", "AlternateLocation_IdentifierC",
    "AlternateLocation_IdentifierContextC",
]
STATION_CSV_DOUBLES = ["Location_Latitude", "Location_Longitude",
                       "Location_LatitudeStandardized", "Location_LongitudeStandardized"]

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

RESULTS_SCHEMA = T.StructType([
    T.StructField("SamplingPoint", T.StringType()),
    T.StructField("DateSampled", T.StringType()),
    T.StructField("WebParameter", T.StringType()),
    T.StructField("WebResult", T.StringType()),
    T.StructField("Qualifier", T.StringType()),
    T.StructField("RelativeDepthSample", T.StringType()),
])

STATIONS_SCHEMA = T.StructType([
    T.StructField("StationID", T.StringType()),
    T.StructField("Description", T.StringType()),
])

# Store layout: results keep DateType and a year column used for partition
# pruning of date filters.
STORE_RESULTS_SCHEMA = T.StructType([
    T.StructField("SamplingPoint", T.StringType()),
    T.StructField("DateSampled", T.DateType()),
    T.StructField("WebParameter", T.StringType()),
    T.StructField("WebResult", T.StringType()),
    T.StructField("Qualifier", T.StringType()),
    T.StructField("RelativeDepthSample", T.StringType()),
])

CLEAN_COLUMNS = ["SamplingPoint", "RelativeDepthComments", "DateSampled", "WebParameter",
                 "FinalResult", "Qualifiers", "Description", "DL", "legend_shape",
                 "SiteParam"]

STATION_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STATION_CSV_COLUMNS])
