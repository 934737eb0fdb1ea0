"""Column expressions for cleaning lab results.

Every function takes and returns a ``Column`` built from built-in Spark
functions, so the whole cleaning pipeline stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab import schema as S

# Whitespace removed by R-style trimming: space, tab, CR, LF.
_WS = " \t\r\n"
# A plain decimal number as the stripped text can hold it: digits with an
# optional point, or a point followed by digits.
_PLAIN_NUMBER = r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"
# A signed decimal with an optional exponent (parse without the strip step).
_SIGNED_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rtrim_ws(col) -> Column:
    """Trim space, tab, CR and LF on both ends (Spark ``trim`` only trims spaces)."""
    return F.btrim(_c(col), F.lit(_WS))


def to_sample_date(col) -> Column:
    """Text or timestamp -> date.  Accepts ``yyyy-MM-dd`` (with an optional
    time part) and ``yyyy/MM/dd``; anything else is NULL."""
    c = _c(col)
    # The cast alone would also take a year, or a year and a month.
    full = c.cast("string").rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ].*)?$")
    return F.coalesce(F.when(full, c.try_cast("date")),
                      F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyy/MM/dd"))))


# Fixed forms that text dates are tried in, in this order.
DATE_FORMS = ("-", "/")


def _in_form(c: Column, mark: str) -> Column:
    """Date of a text that begins with year, month and day around ``mark``."""
    part = lambda i: F.regexp_extract(c, rf"^\s*(\d{{1,4}}){mark}(\d{{1,2}}){mark}(\d{{1,2}})", i)
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(part(1), 4, "0"), part(2), part(3)), F.lit("yyyy-M-d")))


def column_dates(df: DataFrame, col: str, position: str) -> DataFrame:
    """A text date column read in one form throughout: the form of its first
    non-missing value by ``position`` (load order).  Values of the other form
    become NULL; without any value all are NULL; a first value of neither form
    is an error.  The first value is one grouped minimum."""
    first = df.where(F.col(col).isNotNull()).agg(F.min_by(F.col(col).cast("string"), position).alias("v"))
    forms = first.select(F.col("v").isNotNull().alias("any"), *[_in_form(F.col("v"), m).isNotNull().alias(m) for m in DATE_FORMS]).first()
    mark = next((m for m in DATE_FORMS if forms[m]), None)
    if mark is None and forms["any"]:
        raise ValueError(f"the first value of {col} is not a date")
    return df.withColumn(col, _in_form(F.col(col).cast("string"), mark) if mark else F.lit(None).cast("date"))


def strip_result(col) -> Column:
    """Keep only digits, '.', '<', '>' and '='.  Signs, exponents and units go."""
    return F.regexp_replace(_c(col).cast("string"), S.RESULT_KEEP_PATTERN, "")


def dl_class(stripped) -> Column:
    """Detection-limit class from the first character; NULL is a measured value."""
    c = _c(stripped)
    return (F.when(c.startswith(">"), F.lit(S.DL_ABOVE))
            .when(c.startswith("<"), F.lit(S.DL_BELOW))
            .otherwise(F.lit(S.DL_MEASURED)))


def parse_number(text, pattern: str = _PLAIN_NUMBER) -> Column:
    """Numeric parse that yields NULL for anything that is not a number."""
    c = _c(text)
    return F.when(c.rlike(pattern), c.try_cast("double"))


def parse_result(stripped, nondetect: str = "full") -> Column:
    """Censored text -> number.  One leading '<' or '>' is removed before the
    parse; ``nondetect='half'`` halves '<' values (the older versions' rule)."""
    if nondetect not in ("full", "half"):
        raise ValueError("nondetect must be 'full' or 'half'")
    c = _c(stripped)
    value = parse_number(F.regexp_replace(c, "^[<>]", ""))
    if nondetect == "half":
        return F.when(c.startswith("<"), value / 2).otherwise(value)
    return value


def parse_result_raw(text, nondetect: str = "half") -> Column:
    """Parse without the strip step (first version): trimmed text with an
    optional sign and exponent; units or commas make it NULL."""
    c = _c(text).cast("string")
    body = rtrim_ws(F.regexp_replace(c, "^[<>]", ""))
    value = parse_number(body, _SIGNED_NUMBER)
    if nondetect == "half":
        return F.when(c.startswith("<"), value / 2).otherwise(value)
    return value


def qualifier_or_none(col, keep_null: bool = False) -> Column:
    """Empty qualifier -> 'None'; NULL too unless ``keep_null`` (first version)."""
    c = _c(col)
    if keep_null:
        return F.when(c == "", F.lit(S.NO_QUALIFIER)).otherwise(c)
    return F.when(c.isNull() | (c == ""), F.lit(S.NO_QUALIFIER)).otherwise(c)


def depth_label(col, profile: str = "current") -> Column:
    """Relative-depth text.  current: trimmed lower case, blank -> 'surface';
    v2: upper case, blank -> 'N/A'; v1: upper case, blank -> NULL."""
    t = rtrim_ws(_c(col))
    blank = t.isNull() | (t == "")
    if profile == "current":
        return F.when(blank, F.lit("surface")).otherwise(F.lower(t))
    if profile == "v2":
        return F.when(blank, F.lit("N/A")).otherwise(F.upper(t))
    if profile == "v1":
        return F.when(blank, F.lit(None).cast("string")).otherwise(F.upper(t))
    raise ValueError(f"unknown profile {profile!r}")


def depth_category(col) -> Column:
    """Keep only the five depth levels; anything else is NULL."""
    c = _c(col)
    return F.when(c.isin(*S.DEPTH_LEVELS), c)


def depth_rank(col) -> Column:
    """1-based position of the depth level (NULL outside the levels)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in S.DEPTH_LEVELS]), _c(col))
    return F.when(pos > 0, pos.cast("int"))


def legend_class(qualifiers, dl) -> Column:
    """A qualified row is drawn as 'Qualifier' whatever its DL class."""
    return F.when(_c(qualifiers) != S.NO_QUALIFIER, F.lit(S.QUALIFIER_CLASS)).otherwise(_c(dl))


def series_key(site="SamplingPoint", param="WebParameter") -> Column:
    """'site - parameter'; a missing part is written 'NA' as R's paste does."""
    return F.concat_ws(" - ", F.coalesce(_c(site), F.lit("NA")), F.coalesce(_c(param), F.lit("NA")))


def date_text(col, fmt: str = "yyyy-MM-dd") -> Column:
    """Date as text (ISO by default; 'MM-dd-yyyy' in messages and v1 labels)."""
    return F.date_format(_c(col), fmt)


def fixed_decimals(col, digits: int) -> Column:
    """'%.Nf' text; NULL is written 'NA'."""
    return F.coalesce(F.format_string(f"%.{digits}f", _c(col)), F.lit("NA"))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row.  Written out, an
    expression is computed again at every mention inside conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_text(col) -> Column:
    """A double as R pastes it: up to 15 significant digits, in fixed form
    unless the scientific form is shorter; NULL is 'NA'."""
    def parts(sci):
        digits = F.rtrim(F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 14)), F.lit("0"))
        return F.struct(digits.alias("digits"), F.length(digits).alias("n"), F.substr(sci, F.lit(18)).try_cast("int").alias("e"))

    def written(p):
        digits, n, e = p["digits"], p["n"], p["e"]
        places = F.greatest(n - 1 - e, F.lit(0))
        fixed_width = F.greatest(e, F.lit(0)) + 1 + F.when(places > 0, places + 1).otherwise(0)
        sci_width = n + F.when(n > 1, 1).otherwise(0) + F.when(F.abs(e) >= 100, 5).otherwise(4)
        fixed = (F.when(e >= n - 1, F.concat(digits, F.repeat(F.lit("0"), e - n + 1)))
                 .when(e >= 0, F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
                 .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)))
        mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 14))).otherwise(digits)
        power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(e).cast("string"), F.when(F.abs(e) < 100, 2).otherwise(3), F.lit("0")))
        return F.when(fixed_width <= sci_width, fixed).otherwise(F.concat(mantissa, power))

    def trimmed(t):
        return F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))

    # The shortest text of a double has its digits already when they are at
    # most 15; only longer ones have to be rounded (``written``).
    def plain(s):
        return F.when(F.length(s) <= 16, trimmed(s))

    def small(s):
        m = F.substring_index(s, "E", 1)
        return F.when(F.length(m) <= 16, F.concat(trimmed(m), F.lit("e-"), F.lpad(F.substring_index(s, "-", -1), 2, "0")))

    def whole(s):
        digits, e = F.rtrim(s, F.lit("0")), F.length(s) - 1
        point = F.when(F.length(digits) > 1, F.lit(".")).otherwise(F.lit(""))
        return (F.when(e < F.length(digits) + F.length(point) + 4, s)
                .otherwise(F.concat(F.substring(digits, 1, 1), point, F.substring(digits, 2, 14), F.lit("e+"), F.lpad(e.cast("string"), 2, "0"))))

    c = _c(col).cast("double")
    size = F.abs(c)
    short = (F.when((size >= 1e-3) & ((size < 1e5) | ((size < 1e7) & (size != F.rint(size)))), once(size.cast("string"), plain))
             .when((size >= 1e5) & (size < 1e15) & (size == F.rint(size)), once(size.cast("long").cast("string"), whole))
             .when((size >= 1e-98) & (size < 1e-4), once(size.cast("string"), small)))
    finite = F.coalesce(short, once(once(F.format_string("%.14e", size), parts), written))
    return (F.when(c.isNull(), F.lit("NA")).when(F.isnan(c), F.lit("NaN")).when(c == 0, F.lit("0"))
            .when(size == float("inf"), F.when(c < 0, F.lit("-Inf")).otherwise(F.lit("Inf")))
            .otherwise(F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), finite)))


def na_text(col) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit("NA"))


def days_since_epoch(col) -> Column:
    """Date -> days since 1970-01-01 as double (the regression x)."""
    return F.unix_date(_c(col)).cast("double")
