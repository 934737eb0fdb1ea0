"""Order statistics of a table: consecutive numbers and single pages in a
total order, without sorting or storing the whole table.

``build_index`` reads the table twice: a random sample of bounded size gives
splitters of the order key (samples of parts merge into one of the whole, so
every task keeps only its share), and one grouped count gives the rows of each
range between splitters.  The index is small (``MOST_RANGES`` ranges at most)
and tells which range holds any row number:

* ``page_at`` filters that range, with bounds on the first order column that
  reach the scan, and orders only its rows: the last page costs what the first
  one does;
* ``number_rows`` numbers each range on its own and adds the rows before it.

Where many rows are equal they are counted before they are ordered and given
their numbers afterwards, so any number of copies is one row to the sort.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.functions.cleaning import once
from fieldlab.session import checkpoint_dir

RANGE_ROWS = 50_000      # rows aimed at in a range
MOST_RANGES = 1024        # more rows make the ranges longer, not the index
OVERSAMPLE = 8           # sampled rows per range


def _names(columns) -> list[str]:
    return [f"`{c}`" for c in columns]


def _literal(value, kind: T.DataType) -> str:
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    return f"CAST(CAST(X'{str(value).encode('utf-8').hex()}' AS STRING) AS {kind.simpleString()})"


def _key(columns) -> Column:
    """The order columns as one comparable value (nulls first)."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(_names(columns))])


@dataclass(frozen=True)
class OrderIndex:
    """Range i holds the keys above splitter i - 1 up to splitter i."""

    order: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    splitters: tuple[tuple, ...]
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)

    def before(self) -> list[int]:
        """Rows in front of each range."""
        return [0, *accumulate(self.counts)][:-1]

    def pages(self, size: int) -> int:
        return -(-self.rows // size)

    def splitter(self, i: int) -> str:
        """Splitter i as SQL text."""
        return f"named_struct({', '.join(f"'k{j}', {_literal(v, t)}" for j, (v, t) in enumerate(zip(self.splitters[i], self.kinds)))})"

    def range_of(self) -> Column:
        """The range of a row: how many splitters are below its key, by binary search."""
        if not self.splitters:
            return F.lit(0)
        array, key = F.expr(f"array({', '.join(map(self.splitter, range(len(self.splitters))))})"), _key(self.order)
        steps = [1 << b for b in range(len(self.splitters).bit_length() - 1, -1, -1)]
        # The key is computed once a row, not at every step.
        return once(key, lambda k: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                                               lambda low, s: F.when(F.get(array, low + s - 1) < k, low + s).otherwise(low)))


def build_index(df: DataFrame, order=None, rows_per_range: int = RANGE_ROWS, most: int = MOST_RANGES) -> OrderIndex:
    """The order index of a table (order: all columns unless given)."""
    order = list(order or df.columns)
    names, rows = _names(order), Observation()
    # Rows with the smallest random numbers: every task keeps its own, and they are merged.
    seen = df.select(*names).observe(rows, F.count(F.lit(1)).alias("n"))
    some = seen.orderBy(F.rand(17)).limit(most * OVERSAMPLE)
    sample = [tuple(r) for r in some.orderBy(*[F.col(c).asc_nulls_first() for c in names]).collect()]
    ranges = min(most, -(-rows.get["n"] // rows_per_range))
    splitters = [sample[len(sample) * i // ranges] for i in range(1, ranges)]
    index = OrderIndex(tuple(order), tuple(df.schema[c].dataType for c in order), tuple(dict.fromkeys(splitters)), ())
    found = dict(df.groupBy(index.range_of().alias("r")).count().collect())
    return OrderIndex(index.order, index.kinds, index.splitters, tuple(found.get(i, 0) for i in range(len(index.splitters) + 1)))


def _ascending(index: OrderIndex, prefix: str = "") -> list[Column]:
    return [F.col(prefix + c).asc_nulls_first() for c in _names(index.order)]


def _copies(df: DataFrame, *also: str) -> DataFrame:
    """Distinct rows as a struct, with their copies (counted before the shuffle)."""
    row = F.struct(*[F.col(c) for c in _names(c for c in df.columns if c not in also)])
    return df.select(row.alias("row"), *also).groupBy("row", *also).agg(F.count(F.lit(1)).alias("copies"))


def number_rows(df: DataFrame, order=None, out: str = "row_id", index: OrderIndex | None = None,
                hot_rows: int = 8 * RANGE_ROWS) -> DataFrame:
    """Attach consecutive numbers 1..N in the total order of the columns
    (equal rows get consecutive numbers).  ``index`` must be of these rows; it
    is built when not given.  Every range is ordered by a task of its own; in
    ranges of more than ``hot_rows`` rows and four times the average, which
    many equal keys make, equal rows are counted first and given their numbers
    after the ordering."""
    index = index or build_index(df, order)
    hot = [i for i, n in enumerate(index.counts) if n > max(hot_rows, 4 * index.rows / len(index.counts))]
    ahead = F.expr(f"array({', '.join(f'{b}L' for b in index.before())})")
    tagged = df.withColumn("_range", index.range_of())
    some = tagged.where(~F.col("_range").isin(hot)) if hot else tagged
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*_ascending(index)))
    numbered = some.withColumn(out, at + F.get(ahead, F.col("_range"))).drop("_range")
    if not hot:
        return numbered
    upto = Window.partitionBy("_range").orderBy(*_ascending(index, "row.")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _copies(tagged.where(F.col("_range").isin(hot)), "_range")
    rows = rows.withColumn("upto", F.sum("copies").over(upto) + F.get(ahead, F.col("_range")))
    ids = F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto")))
    return numbered.unionByName(rows.select("row", ids.alias("id")).select("row.*", F.col("id").alias(out)))


def page_at(df: DataFrame, index: OrderIndex, page: int, size: int) -> DataFrame:
    """The rows of page ``page`` (0-based) of ``size`` rows, in order.  Only
    the ranges that hold them are ordered."""
    first, last = page * size, min((page + 1) * size, index.rows)
    if page < 0 or first >= last:
        return df.limit(0)
    before = index.before()
    lo, hi = bisect_right(before, first) - 1, bisect_right(before, last - 1) - 1
    lead, key, some = F.col(_names(index.order)[0]), _key(index.order), df
    if lo > 0:
        if index.splitters[lo - 1][0] is not None:
            some = some.where(lead >= F.expr(_literal(index.splitters[lo - 1][0], index.kinds[0])))
        some = some.where(key > F.expr(index.splitter(lo - 1)))
    if hi < len(index.splitters):
        if index.splitters[hi][0] is not None:
            some = some.where(lead.isNull() | (lead <= F.expr(_literal(index.splitters[hi][0], index.kinds[0]))))
        some = some.where(key <= F.expr(index.splitter(hi)))
    # The distinct rows of a range or two, not of the table, go through this window.
    upto = Window.orderBy(*_ascending(index, "row.")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _copies(some).withColumn("upto", F.sum("copies").over(upto) + before[lo])
    shown = F.least("upto", F.lit(last)) - F.greatest(F.col("upto") - F.col("copies"), F.lit(first))
    rows = rows.withColumn("shown", shown).where(F.col("shown") > 0)
    return (rows.select("row", "upto", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shown"))))
            .orderBy("upto").select("row.*"))


def in_locale(column: str, locale: str | None) -> list[Column]:
    """Ascending sort keys of a text column: in binary order, or as a collation
    has it ('UNICODE', or a language such as 'de' or 'sv'), equal texts of the
    collation in binary order."""
    c = F.col(f"`{column}`")
    return [c] if locale is None else [F.collate(c, locale), c]


def number_options(df: DataFrame, order, out: str, locale: str | None = None) -> DataFrame:
    """Consecutive numbers of a short list (options, factor levels) in one pass
    over its source, without a global window.

    The frame is range-partitioned and sorted, tagged with
    ``monotonically_increasing_id`` (partition index in the high bits) and
    checkpointed to the shared checkpoint folder so both passes see the same
    rows; per-partition counts (one row per partition) give the offsets."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    tagged = (df.orderBy(*[k.asc_nulls_first() for c in order for k in in_locale(c, locale)])
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.join(F.broadcast(offsets), pid == F.col("_pid"), "inner")
            .withColumn(out, F.col("_off") + local + 1)
            .drop("_mid", "_pid", "_off"))
