"""Option search from an index kept with the store.

The index lists, for every option, the grams of one to three characters of its
lower-case text, sorted by gram.  A search text of up to three characters is a
gram itself; a longer one is looked up by its grams of three, the options that
have them all are candidates, and ``contains`` decides.  A search reads the
row groups of its grams, not the options or the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 3


def _grams(text, size: int):
    n = F.length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))) \
        .otherwise(F.array().cast("array<string>"))


def build_search_index(options: DataFrame, col: str, path: str, partitions: int | None = None) -> None:
    """Write the index of a column's distinct values (NULL is no option)."""
    text = F.lower(F.col("value"))
    rows = (options.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
            .select("value", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(text, k) for k in range(1, LONGEST + 1)])))
                    .alias("gram")))
    # The option is part of the range key, so a gram that many options share is split.
    keys = ["gram", "value"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def search(spark: SparkSession, path: str, text: str, col: str, limit: int | None = None) -> DataFrame:
    """Options that contain ``text`` (case-insensitive), sorted."""
    want = text.lower()
    grams = sorted({want[i:i + LONGEST] for i in range(len(want) - LONGEST + 1)}) or [want]
    rows = spark.read.parquet(path).where(F.col("gram").isin(grams))
    if len(grams) > 1:
        rows = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    found = rows.where(F.lower("value").contains(want)).select(F.col("value").alias(col)).orderBy(col)
    return found if limit is None else found.limit(limit)
