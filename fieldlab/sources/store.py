"""Which loads of the store count, and what is kept about each of them.

Beside ``results/ingest_batch=<load>`` the store holds

* ``zones/ingest_batch=<load>``: rows, first and last sample date per year;
* ``moments/ingest_batch=<load>``: mergeable regression sums per series;
* ``merges/<merged load>.json``: the loads that a merged load replaces.

Coverage dates, freshness and linear statistics are answered from the small
tables, without the results.  Writing a load first removes what is kept about
it, so after a failure an entry is missing, never wrong; ``zones`` and
``moments`` make missing entries from the load's rows.

``merge_loads`` writes the rows of many small loads as one.  The merged load
counts once its marker file is there, and from then on its sources do not: a
reader sees the one or the others.  A replay of a replaced load writes its
folder again, and it still does not count.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators import moments as M
from fieldlab.operators.clean import clean
from fieldlab.operators.select import RAW_COLUMNS
from fieldlab.sources import files, sinks
from fieldlab.sources.sinks import MOMENTS, ZONES

LOAD = "ingest_batch="
MERGED = "merge-"
MERGES = "merges"


def _names(spark: SparkSession, path: str) -> set[str]:
    return {c[len(LOAD):] for c in files.children(spark, path) if c.startswith(LOAD)}


def merges(spark: SparkSession, store: str) -> dict[str, list[str]]:
    """Merged load -> the loads it replaces."""
    folder = f"{store.rstrip('/')}/{MERGES}"
    return {c[:-len(".json")]: json.loads(files.get_text(spark, f"{folder}/{c}"))
            for c in files.children(spark, folder) if c.endswith(".json") and not c.startswith(".")}


def loads(spark: SparkSession, store: str) -> list[str]:
    """The loads that count (one listing of load folders, not of their files)."""
    marked = merges(spark, store)
    replaced = {s for sources in marked.values() for s in sources}
    return sorted(t for t in _names(spark, sinks.results_path(store))
                  if t not in replaced and (not t.startswith(MERGED) or t in marked))


def _only(spark: SparkSession, path: str, tags) -> DataFrame:
    """The table at ``path`` for the given loads (folders of others are pruned)."""
    df = spark.read.parquet(path)
    tags = set(tags)
    return df if tags >= _names(spark, path) else df.where(F.col("ingest_batch").isin(sorted(tags)))


def read_results(spark: SparkSession, store: str) -> DataFrame:
    """The stored results of the loads that count."""
    return _only(spark, sinks.results_path(store), loads(spark, store))


def _load_rows(spark: SparkSession, store: str, tag: str) -> DataFrame:
    base = sinks.results_path(store)
    return spark.read.option("basePath", base).parquet(f"{base}/{LOAD}{tag}").drop("ingest_batch")


def _empty(spark: SparkSession, store: str, tag: str) -> bool:
    """A load without rows has no year folder, so Spark cannot infer its columns."""
    return not any(not c.startswith(("_", ".")) for c in files.children(spark, f"{sinks.results_path(store)}/{LOAD}{tag}"))


def zone_rows(rows: DataFrame) -> DataFrame:
    """Per year of sampling: rows, first and last date."""
    return rows.groupBy("sample_year").agg(F.count(F.lit(1)).alias("n"), F.min("DateSampled").alias("min_date"),
                                           F.max("DateSampled").alias("max_date"))


def moment_rows(rows: DataFrame) -> DataFrame:
    """Regression sums per series of a load's measured values (as stored: rows
    that a duplicate station would repeat in the joined retrieval count once)."""
    return M.partial_moments(clean(rows.select(*RAW_COLUMNS)))


def _write(spark: SparkSession, store: str, what: str, tag: str) -> None:
    path = f"{store.rstrip('/')}/{what}/{LOAD}{tag}"
    if _empty(spark, store, tag):
        some = {ZONES: "sample_year int, n long, min_date date, max_date date", MOMENTS: M.SCHEMA}[what]
        spark.createDataFrame([], some).write.mode("overwrite").parquet(path)
        return
    rows = _load_rows(spark, store, tag)
    (zone_rows(rows) if what == ZONES else moment_rows(rows)).write.mode("overwrite").parquet(path)


def _kept(spark: SparkSession, store: str, what: str, tags) -> DataFrame:
    path = f"{store.rstrip('/')}/{what}"
    for tag in sorted(set(tags) - _names(spark, path)):
        _write(spark, store, what, tag)
    return _only(spark, path, tags)


def zones(spark: SparkSession, store: str, exclude=()) -> DataFrame:
    """ingest_batch, sample_year, n, min_date, max_date of the loads that
    count; entries that are missing are made first."""
    return _kept(spark, store, ZONES, [t for t in loads(spark, store) if t not in set(exclude)])


def moments(spark: SparkSession, store: str) -> DataFrame:
    """Regression sums per series over all loads that count."""
    return M.merged(_kept(spark, store, MOMENTS, loads(spark, store)))


def merge_loads(spark: SparkSession, store: str, name: str, tags=None, partitions: int | None = None) -> str | None:
    """Write the rows of ``tags`` (default: all stream loads that count) as the
    load ``merge-<name>`` and let it replace them.  Returns the merged load, or
    None if there are fewer than two to merge.  A run that failed before its
    marker was written is repeated under the same name."""
    live = loads(spark, store)
    tags = sorted(t for t in live if t.startswith("stream-")) if tags is None else sorted(tags)
    if len(tags) < 2:
        return None
    if unknown := set(tags) - set(live):
        raise ValueError(f"not loads of the store: {sorted(unknown)}")
    merged = f"{MERGED}{name}"
    if merged in merges(spark, store):
        raise ValueError(f"{merged} is there already")
    base = sinks.results_path(store)
    full = [t for t in tags if not _empty(spark, store, t)]
    if full:
        rows = spark.read.option("basePath", base).parquet(*[f"{base}/{LOAD}{t}" for t in full]).drop("ingest_batch")
        sinks.write_results(rows, store, merged, partitions)
    files.put_text(spark, f"{store.rstrip('/')}/{MERGES}/{merged}.json", json.dumps(tags))
    return merged


def drop_replaced(spark: SparkSession, store: str) -> list[str]:
    """Remove the folders of loads that merged loads replaced, once no reader
    uses them; the markers stay, so replays still do not count."""
    gone = sorted({s for sources in merges(spark, store).values() for s in sources})
    for tag in gone:
        sinks.forget(spark, store, tag)
        files.remove(spark, f"{sinks.results_path(store)}/{LOAD}{tag}")
    return gone
