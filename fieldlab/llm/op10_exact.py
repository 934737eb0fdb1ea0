"""Exact dedup by content sort, in DataFrame operations only.

Texts are normalised by deleting white space.  Sampled splitters
range-partition them by their first bytes, then their digest (so that the
splitters stay short, and texts that begin alike are still split), Spark's
external sort places equal texts next to each other, and neighbours are
compared in full: where a text differs from the one before, a new run begins.
Of each run the longest original stays, then the smallest id.  The digest only
places the rows; texts of one digest that differ are different runs.

A text that a large part of the rows share would put one run into one task.
Digests are counted first (with map-side combination); the texts of digests
with over ``hot_share`` of the rows or ``salt_bytes`` of text carry salts in
the sort key, as many as keep a salt's rows below both, and the partial runs
of a text, one row of each, are then combined by their full text.

Defined results: null counts as empty, and empty or white-space texts are
equal to each other; a null id is larger than any other; of rows that repeat
both id and text of the winner one stays; an empty table gives no rows; only
the named id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlab.llm.common import JAVA_WS, cut_lineage, text_of
from fieldlab.operators.joins import bounded_broadcast


HEAD = 32                # leading characters of a text in the sort key


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, JAVA_WS, "")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def dedup(docs: DataFrame, hot_share: float = 1e-3, salt_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = cut_lineage(_runs(docs, hot_share, salt_bytes, doc_id, text, []))
    return _resolved(runs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, hot_share: float = 1e-3, salt_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows, with all columns as they were."""
    runs = _runs(docs, hot_share, salt_bytes, doc_id, text, [F.struct(*[docs[c] for c in docs.columns]).alias("row")])
    # The first row of an unsalted run stays; only the salted runs of a hot
    # text have several candidates, of which the combined winner stays.
    first = cut_lineage(runs.where("first"))
    hot = _resolved(first.where("salt >= 0")).where("kept")
    return first.where("salt < 0").select("row.*").unionByName(hot.select("row.*"))


def _runs(docs, hot_share, salt_bytes, doc_id, text, carried) -> DataFrame:
    """Content-sorted rows without their texts: head, sha, salt, ``run`` (number
    of the run among those of this head, digest and salt), ``first`` (the run's winner),
    and for the winners of salted runs the text, ``shared``."""
    body = text_of(docs, text)
    norm = normalised(body)
    total = docs.count()
    # Digests are small and counted with map-side combination.
    most = max(1.0, hot_share * total)
    n, size = F.count("*"), F.sum(F.octet_length("norm"))
    salts = F.greatest(F.ceil(n / most), F.ceil(size / salt_bytes)).cast("int")
    hot = (docs.select(norm.alias("norm")).select("norm", digest(F.col("norm")).alias("sha")).groupBy("sha")
           .agg(salts.alias("salts")).where("salts > 1"))
    texts = docs.select(docs[doc_id].alias("doc_id"), F.length(body).cast("long").alias("chars"), norm.alias("norm"),
                        F.monotonically_increasing_id().alias("at"), *carried)
    salt = F.coalesce(F.pmod(F.xxhash64("at"), F.col("salts")).cast("int"), F.lit(-1)).alias("salt")
    names = [c for c in texts.columns if c != "at"]
    salted = (texts.select("*", digest(F.col("norm")).alias("sha")).join(bounded_broadcast(cut_lineage(hot)), "sha", "left")
              .select("sha", salt, *names))
    # Range partitioning by the leading keys already brings equal texts
    # together: the window sorts its partitions and adds no shuffle of its own.
    ranged = salted.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange("head", "sha", "salt")
    order = W.partitionBy("head", "sha", "salt").orderBy("norm", F.desc("chars"), F.col("doc_id").asc_nulls_last())
    ranged = ranged.withColumn("first", F.coalesce(F.lag("norm").over(order) != F.col("norm"), F.lit(True)))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = ranged.withColumn("run", F.sum(F.col("first").cast("int")).over(upto))
    return ranged.withColumn("shared", F.when(F.col("first") & (F.col("salt") >= 0), F.col("norm"))).drop("norm")


def _resolved(runs: DataFrame) -> DataFrame:
    """Group sizes and winners over the salts of a text.  The rows are joined
    by (head, digest, salt, run), so that a hot text stays spread over its salts."""
    key = ["head", "sha", "salt", "run"]
    best = F.min(F.when(F.col("first"), F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "head", "salt", "run")))
    parts = runs.groupBy(*key).agg(F.count("*").alias("n"), best.alias("best"), F.max("shared").alias("shared"))
    # An unsalted run is a group by itself; partial runs meet by their text.
    text = F.coalesce("shared", F.concat("run", F.lit(" "), "head"))
    groups = parts.groupBy("sha", text.alias("same")).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    winners = (parts.select(*key, text.alias("same")).join(groups, ["sha", "same"])
               .select(*key, "group_size", F.col("best.doc_id").alias("keep_id"), F.struct("best.head", "best.salt", "best.run").alias("winner")))
    here = F.struct("head", "salt", "run") == F.col("winner")
    return runs.join(winners, key).withColumn("kept", F.col("first") & here)
