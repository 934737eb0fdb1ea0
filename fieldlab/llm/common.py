"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlab.session import checkpoint_dir

# Java regex class of the white space that separates words: space, \t to \r.
JAVA_WS = r"[ \t-\r]+"


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, as when the
    job runs from a checkout; installed packages need nothing."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    importable(docs.sparkSession)
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """The rows with all their columns inside one struct ``row``, so that no
    working column can clash with a column of the input."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``: small
    intermediate tables that are read more than once survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def may_hold(keys: DataFrame, column: str, most_bits: int = 1 << 29) -> Callable[[pa.Array], np.ndarray]:
    """A test whether numbers may be among the ``keys`` of a long column (true
    for all of them, false for most others), to leave rows out of a shuffle.  One bit
    per hash of a key, about 16 bits a key and never more than ``most_bits``
    (64 MB): with very many keys it lets more rows through, never fewer."""
    spark = keys.sparkSession
    importable(spark)
    bits = 1 << 10
    while bits < min(16 * keys.count(), most_bits):
        bits *= 2
    place = F.pmod(F.col(column), F.lit(bits))
    words = (keys.select(F.shiftright(place, 5).alias("w"), (place % 32).cast("int").alias("b"))
             .select("w", F.expr("shiftleft(1L, b)").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    table = np.zeros(bits // 32, np.int64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def found(keys: pa.Array) -> np.ndarray:
        at = keys.to_numpy(zero_copy_only=False) % bits
        return (shared.value[at >> 5] >> (at & 31)) & 1 == 1

    return found


def holding(found: Callable[[pa.Array], np.ndarray], column: str) -> Column:
    """The test as a condition on a column."""
    @F.arrow_udf("boolean")
    def holds(keys: pa.Array) -> pa.Array:
        return pa.array(found(keys))

    return holds(column)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text has remainder 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], added: str,
              keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """One output row per input row: the ``keep`` columns as they are, and the
    ``added`` columns (a DDL string) that the function built by ``make()`` in
    the Python worker returns for a batch of texts (null: empty) as a list of
    columns.  Narrow: no shuffle, one Arrow batch in memory at a time."""
    importable(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    new = T._parse_datatype_string(added)
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                texts = ["" if t is None else t for t in b.column(len(keep)).to_pylist()]
                cols = [pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(work(texts))]
                kept = [b.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + cols, schema=arrow)

    return df.select(*keep, text).mapInArrow(run, schema)
