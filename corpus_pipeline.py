"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``:

1. quality rules: rejected documents go;
2. exact dedup: one row of each group of equal texts stays;
3. SimHash near-dedup: one document of each component stays;
4. secret scan: secrets are replaced in the text (``n_chars`` follows it);
5. packing: the pieces of the training sequences.

An empty table passes through every stage; null texts and other awkward rows
have the results that the operators' docstrings state.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import op1_quality, op2_secrets, op4_simhash, op8_packing, op10_exact
from fieldlab.llm.common import table
from fieldlab.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_exact.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_simhash.keep_one(docs, shingle=3, radius=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = op2_secrets.redact(docs, op2_secrets.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return op8_packing.pack(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("secret scan", secrets), ("packing", packing)]

# Tokenizing, fingerprints and the trained models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what lies between them is written to the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
