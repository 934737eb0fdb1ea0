"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fieldlab.llm import (op1_quality, op2_secrets, op3_substring, op4_simhash, op5_bpe, op6_toxicity, op7_licenses,
                          op8_packing, op9_language, op10_exact, op11_runs, op12_sentencepiece, op13_spelling)
from fieldlab.llm.common import table
from fieldlab.llm.sql import SQL  # noqa: F401


def op1(spark, sf_dir):
    return op1_quality.rules(table(spark, sf_dir, "documents"))


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op2_secrets.scan(docs, op2_secrets.fit(docs))


def op3(spark, sf_dir):
    return op3_substring.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4(spark, sf_dir):
    return op4_simhash.near_dedup(table(spark, sf_dir, "documents"))


def op5(spark, sf_dir):
    proto = op5_bpe.model_proto(op5_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return op5_bpe.round_trip(table(spark, sf_dir, "documents"), proto, public_tokenizers.PATTERN)


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = op6_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return (op6_toxicity.tag(docs, field).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans")))


def op7(spark, sf_dir):
    return op7_licenses.scan(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return op8_packing.pack(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op9_language.identify(docs, op9_language.fit(docs))


def op10(spark, sf_dir):
    return op10_exact.dedup(table(spark, sf_dir, "documents"))


def op11(spark, sf_dir):
    found = op11_runs.detect(op11_runs.with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12(spark, sf_dir):
    model = op12_sentencepiece.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return op12_sentencepiece.round_trip(table(spark, sf_dir, "documents"), model)


def op13(spark, sf_dir):
    words = op13_spelling.with_slips(op13_spelling.runs(table(spark, sf_dir, "documents")))
    return op13_spelling.variants(op13_spelling.counts(words))


QUERIES = {"op1_quality_rules": op1, "op2_secret_scan": op2, "op3_suffix_dedup": op3, "op4_simhash": op4, "op5_byte_bpe": op5,
           "op6_toxicity": op6, "op7_license_scan": op7, "op8_packing": op8, "op9_language": op9, "op10_exact_dedup": op10,
           "op11_period_runs": op11, "op12_sentencepiece": op12, "op13_spelling": op13}
