"""License scan by diagonal voting.

Every word k-gram of every document is hashed with a rolling polynomial and
joined by Spark with the (bounded, broadcast) k-gram positions of the license
templates.  A hit at document word p and template word q votes for the
diagonal p - q.  Votes are counted per (document, template, diagonal), hits on
neighbouring diagonals (words added or left out) are merged into one span, and
a span is verified by the words themselves.

Defined results: null counts as empty: no words, no places, labels empty,
score 0; a label occurs once however often its text repeats; repeated rows are
scanned alike, each on its own; equal scores do not matter, the maximum is
kept; only the named id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlab.llm.common import cut_lineage, text_of

K = 4                    # words of a k-gram
SLACK = 3                # diagonals that far apart are neighbours
COVER = 0.6              # share of a template's words that a verified span matches
ALPHA = np.uint64(0x9E3779B97F4A7C15)

# Phrases of the base scan and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Public notices that licenses ask to be given, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike International License."),
]

OWN = [("r", "long"), ("doc_id", ""), ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string")]

# Bytes that separate words once A-Z is lower case: \x00-\x2F \x3A-\x60 \x7B-\x7F.
_SPLIT = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; the separators are all single bytes in UTF-8."""
    return text.encode("utf-8").lower().translate(_SPLIT).split()


def gram_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """Rolling polynomial hash modulo 2^64 of every k-gram."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) * np.uint64(0xFF51AFD7ED558CCD)
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * ALPHA + w[j:j + n]
    h ^= h >> np.uint64(31)
    return h.view(np.int64)


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every phrase in the words, given as joined with
    single spaces and one at each end; sorted."""
    out = []
    for phrase, label in PHRASES:
        key, at = f" {phrase} ".encode(), -1
        while (at := joined.find(key, at + 1)) >= 0:
            out.append((joined.count(b" ", 0, at), label))
    return sorted(out)


def verified(words: list[bytes], template: list[bytes], lo: int, hi: int) -> float:
    """Share of the template's words that the span holds in order (longest
    common subsequence; both sides are bounded by the template's length)."""
    span = words[max(0, lo):hi]
    best = [0] * (len(template) + 1)
    for w in span:
        before = 0
        for j, t in enumerate(template, 1):
            before, best[j] = best[j], max(best[j], best[j - 1], before + 1 if w == t else 0)
    return best[-1] / len(template)


def template_grams(spark: SparkSession, templates, k: int = K) -> DataFrame:
    rows = [(int(h), t, q) for t, (_, text) in enumerate(templates) for q, h in enumerate(gram_hashes(words_of(text), k))]
    return spark.createDataFrame(rows, "h long, template int, q int")


def scan(docs: DataFrame, templates=None, k: int = K, slack: int = SLACK, cover: float = COVER,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels``, ``score`` (the largest verified
    share; 1 with a base place), ``n_spans`` (verified spans), ``spans``
    (label:first word:end word, sorted)."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("r"), docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    known = [words_of(t) for _, t in templates]
    reach = max((len(t) for t in known), default=0) + 4 * slack
    ours = {int(h) for t in known for h in gram_hashes(t, k)}

    # One pass over the text: a row with the document's own figures (h null)
    # and one row per k-gram.  A k-gram of a template also carries the words
    # around it, so that spans are verified without reading the text again.
    def grams(batches):
        wanted = np.array(sorted(ours), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = {n: [] for n, _ in OWN}
                at, hs, rr, around, offset = [], [], [], {}, 0
                for i, d, t in zip(*(part.column(j).to_pylist() for j in range(3))):
                    ws = words_of(t)
                    places = base_places(b" " + b" ".join(ws) + b" ")
                    for n, v in zip(out, (i, d, len(ws), len(places), places[0][0] if places else None,
                                          places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))):
                        out[n].append(v)
                    h = gram_hashes(ws, k)
                    for p in np.flatnonzero(np.isin(h, wanted)).tolist():
                        first = max(0, p - reach)
                        around[offset + p] = (first, b" ".join(ws[first:p + 2 * reach]).decode("utf-8"))
                    hs.append(h)
                    at.append(np.arange(len(h)))
                    rr.append(np.full(len(h), i))
                    offset += len(h)
                own = [pa.array(out[n], type=arrow.field(n).type) for n, _ in OWN]
                yield pa.RecordBatch.from_arrays(own + [pa.nulls(part.num_rows, f.type) for f in list(arrow)[len(OWN):]], schema=arrow)
                if not offset:
                    continue
                h, p, rr = np.concatenate(hs), np.concatenate(at), np.concatenate(rr)
                for x in range(0, offset, 100_000):
                    n = len(h[x:x + 100_000])
                    ctx = [around.get(y) for y in range(x, x + n)] if around else [None] * n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rr[x:x + n])] + [pa.nulls(n, arrow.field(c).type) for c, _ in OWN[1:]]
                        + [pa.array(h[x:x + n]), pa.array(p[x:x + n]), pa.array([c and c[0] for c in ctx], type=pa.int64()),
                           pa.array([c and c[1] for c in ctx], type=pa.string())], schema=arrow)

    schema = T.StructType([rows.schema["doc_id"] if n == "doc_id" else T._parse_datatype_string(f"{n} {t}").fields[0] for n, t in OWN]
                          + T._parse_datatype_string("h long, p long, ctx_at long, ctx string").fields)
    arrow = to_arrow_schema(schema)
    made = rows.mapInArrow(grams, schema)
    # The templates are a parameter of fixed size, so the broadcast is bounded.
    voted = cut_lineage(made.join(F.broadcast(template_grams(spark, templates, k)), "h", "left")
                        .where(F.col("h").isNull() | F.col("template").isNotNull()))
    own = voted.where("h is null").select(*[n for n, _ in OWN])
    diagonals = (voted.where("h is not null").withColumn("d", F.col("p") - F.col("q"))
                 .groupBy("r", "template", "d")
                 .agg(F.count("*").alias("votes"), F.min(F.struct("p", "ctx_at", "ctx")).alias("first")))
    near = W.partitionBy("r", "template").orderBy("d")
    spans = (diagonals.withColumn("new", (F.col("d") - F.coalesce(F.lag("d").over(near), F.lit(-(1 << 40))) > slack).cast("int"))
             .withColumn("island", F.sum("new").over(near))
             .groupBy("r", "template", "island")
             .agg(F.sum("votes").alias("votes"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("first").alias("first"))
             .select("r", "template", "votes", "lo", "hi", "first.ctx_at", "first.ctx"))

    def verify(batches):
        for b in batches:
            keep = []
            for r, t, votes, lo, hi, ctx_at, ctx in zip(*(b.column(i).to_pylist() for i in range(7))):
                first, end = max(lo, 0), hi + len(known[t])
                share = verified(ctx.encode("utf-8").split(b" "), known[t], first - ctx_at, end - ctx_at)
                if share >= cover:
                    keep.append((r, templates[t][0], first, end, votes, share))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keep)], names=["r", "label", "first", "end", "votes", "share"])

    found = (spans.mapInArrow(verify, "r long, label string, first long, end long, votes long, share double")
             .groupBy("r").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count("*").alias("n_spans"),
                               F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("first", "end", "label"))),
                                                        lambda s: F.concat_ws(":", s["label"], s["first"], s["end"])), ",").alias("spans")))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    none = F.array().cast("array<string>")
    return own.join(found, "r", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
