"""Quality rules with thresholds that adapt to each language and source.

Figures of every document are computed inside its row by built-in functions.
Per language and source each figure goes into a DDSketch: a histogram over
logarithmic buckets with a bounded relative error.  Such sketches merge by
adding their counts, so one grouped count builds them (with map-side
combination, whatever the size of a source).  From the quantiles of a sketch
come the thresholds of its group, and the documents are joined with them.

Sketches hold the documents that pass the base rules, so that plain junk does
not move them.  A figure's upper threshold in a group is its median plus
``spread`` times its upper tail, the distance from the median to the 0.9
quantile; the mean word length has a lower threshold alike.  Both parts are
shrunk: the median towards that of the language, and that towards the overall
one, each parent weighing as much as ``prior`` documents; the tail is the
middle one of the group's, its language's and the overall tail, so that a group
with many faulty documents does not widen its own threshold, but at least the
shorter one of the group's own two tails, as a group may vary more than others.

A document is outside a threshold when its figure is too far for its own
length: a share of x in n must exceed the threshold by more than ``sure``
standard deviations of a count, a mean by as many standard errors.  FLOOR
keeps the threshold of a share from falling below one percent.

Defined results: null text counts as empty; a null language or source is a
group of its own; a text without words fails the base rules; a group without
a document that passes them has no thresholds; repeated rows count as often as they occur; an empty table
gives no rows; clashing names do not matter, as only the named id, text,
language and source columns are read.  Word windows are compared by 64-bit
hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import JAVA_WS, cut_lineage, text_of

WINDOW = 8
RELATIVE_ERROR = 0.01
GAMMA = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
SHIFT = 1e-4             # figures are shifted, so that zero has a bucket
FLOOR = 0.01             # least threshold of a share
# Figure: units that a document's size is counted in; a repeated window comes
# with up to 16 words.  None: a mean, not a share.
FIGURES = {"word_length": None, "symbols": 1, "dup_lines": 1, "repeats": 16, "neighbours": 1}
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``COUNTS``, ``n_lines`` and ``n_neighbours`` (words equal to the
    word before); drops the text.  All inside the row, no shuffle."""
    keep = [c for c in rows.columns if c != text]
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    d = rows.select(*keep, F.col(text).alias("_t"),
                    F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, JAVA_WS)).alias("_w"),
                    F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_l"))
    d = d.select(*keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                 (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    counts = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    shifted = lambda col, n: F.expr(f"slice({col}, {n + 1}, greatest(size({col}) - {n}, 0))")
    pairs = lambda col, n: F.zip_with(col, shifted(col, n), lambda a, b: F.xxhash64(a, b))
    # Hashes of windows of 2, 4 and 8 words, each from two halves.
    d = d.select(*counts, F.expr("size(filter(zip_with(_h, slice(_h, 2, greatest(size(_h) - 1, 0)), (a, b) -> a <=> b), x -> x))")
                 .cast("long").alias("n_neighbours"), pairs("_h", 1).alias("_h2"))
    counts.append("n_neighbours")
    d = d.select(*counts, pairs("_h2", 2).alias("_h4"))
    d = d.select(*counts, F.expr(f"slice(zip_with(_h4, slice(_h4, 5, greatest(size(_h4) - 4, 0)), (a, b) -> xxhash64(a, b)), 1, "
                                 f"greatest(size(_h4) - {WINDOW - 1}, 0))").alias("_h8"))
    # Only a text with an equal pair of windows is sorted.
    d = d.select(*counts, F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"),
                                 F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))))
                 .otherwise(F.array().cast("array<struct<h: bigint, i: bigint>>")).alias("_s"))
    d = d.select(*counts, F.expr("sort_array(transform(filter(_s, (s, j) -> s.h <=> get(_s, j - 1).h or s.h <=> get(_s, j + 1).h), s -> s.i))").alias("_at"))
    covered = F.expr(f"aggregate(_at, struct({-WINDOW}L as last, 0L as n), (a, x) -> struct(x as last, a.n + least({WINDOW}L, x - a.last) as n), a -> a.n)")
    return d.select(*counts, covered.alias("n_repeat_words"))


def settled(counted: DataFrame) -> DataFrame:
    """The same rows, with the counts behind an explode of one element.  A
    filter on them is not pushed below it; pushed into ``with_counts``, the
    filter would hold the nested expressions many times over, also inside
    their own lambdas."""
    counts = [*COUNTS, "n_lines", "n_neighbours"]
    rest = [c for c in counted.columns if c not in counts]
    return counted.select(*rest, F.explode(F.array(F.struct(*counts))).alias("c")).select(*rest, "c.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def figures() -> Column:
    """The figures as an array of (name, value, size), in the order of FIGURES."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    value = {"word_length": F.try_divide(chars, words), "symbols": F.try_divide("n_symbols", chars),
             "dup_lines": F.try_divide("n_dup_lines", F.col("n_lines").cast("double")),
             "repeats": F.try_divide("n_repeat_words", words), "neighbours": F.try_divide("n_neighbours", words)}
    size = {"word_length": words, "symbols": chars, "dup_lines": F.col("n_lines").cast("double"), "repeats": words, "neighbours": words}
    return F.array(*[F.struct(F.lit(n).alias("figure"), value[n].alias("v"), (size[n] / (unit or 1)).alias("n")) for n, unit in FIGURES.items()])


def sketches(counted: DataFrame) -> DataFrame:
    """DDSketches: (lang, source, figure, bucket, n).  Merging is adding n."""
    bucket = F.ceil(F.log(F.col("f.v") + SHIFT) / math.log(GAMMA)).cast("int")
    return (counted.where(~base_failed()).select("lang", "source", F.explode(figures()).alias("f"))
            .groupBy("lang", "source", F.col("f.figure").alias("figure"), bucket.alias("bucket")).agg(F.count("*").alias("n")))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, figure, total, q10, q50, q90) of the merged sketches."""
    # The buckets of one sketch are one sorted array: their number is bounded
    # by the relative error, not by the documents.
    one = (sketch.groupBy(*by, "figure", "bucket").agg(F.sum("n").alias("n")).groupBy(*by, "figure")
           .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total")))

    def quantile(q: float) -> str:
        # First bucket whose cumulated count exceeds q * (total - 1).
        return (f"aggregate(b, struct(0L as seen, cast(null as int) as at), (a, x) -> struct(a.seen + x.n as seen, "
                f"case when a.at is null and a.seen + x.n > {q} * (total - 1) then x.bucket else a.at end as at), a -> a.at)")
    middle = 2 / (1 + GAMMA)          # within the relative error of every value of a bucket
    return one.select(*by, "figure", "total", *[
        F.greatest(F.pow(F.lit(GAMMA), F.expr(quantile(q))) * middle - SHIFT, F.lit(0.0)).alias(n) for n, q in QUANTILES.items()])


def thresholds(sketch: DataFrame, spread: float, prior: float) -> DataFrame:
    """(lang, source, limits): limits is an array of (figure, low, high),
    sorted by figure."""
    sketch = cut_lineage(sketch)         # small, and read by every level below
    own, lang, every = (quantiles(sketch, by).alias(a) for a, by in (("g", ["lang", "source"]), ("l", ["lang"]), ("e", [])))
    d = (own.join(lang, (F.col("g.figure") == F.col("l.figure")) & F.col("g.lang").eqNullSafe(F.col("l.lang")))
         .join(every, F.col("g.figure") == F.col("e.figure")))

    def shrunk(level: str, towards: Column) -> Column:
        return (F.col(f"{level}.total") * F.col(f"{level}.q50") + prior * towards) / (F.col(f"{level}.total") + prior)

    distance = {level: (F.col(f"{level}.q50") - F.col(f"{level}.q10"), F.col(f"{level}.q90") - F.col(f"{level}.q50")) for level in "gle"}

    def tail(side: int) -> Column:
        return F.greatest(F.sort_array(F.array(*[distance[level][side] for level in "gle"]))[1], F.least(*distance["g"]))

    d = d.select("g.lang", "g.source", "g.figure", shrunk("g", shrunk("l", F.col("e.q50"))).alias("center"),
                 tail(0).alias("below"), tail(1).alias("above"))
    return d.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct(
        "figure", (F.col("center") - spread * F.col("below")).alias("low"), (F.col("center") + spread * F.col("above")).alias("high")))).alias("limits"))


def outside(f: Column, t: Column, sure: float) -> Column:
    """Whether a document's figure is outside the limits of its group."""
    noise = F.lit(sure) / (F.lit(2.0) * F.sqrt(f["n"]))      # of a mean whose values deviate by half of it
    mean = (f["v"] * (1 - noise) > t["high"]) | (f["v"] * (1 + noise) < t["low"])
    expected = f["n"] * F.greatest(t["high"], F.lit(FLOOR))
    share = f["v"] * f["n"] > expected + F.lit(sure * sure / 2) + F.lit(sure) * F.sqrt(expected + F.lit(sure * sure / 4))
    return F.when(f["figure"].isin([n for n, unit in FIGURES.items() if unit is None]), mean).otherwise(share)


def judged(counted: DataFrame, limits: DataFrame, sure: float) -> DataFrame:
    """Joins documents and thresholds; adds base_failed, kept and ``failed``
    (names of the figures outside their thresholds)."""
    t = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "limits")
    # A left join, so a document without a threshold row keeps its base verdict.
    d = counted.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source")
    d = d.withColumn("base_failed", base_failed()).withColumn("_f", F.sort_array(figures()))
    # array_join leaves nulls out.
    said = F.array_join(F.zip_with("_f", "limits", lambda f, t: F.when(outside(f, t, sure), f["figure"])), ",")
    d = d.withColumn("failed", F.coalesce(F.when(F.col("n_words") > 0, said), F.lit("")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop("_f", "limits")


def rules(docs: DataFrame, spread: float = 2.0, prior: float = 10.0, sure: float = 2.0, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, failed."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"), text_of(docs, text).alias("text"))
    counted = cut_lineage(with_counts(rows, "text"))     # a few numbers per document, read twice
    return judged(counted, thresholds(sketches(counted), spread, prior), sure).select("doc_id", *COUNTS, "base_failed", "kept", "failed")


def keep_good(docs: DataFrame, spread: float = 2.0, prior: float = 10.0, sure: float = 2.0, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The kept documents, with all columns as they were."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[lang].cast("string").alias("lang"),
                       docs[source].cast("string").alias("source"), text_of(docs, text).alias("text"))
    # The thresholds' pass reads no carried columns; the second pass computes
    # the counts again rather than write the texts to a checkpoint.
    limits = cut_lineage(thresholds(sketches(settled(with_counts(rows.drop("row"), "text"))), spread, prior))
    return judged(settled(with_counts(rows, "text")), limits, sure).where("kept").select("row.*")
