"""Spelling variants: asymmetric q-chunks.

Two words are near when one inserted, deleted or replaced code point turns
one into the other.  For every pair one word gives two disjoint chunks, its
first and its second q = floor(length / 2) code points; one edit lies in at
most one of them, so the other stands unchanged in the second word, moved by
one position at most.  The second word gives all its positional grams that a
chunk can meet: for each chunk owner length within one of its own, the gram
at the first chunk's place (an edit behind it moves nothing) and the gram at
the second chunk's place moved by the difference of the lengths (an edit
before it moves it by just that).  Any single edit leaves one of the two in
place: one in or behind the second chunk keeps the first, any other keeps the
second.  Chunks and grams are joined on (owner length, which chunk, code
points), and candidates are verified by edit distance.

Words are counted first (map-side combination), so the join sees each word
once however often it occurs; a word sends two chunks and six grams, and a
shuffle partition with many of one key is split by adaptive execution.

The form of a word is its near word with the largest count, if that is at
least ``ratio`` times the word's own; its root is the last word reached
through forms.  Counts grow by that factor at every step, so chains are short,
and pointer doubling settles them in a few joins.

Defined results: null and empty texts have no words; a null id takes no
letter away in the query's word rule; an empty table gives no rows; repeated
rows count again; equal counts are settled by code-point order; a word without
a near word has n_near 0 and itself as root; only the named id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import cut_lineage, text_of

LEAST = 6                # code points of a word; two chunks need at least 4
RUN = "[a-zÀ-ÿ]{%d,}"    # maximal runs, as a shorter stretch of a run cannot match
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every lower-cased run of letters of at least ``least`` code points:
    columns doc_id, word."""
    lower = F.translate(text_of(docs, text), UPPER, LOWER)
    found = F.regexp_extract_all(lower, F.lit(RUN % least), F.lit(0))
    return docs.select(docs[doc_id].alias("doc_id"), F.explode(found).alias("word"))


def with_slips(words: DataFrame, modulus: int = 199) -> DataFrame:
    """The words after the query's contract: with h = crc32 of
    ``<doc_id>:<word>``, a word whose h is divisible by ``modulus`` loses its
    code point h % length."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("word")).alias("word"))


def counts(words: DataFrame, least: int = LEAST, least_n: int = 5) -> DataFrame:
    """word, n of the words with enough code points and occurrences."""
    return (words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_n))


def _part(word: str, start: Column, size: Column) -> Column:
    return F.substring(F.col(word), start + 1, size)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n of all near pairs, each in both directions.
    ``vocabulary`` has one row for each word of at least four code points."""
    length = F.length("word")
    own = vocabulary.select("word", "n", length.alias("owner"), F.floor(length / 2).cast("int").alias("q"))
    chunk = own.select("word", "n", "owner", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), _part("word", F.lit(0), F.col("q")).alias("gram")),
        F.struct(F.lit(1).alias("part"), _part("word", F.col("q"), F.col("q")).alias("gram")))).alias("c")
        ).select("owner", "c.part", "c.gram", "word", "n")
    other = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"),
                              F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)])).alias("owner"))
    other = other.withColumns({"q": F.floor(F.col("owner") / 2).cast("int"), "shift": F.length("near") - F.col("owner")})
    grams = other.select("near", "near_n", "owner", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), _part("near", F.lit(0), F.col("q")).alias("gram")),
        F.struct(F.lit(1).alias("part"), _part("near", F.col("q") + F.col("shift"), F.col("q")).alias("gram")))).alias("g")
        ).select("owner", "g.part", "g.gram", "near", "near_n")
    close = (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    # A pair can meet at both chunks; it counts at the second one only if the first one differs.
    once = (F.col("part") == 0) | (_part("word", F.lit(0), F.floor(F.col("owner") / 2).cast("int"))
                                   != _part("near", F.lit(0), F.floor(F.col("owner") / 2).cast("int")))
    return chunk.join(grams, ["owner", "part", "gram"]).where(once & close).select("word", "n", "near", "near_n")


def forms(pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word with a near word: word, n_near, form, form_n (the last two
    null where no near word is frequent enough)."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    per = pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
    enough = -F.col("b.m") >= ratio * F.col("n")
    return per.select("word", "n_near", F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root for the rows (word, form): the last word that forms lead to.
    Every round doubles the distance followed; counts grow along forms, so
    there are no cycles."""
    at = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"),
                                                                  F.col("onward").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.drop("moved")


def variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of ``vocabulary`` (word, n): word, n, n_near, form, form_n, root."""
    vocabulary = cut_lineage(vocabulary)
    near = cut_lineage(forms(near_pairs(vocabulary), ratio))
    root = roots(near.where(F.col("form").isNotNull()))
    return (vocabulary.join(near, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
