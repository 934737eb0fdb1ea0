"""Language identification: known words first, character n-grams for the rest.

Every known word adds its log frequency per language.  A word that no learned
language knows backs off to its character n-grams, longest first: the first
length of which any n-gram is known decides, by the mean log frequency of the
known n-grams of that length.

The model holds the 64-bit hash of every word and n-gram of the sample, sorted,
and for each the log frequencies in the languages that have it; the others
share one value.  So it takes about 14 bytes for each pair of key
and language, whatever the number of languages.  (Two keys with one hash would
share their counts; among two million keys that has a chance of one in ten
million.)

Defined results: a null text or one without a letter (``\\p{L}``) is ``und``
with score 0; rows without language or id are never learned from; ties go to
the smaller language name; repeated rows are predicted alike and learned as
often as they occur; every language of a learnable row can be predicted, also
one whose sampled rows have no word; without any learnable row every
prediction is ``und``, and an empty table gives no rows.  Only the named id,
text and language columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldlab.llm.common import cut_lineage, held_out, map_texts

WORD = regex.compile(r"\p{L}+")
CACHE = 200_000          # words per worker whose scores are kept
BLOCK = 10_000           # words of a text held at a time
CHUNK = 200_000          # characters of texts looked up together


def words_of(text: str) -> Iterator[list[str]]:
    """All lower-case words in blocks, so that a very long text needs little
    memory beside itself."""
    found = (m.group() for m in WORD.finditer(text.lower()))
    while block := list(islice(found, BLOCK)):
        yield block


def ngrams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def hashes(keys: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for the strings."""
    return np.array([xxh64_intdigest(k.encode("utf-8"), 42) for k in keys], np.uint64).view(np.int64)


class Table:
    """Log frequencies of the keys of one kind, (count + 1/2) over the
    language's total with 1/2 for each key.  A key that a language lacks costs
    the same in all of them, so that a small language gains nothing by it."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        self.langs, order = langs, np.lexsort((lang, keys))
        keys, self.lang, n = keys[order], lang[order].astype(np.int32), n[order].astype(np.float64)
        self.keys, first = np.unique(keys, return_index=True)
        self.start = np.append(first, len(keys)).astype(np.int64)
        total = np.bincount(self.lang, n, langs) + 0.5 * len(self.keys) + 1
        self.value = (np.log(n + 0.5) - np.log(total)[self.lang]).astype(np.float32)
        self.rest = math.log(0.5) - math.log(total.max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Log frequencies (keys x languages) of known places."""
        out = np.full((len(at), self.langs), self.rest)
        size = self.start[at + 1] - self.start[at]
        own = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(own)) + np.repeat(self.start[at] - np.cumsum(size) + size, size)
        out[own, self.lang[place]] = self.value[place]
        return out


class Model:
    """``tables[0]``: words; ``tables[n]``: n-grams of n characters."""

    def __init__(self, langs: list[str], tables: list[Table]):
        self.langs, self.tables = langs, tables

    @classmethod
    def of(cls, langs: list[str], words: dict, grams: dict, longest: int) -> Model:
        """From counts by key and language: {key: {language: count}}."""
        def made(counts: dict) -> Table:
            rows = [(k, langs.index(x), n) for k, c in counts.items() for x, n in c.items()]
            return Table(hashes([r[0] for r in rows]), np.array([r[1] for r in rows], int), np.array([r[2] for r in rows], int), len(langs))
        return cls(langs, [made(words), *[made({g: c for g, c in grams.items() if len(g) == n}) for n in range(1, longest + 1)]])

    def nbytes(self) -> int:
        return sum(a.nbytes for t in self.tables for a in (t.keys, t.start, t.lang, t.value))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores (words x languages): a word's own, or those of its
        longest known n-grams, or nothing."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.tables[0].find(hashes(words))
        out[at >= 0] = self.tables[0].rows(at[at >= 0])
        left = np.flatnonzero(at < 0).tolist()
        for n in range(len(self.tables) - 1, 0, -1):
            grams, owner = [], []
            for i in left:
                some = ngrams(words[i], n)
                grams += some
                owner += [i] * len(some)
            if not grams:
                continue
            at = self.tables[n].find(hashes(grams))
            own = np.array(owner)[at >= 0]
            found = np.bincount(own, minlength=len(words))
            np.add.at(out, own, self.tables[n].rows(at[at >= 0]) / found[own][:, None])
            left = [i for i in left if not found[i]]
        return out

    def predict(self, text: str) -> tuple[str, float]:
        """Plain form of one prediction, which tests compare with."""
        ws = WORD.findall(text.lower())
        if not ws or not self.langs:
            return "und", 0.0
        total = [math.fsum(col) for col in zip(*(self.scores([w])[0] for w in ws))]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        return self.langs[best], 1 / sum(math.exp(max(t - total[best], -700.0)) for t in total)


def fit(docs: DataFrame, sample_docs: int = 1_500, max_langs: int = 1_000, longest: int = 5,
        doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from a bounded sample of the rows with a language whose id is not
    held out: about ``sample_docs`` rows of each language, all of a language
    with fewer, of the ``max_langs`` most frequent languages.  A hash of id and
    text picks them, so copies of a row come together; they add to counts, not
    to the keys.  All words and n-grams of the sample are learned.

    Spark counts the words; the driver gets the hashes and counts as Arrow."""
    lot = F.pmod(F.xxhash64(docs[doc_id].cast("string"), docs[text].cast("string"), F.lit("language")), F.lit(1 << 53)) / float(1 << 53)
    rows = docs.where(docs[lang].isNotNull() & docs[doc_id].isNotNull() & ~held_out(docs[doc_id])).select(
        docs[lang].cast("string").alias("lang"), docs[text].alias("text"), lot.alias("lot"))
    # A grouped count with map-side combination; at most max_langs rows reach the driver.
    counts = (rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min("lot").alias("least"))
              .orderBy(F.desc("rows"), "lang").limit(max_langs).collect())
    langs = sorted(r.lang for r in counts)
    if not langs:
        return Model([], [])
    share = docs.sparkSession.createDataFrame([(r.lang, langs.index(r.lang), max(sample_docs / r.rows, r.least)) for r in counts],
                                              "lang string, k int, share double")
    rows = rows.join(F.broadcast(share), "lang").where("lot <= share")

    def counted():
        def work(texts):
            out = []
            for t in texts:
                c = Counter()
                for block in words_of(t):
                    c.update(block)
                out.append(list(c.items()))
            return [out]
        return work

    words = cut_lineage(map_texts(rows.select("k", "text"), counted, "words array<struct<word: string, n: int>>")
                        .select("k", F.explode("words").alias("w"))
                        .groupBy("k", "w.word").agg(F.sum("w.n").alias("n")))
    marked = words.select("k", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    sizes = F.array(*[F.lit(n) for n in range(1, longest + 1)])
    grams = (marked.select("k", "n", "w", F.explode(sizes).alias("size")).where(F.length("w") >= F.col("size"))
             .select("k", "n", "size", F.explode(F.expr(
                 "transform(sequence(1, length(w) - size + 1), i -> substring(w, i, size))")).alias("gram"))
             .groupBy("size", F.xxhash64("gram").alias("key"), "k").agg(F.sum("n").alias("n")))
    own = words.select(F.lit(0).alias("size"), F.xxhash64("word").alias("key"), "k", "n")
    found: pa.Table = own.unionByName(grams).toArrow()
    size, key, k, n = (found.column(c).to_numpy() for c in ("size", "key", "k", "n"))
    return Model(langs, [Table(key[size == i], k[size == i], n[size == i], len(langs)) for i in range(longest + 1)])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``held_out``, ``lang_pred``, ``score`` (posterior of
    the predicted language under equal priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        seen: dict[str, int] = {}
        rows = np.zeros((1024, max(1, len(m.langs))))

        def learn(words: set) -> None:
            nonlocal rows
            if len(seen) > CACHE:
                seen.clear()
            new = list(words.difference(seen))
            while len(seen) + len(new) > len(rows):
                rows = np.vstack([rows, np.zeros_like(rows)])
            rows[len(seen):len(seen) + len(new)] = m.scores(new)
            seen.update(zip(new, range(len(seen), len(seen) + len(new))))

        def total(words: list[str]) -> np.ndarray:
            return rows[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))].sum(axis=0)

        def totals(texts: list[str]) -> list:
            if len(texts) == 1:
                out = None
                for block in words_of(texts[0]):
                    learn(set(block))
                    out = total(block) if out is None else out + total(block)
                return [out]
            words = [WORD.findall(t.lower()) for t in texts]
            learn(set().union(*words))
            return [total(w) if w else None for w in words]

        def work(texts):
            preds, scores, at = [], [], 0
            while at < len(texts):
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= CHUNK:
                    held += len(texts[to])
                    to += 1
                for t in totals(texts[at:to]) if m.langs else [None] * (to - at):
                    best = None if t is None else int(np.argmax(t))
                    preds.append("und" if t is None else m.langs[best])
                    scores.append(0.0 if t is None else float(1 / np.exp(np.maximum(t - t[best], -700)).sum()))
                at = to
            return [preds, scores]
        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    return map_texts(rows, make, "lang_pred string, score double")
