"""Secret scan: fixed patterns, and character Markov models for the rest.

The fixed patterns give the base spans.  Two first-order character Markov
models, one of random strings and one of ordinary identifiers, then score
every other token of 8 and more characters, and the parts of tokens around
base spans: one whose mean log-likelihood ratio per character reaches the
threshold becomes a ``markov`` span.  The mean of few characters varies more,
so the threshold rises below 20 characters, by the square root of the length.
Both models are trained on labelled samples drawn from the corpus by Spark:
values that a fixed pattern has marked are random strings, words free of any
such value are identifiers.  A token without a letter is a number or a rule
line, which neither model learns, and is not scored.

Defined results: null text counts as empty; a text without a secret has zero
counts, the digest of the empty string and no spans; spans are code points,
end exclusive; repeated rows are scanned alike; on an empty table, or one
without a labelled value, the built-in uniform random model is used.
"""

from __future__ import annotations

import hashlib
import math
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import map_texts

KINDS = ("assign", "access", "hex", "markov")
_any_case = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
ASSIGN = re.compile("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api")
                    + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")   # greedy runs of 16 and more characters
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# Cheap tests that let a text skip the assignment pattern.
HINT = re.compile(r"[:=]")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET)
START = SIZE                                 # state before the first character
LEAST, FULL = 8, 20                          # shortest candidate; length from which the threshold holds as given
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)     # candidates for the models, as long as they go
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9_.-]{8,}(?![A-Za-z0-9+/_.=-])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the fixed patterns, sorted."""
    out = []
    if HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted((s, e, k) for s, e, k in out)


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The marked values: the assigned value, or the whole match."""
    return [ASSIGN.fullmatch(text, s, e)[2] if k == 0 else text[s:e] for s, e, k in spans]


def bigrams(token: str) -> list[tuple[int, int]]:
    codes = [CODE[c] for c in token]
    return list(zip([START, *codes], codes))


# Shares of the written forms that ordinary words take in identifiers, beside
# the corpus's own: upper case, a capital first letter, joined by a separator or
# by a capital; and of the characters' own frequency in a transition, since
# names have letter pairs that the corpus does not.
UPPER_SHARE, CAPITAL_SHARE, JOINED_SHARE, OWN_SHARE = 0.1, 0.3, 0.2, 0.2
THRESHOLD = 0.75         # mean log-likelihood ratio per character at which a token is a secret
SEPARATORS = "_-/."


def identifiers(words: np.ndarray) -> np.ndarray:
    """Transition counts of identifiers, from those of the corpus's words
    (a row per character and one for the start)."""
    lower, upper = [CODE[c] for c in string.ascii_lowercase], [CODE[c] for c in string.ascii_uppercase]
    marks = [CODE[c] for c in SEPARATORS]
    letters, starts = words[np.ix_(lower, lower)], words[START, lower]
    begins = starts / max(starts.sum(), 1.0)
    ends = letters.sum(axis=0) / max(letters.sum(), 1.0) * starts.sum()      # about one end per word
    out = words.astype(float)
    out[np.ix_(upper, upper)] += UPPER_SHARE * letters
    out[START, upper] += (UPPER_SHARE + CAPITAL_SHARE) * starts
    capital = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1.0)
    out[np.ix_(upper, lower)] += (CAPITAL_SHARE + JOINED_SHARE / 2) * starts[:, None] * capital
    out[np.ix_(lower, upper)] += JOINED_SHARE / 2 * np.outer(ends, begins)
    for m in marks:
        share = JOINED_SHARE / 2 / len(marks)
        out[lower, m] += share * ends
        out[m, lower] += share * starts
        out[m, upper] += share * (CAPITAL_SHARE + UPPER_SHARE) * starts
        out[upper, m] += share * UPPER_SHARE * ends
    digits = [CODE[c] for c in string.digits]
    out[np.ix_(lower, digits)] += JOINED_SHARE / 20 * ends[:, None]
    out[np.ix_(digits, lower)] += JOINED_SHARE / 20 * starts / 10
    return out


class Markov:
    """Log-likelihood ratio table of the two models: marked values, add-one
    smoothed, and ordinary words in the forms of identifiers, mixed with the
    characters' own frequencies."""

    def __init__(self, random: dict, ordinary: dict):
        def table(counts: dict) -> np.ndarray:
            out = np.zeros((SIZE + 1, SIZE))
            for (a, b), n in counts.items():
                out[a, b] = n
            return out
        r, o = table(random) + 1.0, identifiers(table(ordinary))
        own = o.sum(axis=0) + 0.5
        given = (o + 0.5) / (o + 0.5).sum(axis=1, keepdims=True)
        o = (1 - OWN_SHARE) * given + OWN_SHARE * own / own.sum()
        self.ratio = (np.log(r / r.sum(axis=1, keepdims=True)) - np.log(o)).tolist()

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character, random against ordinary."""
        pairs = bigrams(token)
        return sum(self.ratio[a][b] for a, b in pairs) / max(1, len(pairs))


def fit(docs: DataFrame, text: str = "text") -> Markov:
    """Count both classes' character transitions over all documents.  The
    result has at most 2 x 70 x 70 rows, whatever the size of the corpus."""

    def make():
        def work(texts):
            out = []
            for t in texts:
                counts: dict = {}
                spans = base_spans(t)
                for v in values(t, spans):
                    for a, b in bigrams(v):
                        counts[1, a, b] = counts.get((1, a, b), 0) + 1
                at = 0
                for s, e, _ in [*spans, (len(t), len(t), 0)]:
                    if s > at:
                        for m in WORD.finditer(t, at, s):
                            if not m[0].isdigit():
                                for a, b in bigrams(m[0]):
                                    counts[0, a, b] = counts.get((0, a, b), 0) + 1
                    at = max(at, e)
                out.append([(k, a, b, n) for (k, a, b), n in counts.items()])
            return [out]
        return work

    # Partial sums per batch would do as well; Spark's map-side aggregation gives them.
    counted = (map_texts(docs.select(docs[text].alias("text")), make, "c array<struct<k: int, a: int, b: int, n: long>>")
               .select(F.explode("c").alias("c")).groupBy("c.k", "c.a", "c.b").agg(F.sum("c.n").alias("n")).collect())
    model = [{(r.a, r.b): r.n for r in counted if r.k == k} for k in (0, 1)]
    return Markov(model[1], model[0])


def find(text: str, model: Markov, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans of one text: the base ones, and the tokens and parts of
    tokens outside them whose score reaches the threshold of their length."""
    spans = base_spans(text)
    more, at = [], 0
    for x, y, _ in [*spans, (len(text), len(text), 0)]:
        for m in TOKEN.finditer(text, at, x) if x > at else ():
            v = m[0]
            if any(map(str.isalpha, v)) and model.score(v) >= threshold * max(1.0, math.sqrt(FULL / len(v))):
                more.append((m.start(), m.end(), 3))
        at = max(at, y)
    return sorted(spans + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: Markov, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, counts of the base kinds, digest of the base spans,
    all spans as text, and the number of spans the models added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            out = [[], [], [], [], [], []]
            for t in texts:
                spans = find(t, m, threshold)
                base = [x for x in spans if x[2] < 3]
                row = (*(sum(x[2] == k for x in base) for k in range(3)),
                       hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base))
                for col, v in zip(out, row):
                    col.append(v)
            return out
        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_texts(rows, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, model: Markov, threshold: float = THRESHOLD, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; all columns and
    rows stay (a null text stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            out = []
            for t in texts:
                parts, at = [], 0
                for s, e, _ in find(t, m, threshold):
                    if e <= at:
                        continue
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = e
                out.append("".join([*parts, t[at:]]))
            return [out]
        return work

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("rest") if len(docs.columns) > 1
                       else F.lit(0).alias("rest"), docs[text].isNull().alias("none"), docs[text].alias("text"))
    done = map_texts(rows, make, "clean string")
    new = F.when(F.col("none"), F.lit(None).cast("string")).otherwise(F.col("clean"))
    return done.select(*[new.alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])
