"""Toxicity: a linear-chain conditional random field over words.

Words are tagged toxic or not, one chain per sentence.  The field's features
are the word and its prefixes; it is trained on labelled tokens, made from the
labelled documents: a word of a toxic document is toxic when its features
occur far more often in toxic than in clean documents, every word of a clean
document is not.  Forward-backward gives each word's marginal probability; the
marginals of a document are aggregated to its score, and words with a high
marginal are the offending spans.

Defined results: a null text, or one without words, gets the score of a
document without toxic words; rows without id or label, and held-out ids, are
never learned from; several labels of one id count as often as they occur;
repeated rows are scored alike; without both kinds of labels every score is 0;
only the named id and text columns of the documents are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import held_out, map_texts

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")       # words and ends of sentences
PREFIXES = (3, 4, 5, 6)
CACHE = 300_000


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def chains(texts: list[str], ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, chain of each word, document of each word)."""
    words, ends, docs = [], [], []
    for d, t in enumerate(texts):
        tokens = TOKEN.findall(t.lower())
        words += tokens
        docs.append(len(tokens))
    codes = ids(words)
    doc = np.repeat(np.arange(len(texts)), docs)
    stop = codes < 0
    # A chain ends at a stop and at the end of its document.
    chain = np.cumsum(stop) + doc
    ends = ~stop
    return codes[ends], chain[ends], doc[ends]


class Order:
    """Chains sorted by length, so that step t works on a prefix of them."""

    def __init__(self, chain: np.ndarray):
        start = np.flatnonzero(np.diff(chain, prepend=-1))
        length = np.diff(np.append(start, len(chain)))
        by = np.argsort(-length, kind="stable")
        self.start, length = start[by], length[by]
        self.steps = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(1, self.steps + 1), side="right")

    def ratios(self, e: np.ndarray, first: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages, each as toxic over not toxic.
        ``e`` holds the words' odds, ``t`` the 2 x 2 transition factors."""
        r, b = np.empty_like(e), np.ones_like(e)
        for s, n in enumerate(self.active):
            at = self.start[:n] + s
            if s == 0:
                r[at] = e[at] * first
            else:
                before = r[at - 1]
                r[at] = e[at] * (t[0, 1] + before * t[1, 1]) / (t[0, 0] + before * t[1, 0])
        for s in range(self.steps - 2, -1, -1):
            at = self.start[:self.active[s + 1]] + s
            x = e[at + 1] * b[at + 1]
            b[at] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        return r, b


def odds(logits: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(logits, -30, 30))


class Field:
    """The trained field: feature weights, bias, first and transition weights,
    and the weights that turn a document's marginals into a score."""

    def __init__(self, weights: dict[str, float], bias: float, first: float, moves: np.ndarray, score: np.ndarray):
        self.weights, self.bias, self.first, self.moves, self.score_weights = weights, bias, first, moves, score

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, codes: np.ndarray, chain: np.ndarray, emission: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        e = odds(emission[codes])
        r, b = Order(chain).ratios(e, float(odds(np.array(self.first))), odds(self.moves))
        return r * b / (1 + r * b)

    def scores(self, p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if self.score_weights is None:
            return np.zeros(docs)
        return 1 / (1 + np.exp(-np.clip(aggregates(p, doc, docs) @ self.score_weights, -30, 30)))


def aggregates(p: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document: 1, expected toxic words (log), their share, the largest
    marginal."""
    total, words = np.bincount(doc, p, docs), np.bincount(doc, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, doc, p)
    return np.column_stack([np.ones(docs), np.log1p(total), np.sqrt(total / np.maximum(words, 1)), top])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + ridge * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, doc_id: str, text: str):
    """(text, label) of a bounded number of labelled rows that are not held
    out, picked by a hash of the id, and the number of all such rows by label."""
    ok = labels.where(labels[doc_id].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels[doc_id])).select(
        labels[doc_id].alias("label_id"), (labels["toxic"] != 0).cast("int").alias("toxic"))
    there = {r.toxic: r.n for r in ok.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, most / max(1, there.get(k, 0))) for k, most in ((0, max_clean), (1, max_toxic))]
    lot = F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = ok.where(lot < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # About max_toxic + max_clean ids: a bounded broadcast.
    rows = (docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
            .join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("id", "text", "toxic").collect())
    rows.sort(key=lambda r: (r.id, r.text or "", r.toxic))
    return [r.text or "" for r in rows], np.array([r.toxic for r in rows], float), there


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 2000, steps: int = 40, lift: float = 5.0,
        doc_id: str = "doc_id", text: str = "text") -> Field:
    """Train on at most about ``max_toxic`` + ``max_clean`` labelled documents,
    on the driver; both bounds are parameters."""
    texts, y, there = sample(docs, labels, max_toxic, max_clean, doc_id, text)
    none = Field({}, -20.0, 0.0, np.zeros((2, 2)), None)
    if not len(y) or y.min() == y.max():
        return none
    vocabulary: dict[str, int] = {}

    def ids(words):
        return np.fromiter((-1 if w in ".!?\n" else vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))

    codes, chain, doc = chains(texts, ids)
    if not len(codes):
        return none
    toxic_word = y[doc] > 0
    counts = [np.bincount(codes[toxic_word == k], minlength=len(vocabulary)) for k in (False, True)]
    clean, toxic = Counter(), Counter()
    by_word = []
    for w, (a, b) in zip(vocabulary, zip(*map(np.ndarray.tolist, counts))):
        fs = features(w)
        by_word.append(fs)
        for f in fs:
            clean[f] += a
            toxic[f] += b
    n0, n1 = max(1, counts[0].sum()), max(1, counts[1].sum())
    marks = {f for f, n in toxic.items() if n >= 5 and (n / n1) / ((clean[f] + 0.5) / n0) >= lift}
    # The field has weights for features that are frequent enough to learn.
    known = {f: i for i, f in enumerate(sorted(f for f, n in toxic.items() if n + clean[f] >= 5 and (f in marks or n >= 3)))}
    rows, cols, word_marked = [], [], np.zeros(len(vocabulary), bool)
    for i, fs in enumerate(by_word):
        word_marked[i] = any(f in marks for f in fs)
        for f in fs:
            if (j := known.get(f)) is not None:
                rows.append(i)
                cols.append(j)
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    tag = (toxic_word & word_marked[codes]).astype(float)

    order = Order(chain)
    inner = np.flatnonzero(np.diff(chain) == 0)         # pairs of neighbours in one chain
    pair = np.zeros((2, 2))
    np.add.at(pair, (tag[inner].astype(int), tag[inner + 1].astype(int)), 1)
    starts = np.flatnonzero(np.diff(chain, prepend=-1))
    theta = np.zeros(len(known) + 1 + 1 + 4)           # features, bias, first, moves
    theta[len(known)] = -2.0
    grad2, size = np.zeros_like(theta), len(codes)
    told = np.bincount(codes, tag, len(vocabulary))

    def emissions():
        return theta[len(known)] + np.bincount(rows, theta[cols], len(vocabulary))

    for _ in range(steps):
        moves = theta[-4:].reshape(2, 2)
        e = odds(emissions()[codes])
        t = odds(moves)
        r, b = order.ratios(e, float(np.exp(theta[-5])), t)
        p = r * b / (1 + r * b)
        gap = told - np.bincount(codes, p, len(vocabulary))
        x = (e * b)[inner + 1]
        both = np.stack([t[0, 0] * np.ones_like(x), t[0, 1] * x, t[1, 0] * r[inner], t[1, 1] * r[inner] * x])
        both /= both.sum(axis=0)
        g = np.concatenate([np.bincount(cols, gap[rows], len(known)), [gap.sum()], [(tag - p)[starts].sum()],
                            pair.ravel() - both.sum(axis=1)]) - 0.05 * theta
        grad2 += g * g
        theta += 1.0 * g / np.sqrt(grad2 + 1e-8)
    field = Field({f: float(theta[i]) for f, i in known.items() if abs(theta[i]) > 1e-3}, float(theta[len(known)]), float(theta[-5]),
                  theta[-4:].reshape(2, 2).copy(), None)
    p = field.marginals(codes, chain, emissions())
    weight = np.where(y > 0, there[1] / max(1, (y > 0).sum()), there[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    field.score_weights = logistic(aggregates(p, doc, len(y)), y, weight)
    return field


def tag(docs: DataFrame, field: Field, span_from: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, ``spans`` (start, end and
    marginal of every word whose marginal reaches ``span_from``)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        f = shared.value
        seen: dict[str, int] = {}
        emission = np.zeros(1024)

        def ids(words):
            nonlocal emission
            for w in set(words).difference(seen):
                if len(seen) >= len(emission):
                    emission = np.append(emission, np.zeros_like(emission))
                seen[w] = len(seen)
                emission[seen[w]] = f.emission(w)
            codes = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
            for stop in ".!?\n":
                if stop in seen:
                    codes[codes == seen[stop]] = -1
            return codes

        def part(texts):
            if len(seen) > CACHE:
                seen.clear()
            codes, chain, doc = chains(texts, ids)
            p = f.marginals(codes, chain, emission)
            score = f.scores(p, doc, len(texts))
            spans: list[list] = [[] for _ in texts]
            hits: dict[int, list] = {}
            first = np.searchsorted(doc, np.arange(len(texts)))
            for i in np.flatnonzero(p >= span_from).tolist():
                hits.setdefault(int(doc[i]), []).append((i - int(first[doc[i]]), float(p[i])))
            for d, found in hits.items():
                lower = texts[d].lower()
                if len(lower) == len(texts[d]):
                    places = [m.span() for m in TOKEN.finditer(lower) if m[0] not in ".!?\n"]
                else:       # lower case changes the length of a few characters
                    places = [m.span() for m in TOKEN.finditer(texts[d]) if m[0] not in ".!?\n"]
                spans[d] = [(*places[k], v) for k, v in found if k < len(places)]
            return score, spans

        def work(texts):
            score, spans = [], []
            for lo in range(0, len(texts), 500):
                s, x = part(texts[lo:lo + 500])
                score += s.tolist()
                spans += x
            return [score, spans]
        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    return map_texts(rows, make, "score double, spans array<struct<start: long, end: long, p: double>>")
