"""Runs of repeated words, by uniting suffix classes in order of falling LCP.

A run is a maximal stretch of words with smallest period q that holds at
least ``power`` periods and ``length`` words.  The suffixes of a text are
sorted (prefix doubling), and the common extensions of neighbours (LCP)
become edges.  Kruskal's scheme takes the edges from the longest extension
down and unites the classes of their ends; every class keeps its positions in
order.  Two positions of different classes that become neighbours in a united
class at distance q, with a common extension of l >= q words, lie in a run of
period q that ends after the later position's extension.  Why this finds all
runs and no others:

* the start s of a run and s + q have the extension run length - q >= q, and
  no position between them can share q words with s (else q would not be the
  smallest period), so they are neighbours when their classes meet;
* a pair at a multiple of a smaller period p is never a pair of neighbours,
  as the position p further on joined the class before.

All seeds of a run have the same end and period, so the run starts at the
smallest of them.  Only extensions that a wanted run can have are followed:
with 24 words and three periods those of 16 words and more.  Texts without a
repeated gram of that length (by hash; equal grams have equal hashes) hold no
run and are not sorted.

Every text is worked on alone: no shuffle, and no group beside the text.

Defined results: null counts as the empty text, without runs; an empty table
gives no rows; repeated rows and repeated ids are treated alike, one by one;
equal exponents are settled by the smaller start, then the smaller period;
only the named id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import JAVA_WS, map_texts, text_of

LENGTH = 24
POWER = 3
BLOCK = 512              # positions in a block of an ordered set
MIX = np.uint64(0x9E3779B97F4A7C15)


def least_extension(length: int, power: int) -> int:
    """The smallest common extension of two neighbouring periods of a run."""
    return min(max(length - q, (power - 1) * q) for q in range(1, length + 1))


class Positions:
    """An ordered set of positions, in blocks so that adding to a large set
    moves few of them."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        k = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > 2 * BLOCK:
            self.blocks[k:k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts.insert(k + 1, block[BLOCK])
        self.firsts[k] = self.blocks[k][0]
        self.size += 1

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and after the member ``x``."""
        k = bisect_right(self.firsts, x) - 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.firsts[k + 1] if k + 1 < len(self.blocks) else None
        return before, after


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a sequence and the common extension of each with the
    next one."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while k < n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        levels.append(rank.astype(np.int32))
        k *= 2
    i, j, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        level = np.append(levels[t], np.int32(-1))
        a, b = np.minimum(i + common, n), np.minimum(j + common, n)
        common += np.where((level[a] == level[b]) & (a < n) & (b < n), 1 << t, 0)
    return order, common


def unite(order: np.ndarray, common: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(end, period) -> start of the runs seeded by the classes united at
    extensions of ``least`` words and more."""
    edges = np.flatnonzero(common >= least)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], classes[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, extension in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist()):
        large, small = root(a), root(b)
        if classes[large].size < classes[small].size:
            large, small = small, large
        into, moved = classes[large], list(classes.pop(small))
        parent[small] = large
        for x in moved:
            into.add(x)
        own = set(moved)
        for x in moved:
            for y in into.around(x):
                if y is not None and y not in own and abs(x - y) <= extension:
                    start, period = min(x, y), abs(x - y)
                    key = (start + period + extension, period)
                    found[key] = min(found.get(key, start), start)
    return found


def may_repeat(words: list[bytes], least: int) -> bool:
    """Whether any gram of the largest power of two within ``least`` words may
    occur twice."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    k = 1
    while 2 * k <= least:
        h = (h[:-k] ^ (h[:-k] >> np.uint64(29))) * MIX + h[k:]
        k *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def runs_of(words: list[bytes], length: int = LENGTH, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < length:
        return []
    least = least_extension(length, power)
    if not may_repeat(words, least):
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    found = unite(*suffix_order(ids), least)
    return sorted((s, e - s, q) for (e, q), s in found.items() if e - s >= max(length, power * q))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; the first of equals."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the repeats: every run keeps its first period."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for s, n, q in runs:
        keep[s + q:s + n] = bytes(n - q)
    return b" ".join(compress(words, keep))


def detect(docs: DataFrame, length: int = LENGTH, power: int = POWER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``runs`` (start, length, period of each, in words),
    ``best`` (the one with the greatest exponent, or null) and ``collapsed``,
    the words outside the repeats joined by one space."""
    run = "struct<start:bigint,length:bigint,period:bigint>"

    def make():
        def work(texts):
            out = [[], [], []]
            for t in texts:
                words = t.encode("utf-8").split()       # bytes split at exactly [\x20\x09-\x0D]
                runs = runs_of(words, length, power)
                out[0].append([dict(zip(("start", "length", "period"), r)) for r in runs])
                best = strongest(runs)
                out[1].append(best and dict(zip(("start", "length", "period"), best)))
                out[2].append(collapsed(words, runs).decode("utf-8"))
            return out
        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_texts(rows, make, f"runs array<{run}>, best {run}, collapsed string")


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and text of the documents, with the repeats of the query's contract:
    where h = crc32(id) is divisible by 10, the words from a = g % n on
    (g = floor(h / 10)) become the first p of them over and over,
    p = 1 + floor((n - a) / (3 + g % 8)).  Rows without an id stay as they are."""
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"),
                       F.crc32(docs[doc_id].cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", JAVA_WS), lambda w: w != "")
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)

    def word(i: Column) -> Column:
        at = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.element_at("w", (at + 1).cast("int"))

    some = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    some = some.withColumn("a", F.when(n > 0, g % n))
    some = some.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
