"""Sequence packing as a cutting-stock problem, solved by column generation.

Every document is tokenized once and cut into full pieces of the sequence
length, a piece of a multiple of the grain, and a tail shorter than the grain.
So there are few different lengths, and short tails to fill up with.  Only the
histogram of the lengths goes to the driver.  There a linear program over patterns
(multisets of lengths that fit one sequence) is solved by column generation:
knapsack dynamic programming prices the next pattern with the program's dual
values.  The pattern counts are rounded down, the few pieces left over are
packed largest first, and Spark assigns the patterns to the pieces by their
rank within each length.

Defined results: null counts as empty, so that document is the end token
alone; every row is a document of its own, repeated ones too; an empty table
gives no pieces; ranks follow the order of the input's partitions, so pieces
of equal length may swap places when the input is partitioned differently.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlab.llm.common import cut_lineage, text_of
from fieldlab.llm.op5_bpe import BYTES
from fieldlab.llm.pretokens import Pieces

END = b"\0\0\0\0"        # the end token, id 0, as a little-endian unsigned 32-bit number
_WORKER: dict = {}


def ranked(tokenizer_json: str, pattern: str):
    """The same tokenizer as a tiktoken encoding, which is several times
    faster, or None if it has no such form: byte-level BPE without
    normalisation whose merges stand in the order of their ids."""
    import public_tokenizers
    import tiktoken
    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and pattern == public_tokenizers.PATTERN
             and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not plain:
        return None
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"]["".join(m)] for m in merged]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {p.translate(BYTES).encode("latin-1"): i for p, i in model["vocab"].items() if p not in special}
    if order != sorted(order) or order[0] < 256 or len(ranks) != 256 + len(order):
        return None
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Token ids of texts as packed little-endian 32-bit numbers.  A text that
    spells a special token is encoded by the tokenizer itself, since that token
    is matched before the pattern.  Without a ranked form, and for texts whose
    white-space runs exceed its pattern engine, distinct pre-tokens are encoded
    once per worker."""

    def __init__(self, tokenizer_json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = ranked(tokenizer_json, pattern)
        self.pieces = Pieces(pattern, self._encode, b"".join, bound=200_000)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode([text])[0]
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:          # the pattern engine's stack is exceeded
                pass
        return b"".join(self.pieces([text])[0])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


def cuts(n: int, size: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    out = [(s, size) for s in range(0, n - size + 1, size)]
    at = len(out) * size
    middle = (n - at) // grain * grain
    return out + [p for p in ((at, middle), (at + middle, n - at - middle)) if p[1]]


def pieces_of(docs: DataFrame, tokenizer_json: str, pattern: str, size: int = 1024, grain: int = 32,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and its
    place in the input: partition ``part`` and rank ``k`` among the pieces of
    that length there."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pattern))
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"]] + T._parse_datatype_string(
        "start long, length long, ids_crc32 long, doc_tokens long, part int, k long").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        key = hashlib.sha256("".join(shared.value).encode()).digest()
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Ids(*shared.value)
        ids, part = _WORKER[key], TaskContext.get().partitionId()
        ranks = [0] * (size + 1)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                out, index = [], []
                for i, buf in enumerate(ids(some.column(1).to_pylist())):
                    buf += END
                    n = len(buf) // 4
                    for start, length in cuts(n, size, grain):
                        out.append((start, length, zlib.crc32(buf[4 * start:4 * (start + length)]), n, part, ranks[length]))
                        ranks[length] += 1
                        index.append(i)
                own = some.column(0).take(pa.array(index)).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([own] + [pa.array(c, type=f.type) for c, f in zip(zip(*out), list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(run, schema)


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern
    that fits, as {index of a size: copies}."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - sizes[:fits[c]]] + values[:fits[c]]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], choice[c] = got[i], i
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[int(choice[c])] = pattern.get(int(choice[c]), 0) + 1
            c -= int(sizes[choice[c]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, steps: int = 4000):
    """Column generation by the revised simplex method.  Returns the basic
    patterns and their fractional counts.  Stops when the dual bound proves
    the total within ``gap`` of the optimum (any earlier stop is feasible)."""
    m = len(sizes)
    copies = capacity // sizes
    patterns: list[dict[int, int]] = [{i: int(copies[i])} for i in range(m)]
    inverse, x = np.diag(1.0 / copies), demand / copies
    bound = 0.0
    for _ in range(steps):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, duals, capacity)
        bound = max(bound, float(duals @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() - bound <= gap * bound:
            break
        index = np.fromiter(pattern, int)
        u = inverse[:, index] @ np.fromiter(pattern.values(), float)
        ok = u > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / u[ok]
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        x = np.maximum(x - step * u, 0.0)
        x[out] = step
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}) and how often each is used; together they
    hold every piece of the histogram exactly once."""
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    if left:
        sizes = np.array(sorted(left))
        patterns, x = solve(sizes, np.array([left[int(s)] for s in sizes], float), capacity)
        for pattern, count in sorted(zip(patterns, x), key=lambda p: -p[1]):
            named = {int(sizes[i]): a for i, a in pattern.items()}
            n = min([int(count + 1e-6), *(left[s] // a for s, a in named.items())])
            if n > 0:
                out.append((named, n))
                for s, a in named.items():
                    left[s] -= a * n
    # Fewer pieces than patterns times copies are left: largest first, each
    # sequence filled with the largest pieces that still fit.
    rest = sorted(s for s, n in left.items() if n)
    while rest:
        room, pattern = capacity, {}
        for s in reversed(rest):
            if a := min(left[s], room // s):
                pattern[s], room = a, room - a * s
        n = min(left[s] // a for s, a in pattern.items())
        out.append((pattern, n))
        for s, a in pattern.items():
            left[s] -= a * n
        rest = [s for s in rest if left[s]]
    return out


def segments(plans: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first rank, end rank, first sequence, copies, first offset) of
    the pieces that each pattern takes."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plans:
        offset = 0
        for s, a in sorted(pattern.items(), reverse=True):
            lo = used.get(s, 0)
            out.append((s, lo, lo + a * n, sequence, a, offset))
            used[s], offset = lo + a * n, offset + a * s
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_json: str, pattern: str, size: int = 1024, grain: int = 32,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut_lineage(pieces_of(docs, tokenizer_json, pattern, size, grain, doc_id, text))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_size: dict[int, list] = {}
    for s, *rest in segments(plan(histogram, size)):
        by_size.setdefault(s, []).append(tuple(rest))
    # At most ``size`` rows, and no more segments than patterns times lengths:
    # the plan does not grow with the documents.
    plans = docs.sparkSession.createDataFrame(
        list(by_size.items()), "length long, segs array<struct<lo: long, hi: long, seq: long, copies: long, offset: long>>")
    rank = F.col("base") + F.col("k")
    return (pieces.join(base, ["part", "length"]).join(F.broadcast(plans), "length").withColumn("rank", rank)
            .withColumn("seg", F.expr("filter(segs, s -> s.lo <= rank and rank < s.hi)[0]"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    F.expr("seg.seq + (rank - seg.lo) div seg.copies").alias("sequence_id"),
                    F.expr("seg.offset + (rank - seg.lo) % seg.copies * length").alias("offset")))
