"""Removal of repeated byte strings by hash-compared suffix sorting.

Every 400-byte window has one anchor: the position of the smallest hash among
its k-grams.  Equal windows have equal anchors at equal offsets, and the
windows of one anchor form one segment of the text, so whatever repeats
repeats among the segments of equal anchors.  Spark groups the anchors by hash:

* a segment that occurs twice as a whole (64-bit digest, among those with the
  same 64-bit anchor hash) is repeated wholly;
* an anchor with a single segment has nothing that repeats;
* what remains, different segments around one anchor, goes to a suffix sort.

The sort orders the segments by what follows their anchor, and by what
precedes it (reversed).  Two suffixes are compared through prefix polynomial
hashes: binary search on the length finds their common extension in
logarithmic time, and one byte decides.  All comparisons of a merge run at
once.  The common extensions of neighbours are then verified byte by byte; on
a hash collision the batch is sorted by its bytes instead.  A window at offset
o before the anchor is repeated when another segment is in its class both to
the left (o bytes) and to the right (length - o bytes).

An anchor with more than ``hot`` different segments would be a large group for
one task; its windows are spread over the cluster instead, by offset and
128-bit digest, and counted with map-side combination.

Defined results: null counts as empty; texts shorter than the length lose
nothing; rows with equal text (also under one id) repeat each other; an empty
table gives no rows; only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlab.llm.common import cut_lineage, holding, may_hold, text_of

LENGTH = 400
GRAM = 32
BASE = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
HOT = 20_000
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


class PrefixHash:
    """Prefix polynomial hashes of a buffer: the hash of any of its substrings
    in constant time."""

    def __init__(self, data: np.ndarray):
        self.inverse = powers(INVERSE, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.prefix[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima of blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, position, first window, last window) of every anchor."""
    n = len(data)
    if n < length:
        return None
    at = np.arange(n - gram + 1)
    h = mixed(PrefixHash(data)(at, gram))
    # The leftmost of the smallest 33 leading bits; equal windows agree on it.
    low = _leftmost((h >> np.uint64(31)).astype(np.int64) << 30, length - gram + 1)
    first = np.flatnonzero(np.diff(low, prepend=-1))
    last = np.append(first[1:], len(low)) - 1
    return h[low[first]].view(np.int64), low[first], first, last


def _leftmost(order: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value of every w neighbours."""
    at = np.arange(len(order), dtype=np.int64)
    # 33 bits of order and 30 bits of position in one number; longer texts go
    # by parts whose windows overlap.
    out, part = np.empty(len(order) - w + 1, np.int64), (1 << 30) - 1
    for lo in range(0, len(out), part - w):
        hi = min(len(order), lo + part)
        out[lo:hi - w + 1] = lo + (sliding_min(order[lo:hi] | at[:hi - lo], w) & ((1 << 30) - 1))
        if hi == len(order):
            break
    return out


class Suffixes:
    """Contexts in one buffer: start position, direction and length limit."""

    def __init__(self, data: np.ndarray, start: np.ndarray, limit: np.ndarray):
        self.data, self.start, self.limit, self.hash = data, start, limit, PrefixHash(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.limit[a], self.limit[b])
        sa, sb = self.start[a], self.start[b]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hash(sa, mid) == self.hash(sb, mid)
            lo, hi = np.where(same & open_, mid, lo), np.where(same | ~open_, hi, mid - 1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a before b; a shorter context comes before its extensions, and
        equal ones are ordered by number."""
        n = self.common(a, b)
        ea, eb = n >= self.limit[a], n >= self.limit[b]
        last = len(self.data) - 1
        x = np.where(ea, -1, self.data[np.minimum(self.start[a] + n, last)])
        y = np.where(eb, -1, self.data[np.minimum(self.start[b] + n, last)])
        return np.where(x == y, a < b, x < y)

    def sort(self) -> np.ndarray:
        """Mergesort from single contexts up; in each round every element
        finds its place in the sibling run by binary search."""
        order, n, run = np.arange(len(self.start)), len(self.start), 1
        while run < n:
            i = np.arange(n)
            block = i // run
            sibling = (block ^ 1) * run
            lo = np.minimum(sibling, n)
            first, end = lo.copy(), np.minimum(sibling + run, n)
            hi = np.maximum(end, lo)
            while (go := lo < hi).any():
                mid = (lo + hi) >> 1
                left = np.zeros(n, bool)
                left[go] = self.less(order[mid[go]], order[i[go]])
                lo, hi = np.where(go & left, mid + 1, lo), np.where(go & ~left, mid, hi)
            base = (block & ~1) * run
            out = np.empty_like(order)
            out[base + (i - block * run) + (lo - first)] = order
            order, run = out, run * 2
        return order

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted order, common extension with the one before), verified."""
        order = self.sort()
        lcp = np.concatenate([[0], self.common(order[:-1], order[1:])]) if len(order) else np.zeros(0, np.int64)
        return (order, lcp) if self._verified(order, lcp) else self._by_bytes()

    def _verified(self, order: np.ndarray, lcp: np.ndarray) -> bool:
        """The extensions are equal, maximal and in order, byte by byte."""
        for lo in range(1, len(order), 2048):
            a, b, n = order[lo - 1:lo + 2047], order[lo:lo + 2048], lcp[lo:lo + 2048]
            a = a[:len(b)]
            span = np.arange(int(n.max()) if len(n) else 0)
            inside, last = span[None, :] < n[:, None], len(self.data) - 1
            x = self.data[np.minimum(self.start[a][:, None] + span, last)]
            y = self.data[np.minimum(self.start[b][:, None] + span, last)]
            if ((x != y) & inside).any():
                return False
            go_on = (n < self.limit[a]) & (n < self.limit[b])
            x, y = self.data[np.minimum(self.start[a] + n, last)], self.data[np.minimum(self.start[b] + n, last)]
            if (go_on & (x >= y)).any() or (~go_on & (n < self.limit[a])).any():
                return False
        return True

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        raw = self.data.tobytes()
        text = [raw[s:s + n] for s, n in zip(self.start.tolist(), self.limit.tolist())]
        order = sorted(range(len(text)), key=text.__getitem__)
        lcp = [0]
        for a, b in zip(order, order[1:]):
            x, y = text[a], text[b]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            lcp.append(n)
        return np.array(order, np.int64), np.array(lcp[:len(order)], np.int64)


def repeated_windows(segments: list[bytes], before: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``segments`` with their anchors at byte ``before[i]``.  Yields (offset,
    numbers of the segments whose window that starts ``offset`` bytes before
    the anchor is also a window of another segment)."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(segments), np.uint8)
    right_order, right = Suffixes(data, begin + before, size - before).neighbours()
    back = np.frombuffer(data.tobytes()[::-1], np.uint8)
    left_order, left = Suffixes(back, len(data) - begin - before, before.copy()).neighbours()
    n = len(segments)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(0, length - gram + 1):
        of_right[right_order] = np.cumsum(right < length - o)
        of_left[left_order] = np.cumsum(left < o)
        long = (before >= o) & (size - before >= length - o)
        some = np.flatnonzero(long)
        if len(some) < 2:
            continue
        both = of_right[some] * (n + 1) + of_left[some]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        if twice.any():
            yield o, some[by[twice]]


# A text's digest, the anchor's hash, the segment's digest, and its place:
# first window << 32 | (last - first window) << 16 | (anchor - first window).
ANCHOR = "d1 long, d2 long, h long, s long, place long"
PLACE = {"first": "place >> 32", "last": "(place >> 32) + ((place >> 16) & 65535)", "p": "(place >> 32) + (place & 65535)"}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    schema = T._parse_datatype_string(ANCHOR)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in arrow]
            rows = 0
            for d1, d2, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = anchors(np.frombuffer(raw, np.uint8), length, gram)
                if found is None:
                    continue
                h, p, first, last = found
                segment = [xxhash.xxh3_64_intdigest(raw[f:e + length], seed=q - f) for q, f, e in zip(p.tolist(), first.tolist(), last.tolist())]
                n = len(h)
                for col, v in zip(cols, (np.full(n, d1), np.full(n, d2), h, np.array(segment, np.uint64).view(np.int64),
                                         first << 32 | (last - first) << 16 | (p - first))):
                    col.append(v)
                rows += n
                if rows > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
                    cols, rows = [[] for _ in arrow], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return texts.where(F.length("raw") >= length).select("d1", "d2", "raw").mapInArrow(run, schema)


SEGMENT = "d1 long, d2 long, h long, p int, first int, alone boolean, hot boolean, segment binary"


def _segments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments, read from their texts; texts without
    any are left out before the shuffle.  Copies of a text may give theirs more
    than once."""
    per = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("h", "p", "first", "last", "alone", "hot")).alias("a"))
    schema = T._parse_datatype_string(SEGMENT)
    arrow = to_arrow_schema(schema)

    def run(batches):
        before = None
        for b in batches:
            for i in range(b.num_rows):
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if key == before:           # copies of a text lie next to each other after the join
                    continue
                before, raw = key, b.column(2)[i].as_py()
                rows = [(*key, x["h"], x["p"], x["first"], x["alone"], x["hot"], raw[x["first"]:x["last"] + length]) for x in b.column(3)[i].as_py()]
                for lo in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[lo:lo + 5000]), arrow)], schema=arrow)

    # A merge join keeps the copies of a text together.
    some = texts.where(holding(may_hold(wanted.select("d1").distinct(), "d1"), "d1"))
    return some.join(per.hint("merge"), ["d1", "d2"]).select("d1", "d2", "raw", "a").mapInArrow(run, schema)


def _covered_by_sort(segments: DataFrame, length: int, gram: int, batch_bytes: int = 2 << 20) -> DataFrame:
    """(d1, d2, first, last): runs of repeated windows of the segments that
    occur once, from suffix sorts of whole anchor groups."""
    schema = T._parse_datatype_string("d1 long, d2 long, first int, last int")
    arrow = to_arrow_schema(schema)

    def solve(rows):
        seg = [r[5] for r in rows]
        before = np.array([r[3] - r[4][0] for r in rows], np.int64)
        found: dict[int, list[int]] = {}
        for o, which in repeated_windows(seg, before, length, gram):
            for i in which.tolist():
                if rows[i][4][1]:
                    found.setdefault(i, []).append(rows[i][3] - o)
        out = []
        for i, starts in found.items():
            starts = np.sort(np.array(starts))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                out.append((rows[i][0], rows[i][1], int(run[0]), int(run[-1])))
        return out

    def run(batches):
        rows, size, last, before = [], 0, None, None
        for b in batches:
            for d1, d2, h, p, first, alone, _, seg in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (h, d1, d2, p) == before:
                    continue
                before = (h, d1, d2, p)
                if size > batch_bytes and h != last:
                    if out := solve(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    rows, size = [], 0
                rows.append((d1, d2, h, p, (first, alone), seg))
                size, last = size + len(seg), h
        if rows and (out := solve(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return segments.repartition("h").sortWithinPartitions("h", "d1", "d2", "p").mapInArrow(run, schema)


def _covered_by_count(segments: DataFrame, length: int) -> DataFrame:
    """The same for the anchors with very many segments, window by window."""
    schema = T._parse_datatype_string("d1 long, d2 long, alone boolean, first int, o int, w1 long, w2 long")
    arrow = to_arrow_schema(schema)
    mask = (1 << 64) - 1

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                out = []
                part = b.slice(lo, 100)
                for d1, d2, h, p, first, alone, _, seg in zip(*(part.column(i).to_pylist() for i in range(8))):
                    for s in range(len(seg) - length + 1):
                        w = xxhash.xxh3_128_intdigest(seg[s:s + length], seed=h & mask)
                        out.append((d1, d2, alone, first + s, p - first - s, _signed(w & mask), _signed(w >> 64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    windows = segments.mapInArrow(run, schema)
    twice = windows.groupBy("o", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.where("alone").join(twice, ["o", "w1", "w2"], "left_semi").select("d1", "d2", "first", F.col("first").alias("last"))


def _found(docs: DataFrame, length: int, gram: int, hot: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, raw, d1, d2), and per digest with any the runs of
    repeated windows, as first << 31 | last."""
    raw = text_of(docs, text).cast("binary")
    sha = F.sha2(F.col("raw"), 256)
    half = lambda i: F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long")  # noqa: E731  two times 60 bits
    texts = docs.select(docs[doc_id].alias("doc_id"), raw.alias("raw")).select("doc_id", "raw", half(0).alias("d1"), half(1).alias("d2"))
    found = cut_lineage(_anchors(texts, length, gram))
    # Segments by digest, then by anchor; the counts combine on the map side.
    kinds = found.groupBy("h", "s").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("d1", "d2", "place")])
    kinds = cut_lineage(kinds.join(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "h").where("n > 1 or kinds > 1"))
    place = {c: F.expr(f"cast({e} as int)").alias(c) for c, e in PLACE.items()}
    whole = found.join(kinds.where("n > 1").select("h", "s"), ["h", "s"], "left_semi").select("d1", "d2", place["first"], place["last"])
    wanted = kinds.where("kinds > 1").select("d1", "d2", "h", place["p"], place["first"], place["last"], (F.col("n") == 1).alias("alone"), (F.col("kinds") > hot).alias("hot"))
    segments = _segments(texts, wanted, length)
    parts = whole.unionByName(_covered_by_sort(segments.where("not hot"), length, gram))
    if not kinds.where(F.col("kinds") > hot).isEmpty():
        parts = parts.unionByName(_covered_by_count(segments.where("hot").dropDuplicates(["d1", "d2", "p"]), length))
    # One number per run, so that the set of a text's runs drops its copies' ones.
    runs = cut_lineage(parts.groupBy("d1", "d2").agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 31) + F.col("last")).alias("runs")))
    return texts, runs


def spans(runs: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte spans of runs of window starts."""
    out: list[list[int]] = []
    for r in sorted(runs):
        a, b = r >> 31, (r & ((1 << 31) - 1)) + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    ``spans`` (start, end of the removed bytes)."""
    texts, runs = _found(docs, length, gram, hot, doc_id, text)
    schema = T.StructType([texts.schema["doc_id"]] + T._parse_datatype_string(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>").fields)
    arrow = to_arrow_schema(schema)

    some = may_hold(runs.select("d1"), "d1")

    def kept(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        out = []
        for raw, own in zip(b.column(1).to_pylist(), found):
            gone, at, rest = spans(own or [], length), 0, hashlib.sha256()
            for s, e in gone:
                rest.update(raw[at:s])
                at = e
            rest.update(raw[at:])
            out.append((len(raw), sum(e - s for s, e in gone), len(gone), rest.hexdigest(), gone))
        return pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type)] + [pa.array(c, type=f.type) for c, f in zip(zip(*out), list(arrow)[1:])], schema=arrow)

    def whole(batches):
        for b in batches:
            b = b.filter(pa.array(~some(b.column(2))))
            if b.num_rows:
                yield kept(b, [None] * b.num_rows)

    def cut(batches):
        for b in batches:
            if b.num_rows:
                yield kept(b, b.column(2).to_pylist())

    # Texts that have no runs are not shuffled.
    rest = texts.where(holding(some, "d1")).join(runs, ["d1", "d2"], "left").select("doc_id", "raw", "runs")
    return texts.select("doc_id", "raw", "d1").mapInArrow(whole, schema).unionByName(rest.mapInArrow(cut, schema))
