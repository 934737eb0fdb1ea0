"""Substring dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_cases import SF001, empty, frame, multiset, rows

from fieldlab.llm import op3_substring as O3
from fieldlab.llm import op4_simhash as O4


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def own(spark, docs, **kw):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return multiset(map(tuple, O3.dedup(docs, **kw).select(cols).collect()))


@pytest.mark.parametrize("kw", [dict(), dict(length=60, gram=12), dict(length=60, gram=12, hot=1), dict(length=25, gram=8)])
def test_substrings_cases(spark, kw):
    few = [r for r in rows() if len(r[1] or "") < 50_000] if kw else rows()
    docs = spark.createDataFrame(few, frame(spark).schema).repartition(3)
    want = [(r[0], *x) for r, x in zip(few, removed([r[1] for r in few], kw.get("length", 400)))]
    assert own(spark, docs, **kw) == multiset(want)


def test_substrings_tables(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    all_ = docs.select("doc_id", "text").collect()
    assert own(spark, docs) == multiset((r.doc_id, *x) for r, x in zip(all_, removed([r.text for r in all_], 400)))
    assert O3.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_edited_passages(spark, seed):
    """One passage with many surroundings and edits: many segments per anchor."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = some(1500)
    texts = []
    for _ in range(60):
        a = rng.randrange(0, 900)
        t = list(passage[a:a + rng.randrange(380, 700)])
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = "#"
        texts.append(some(rng.randrange(0, 50)) + "".join(t) + some(rng.randrange(0, 50)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = multiset((i, *x) for i, x in enumerate(removed(texts, 400)))
    assert own(spark, docs) == want
    assert own(spark, docs, hot=3) == want


def test_suffix_sort_and_collisions(monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab") for _ in range(700))
    start = np.array(rng.sample(range(600), 200))
    limit = np.array([rng.randrange(0, 100) for _ in start])
    text = [raw[s:s + n] for s, n in zip(start, limit)]

    def check():
        order, lcp = O3.Suffixes(np.frombuffer(raw, np.uint8), start, limit).neighbours()
        got = [text[i] for i in order]
        assert got == sorted(text)
        for a, b, n in zip(got, got[1:], lcp[1:]):
            assert a[:n] == b[:n] and a[n:n + 1] != b[n:n + 1] or a == b and n == len(a)
    check()
    # A hash under which everything collides is found out by the bytes.
    monkeypatch.setattr(O3.PrefixHash, "__call__", lambda self, start, length: np.zeros(len(start), np.uint64))
    check()


def test_anchor_is_leftmost():
    data = np.frombuffer(b"abc" * 300, np.uint8)
    h, p, first, last = O3.anchors(data, 60, 12)
    assert first[0] == 0 and last[-1] == len(data) - 60 and (first[1:] == last[:-1] + 1).all() and (p >= first).all() and (p <= first + 48).all()


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\n" if c in " \t\n\x0b\f\r" else c for c in words).split("\n") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=2):
    """Smallest reachable id of every fingerprint, by all pairs."""
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {x: find(x) for x in distinct}


def components(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = classes(prints)
    least = {}
    for (d, _), p in zip(docs, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    return [(d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(docs, prints)]


def test_simhash_cases(spark):
    got = O4.near_dedup(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()
    want = components([r[:2] for r in rows()])
    assert multiset(map(tuple, got)) == multiset(want)
    kept = O4.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len(set(classes([int(f, 16) for _, f, _ in want]).values()))
    assert O4.near_dedup(empty(spark)).count() == 0 and O4.keep_one(empty(spark)).count() == 0


def test_simhash_tables(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = O4.near_dedup(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert multiset(map(tuple, got)) == multiset(components([(r.doc_id, r.text) for r in docs.collect()]))


def test_links_and_chains(spark):
    """Clusters, chains and border distances over random fingerprints."""
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame_ = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.root for r in O4.grouped(frame_, 2).collect()}
    want = classes(prints)
    sets = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert sets({x + (1 << 64) * (x < 0): r + (1 << 64) * (r < 0) for x, r in got.items()}) == sets(want)


def test_long_chain_of_components(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in O4.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_may_hold_lets_all_keys_through(spark):
    from pyspark.sql import functions as F

    from fieldlab.llm.common import holding, may_hold
    keys = spark.range(-3_000, 3_000).select(F.xxhash64("id").alias("k"))
    other = spark.range(10_000, 50_000).select(F.xxhash64("id").alias("k"))
    some = holding(may_hold(keys, "k"), "k")
    assert keys.where(some).count() == 6_000 and other.where(some).count() < 8_000
    full = holding(may_hold(keys, "k", most_bits=1 << 10), "k")          # a full table lets everything through
    assert keys.where(full).count() == 6_000 and other.where(full).count() > 30_000
    assert other.where(holding(may_hold(keys.where("false"), "k"), "k")).count() == 0
