"""Byte-level BPE and packing against the public tokenizer libraries."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF001, empty, frame, multiset, rows, texts
from tokenizers import Tokenizer

from fieldlab.llm import op5_bpe as O5
from fieldlab.llm import op8_packing as O8

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
PROTO = O5.model_proto(O5.read_ranks(P.path("byte_bpe_50k.tiktoken")))
CODEC = O5.Codec(PROTO, P.PATTERN)
IDS = O8.Ids(JSON, P.PATTERN)
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_every_vocabulary_entry_is_one_token():
    assert CODEC.tokens == [t for t, _ in sorted(RANKS.items(), key=lambda x: x[1])]


def test_ids_of_long_white_space():
    """Runs that the ranked form's pattern engine cannot take go the other way."""
    assert IDS.ranked is not None
    for text in ("a" + " " * 1_500_000 + "b", "\n\t" * 600_000, "é" * 100_000):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert IDS([text])[0] == np.array(want, "<u4").tobytes()


def test_tokenizers_without_a_ranked_form():
    import json
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        assert O8.ranked(json.dumps(json.loads(JSON) | change), P.PATTERN) is None
    spec = json.loads(JSON)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    assert O8.ranked(json.dumps(spec), P.PATTERN) is None and O8.ranked(JSON, r"\S+|\s+") is None
    slow = O8.Ids(JSON, P.PATTERN)
    slow.ranked = None
    assert slow(texts()[1:]) == IDS(texts()[1:])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t'santer")), max_size=60))
def test_any_text(text):
    ids = TIKTOKEN.encode_ordinary(text)
    assert CODEC.encode([text])[0] == ids
    assert CODEC.decode(ids) == text.encode()
    assert IDS([text])[0] == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_merges_without_the_vocabulary_lookup():
    """Sentencepiece alone reaches the same ids for whole vocabulary entries."""
    some = [t for t in RANKS if len(t) > 2][::37]
    for t, ids in zip(some, CODEC.sp.encode([O5.mapped(t) for t in some])):
        assert [x - 1 for x in ids] == [RANKS[t]]


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_round_trip(spark, what):
    docs = frame(spark) if what == "cases" else spark.read.parquet(f"{SF001}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert multiset(map(tuple, O5.round_trip(docs, PROTO, P.PATTERN).collect())) == multiset(want)
    assert O5.round_trip(empty(spark), PROTO, P.PATTERN).count() == 0
    assert sum(len(r.ids) for r in O5.encode(docs, PROTO, P.PATTERN).collect()) == sum(w[1] for w in want)


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_packing(spark, what):
    docs = frame(spark) if what == "cases" else spark.read.parquet(f"{SF001}/documents.parquet")
    got = O8.pack(docs, JSON, P.PATTERN).collect()
    all_ = docs.select("doc_id", "text").collect()
    ids = [TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0] for r in all_]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    # Every piece that the documents need is there, as often as needed.
    want = Counter((r.doc_id, len(x), s, n, crc(x[s:s + n])) for r, x in zip(all_, ids) for s, n in O8.cuts(len(x), 1024, 32))
    assert Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    tokens = sum(map(len, ids))
    assert 1024 * len(by) - tokens < 0.01 * tokens + 1024
    assert O8.pack(empty(spark), JSON, P.PATTERN).count() == 0


def test_cuts():
    for n in (1, 31, 32, 33, 1023, 1024, 1025, 1056, 5000):
        c = O8.cuts(n, 1024, 32)
        assert [s for s, _ in c] == list(np.cumsum([0] + [k for _, k in c])[:-1]) and sum(k for _, k in c) == n


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=12))
def test_plan_holds_every_piece(histogram):
    plans = O8.plan(dict(histogram), 64)
    used = Counter()
    for pattern, n in plans:
        assert sum(s * a for s, a in pattern.items()) <= 64 and n > 0
        for s, a in pattern.items():
            used[s] += a * n
    assert used == Counter(histogram)
    segs = O8.segments(plans)
    for s in histogram:
        spans = sorted((lo, hi) for x, lo, hi, *_ in segs if x == s)
        assert spans[0][0] == 0 and spans[-1][1] == histogram[s] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_column_generation_reaches_the_optimum():
    """A classic instance: 97 pieces of 45, 610 of 36, 395 of 31, 211 of 14 from rolls of 100 need 452.25."""
    _, x = O8.solve(np.array([14, 31, 36, 45]), np.array([211.0, 395.0, 610.0, 97.0]), 100, gap=0.0)
    assert abs(x.sum() - 452.25) < 1e-6


def test_knapsack_against_brute_force():
    sizes, values = np.array([3, 5, 7]), np.array([2.0, 3.7, 5.1])
    best = max(a * 2.0 + b * 3.7 + c * 5.1 for a in range(8) for b in range(6) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    value, pattern = O8.best_pattern(sizes, values, 23)
    assert abs(value - best) < 1e-9 and sum(sizes[i] * a for i, a in pattern.items()) <= 23


def test_cases_cover_special_tokens():
    assert any("<|endoftext|>" in (t or "") for t in texts()) and len(rows()) > len(texts())
