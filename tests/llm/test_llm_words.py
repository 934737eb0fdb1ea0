"""Period runs, SentencePiece and spelling variants against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import SF001, SF01, empty, frame, multiset, rows

from fieldlab.llm import op11_runs as O11
from fieldlab.llm import op12_sentencepiece as O12
from fieldlab.llm import op13_spelling as O13
from fieldlab.llm.queries import QUERIES

MODEL = O12.read_model(P.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_runs(w, length=24, power=3):
    """All runs, period by period."""
    found = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(length, power * q) and not any(w[s:s + n - d] == w[s + d:s + n] for d in range(1, q)):
                found.append((s, n, q))
            i += 1
    return sorted(found)


def altered(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = altered(doc_id, WORD.findall(text or ""))
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_of_any_words(data):
    letters = st.sampled_from([b"a", b"b", b"c"][:data.draw(st.integers(1, 3))])
    unit, n = data.draw(st.lists(letters, min_size=1, max_size=9)), data.draw(st.integers(0, 70))
    w = data.draw(st.lists(letters, max_size=30)) + [unit[i % len(unit)] for i in range(n)] + data.draw(st.lists(letters, max_size=30))
    for length, power in ((24, 3), (6, 3), (8, 2)):
        assert O11.runs_of(w, length, power) == plain_runs(w, length, power)


def test_suffix_order():
    rng = random.Random(2)
    w = [rng.randrange(3) for _ in range(90)] * 2
    order, common = O11.suffix_order(O11.np.array(w))
    assert [w[i:] for i in order] == sorted(w[i:] for i in range(len(w)))
    for i, j, n in zip(order, order[1:], common):
        assert w[i:i + n] == w[j:j + n] and w[i:i + n + 1] != w[j:j + n + 1]


def test_ordered_positions_in_blocks():
    rng, s = random.Random(3), O11.Positions(500_000)
    some = rng.sample(range(400_000), 5_000)
    for x in some:
        s.add(x)
    want = sorted([*some, 500_000])
    assert list(s) == want and len(s.blocks) > 2
    for i, x in enumerate(want):
        assert s.around(x) == (want[i - 1] if i else None, want[i + 1] if i + 1 < len(want) else None)


def test_long_runs():
    assert O11.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    assert O11.runs_of([b"%d" % (i % 4_000) for i in range(15_000)]) == [(0, 15_000, 4_000)]
    assert O11.strongest([(0, 30, 9), (5, 24, 4), (40, 48, 8)]) == (5, 24, 4) and O11.strongest([]) is None


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_detect_against_brute_force(spark, what):
    if what == "sf":
        got = QUERIES["op11_period_runs"](spark, SF001)
        docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
        assert multiset(map(tuple, got.collect())) == multiset(digest(r.doc_id, r.text) for r in docs)
        assert got.where("n_runs > 0").count() > 0
        return
    got = O11.detect(frame(spark))
    want = []
    for r in rows():
        w = WORD.findall(r[1] or "")
        runs = plain_runs(w) if len(w) < 5_000 else []
        want.append((r[0], [tuple(x) for x in runs], O11.strongest(runs)))
    assert multiset((r.doc_id, [tuple(x) for x in r.runs], r.best and tuple(r.best)) for r in got.collect()) == multiset(want)
    assert O11.detect(empty(spark)).count() == 0 and O11.with_repeats(empty(spark)).count() == 0
    changed = {r.doc_id: r.text for r in O11.with_repeats(frame(spark).where("doc_id != 500")).collect()}
    for r in rows():
        if r[0] in changed:
            assert WORD.findall(changed[r[0]]) == altered(r[0], WORD.findall(r[1] or ""))


CHARS = st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t▁ theingé"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=CHARS, max_size=40))
def test_any_text_as_the_library(text):
    table = O12._table(MODEL)
    cut = O12.chunks(text)
    table.learn([cut])
    want = LIBRARY.encode(text, add_eos=True)
    assert [i for c in cut for i in table.ids[c].tolist()] + [table.end] == want
    assert table.decoded(cut) == LIBRARY.decode(want)


def test_a_full_table_is_emptied():
    table = O12.Table(MODEL, limit=2_000)
    for k in range(40):
        cut = O12.chunks(f"some word{k} <s> ▁ é{k}  two")
        table.learn([cut])
        assert [i for c in cut for i in table.ids[c].tolist()] == LIBRARY.encode(f"some word{k} <s> ▁ é{k}  two")
    assert len(table.ids) < 40


def test_models_that_chunks_do_not_suit():
    from sentencepiece import sentencepiece_model_pb2 as pb
    for change in ("norm", "piece", "suffix"):
        m = pb.ModelProto.FromString(MODEL)
        if change == "norm":
            m.normalizer_spec.remove_extra_whitespaces = True
        elif change == "piece":
            m.pieces.add(piece="of▁the", score=-1.0)
        else:
            m.trainer_spec.treat_whitespace_as_suffix = True
        with pytest.raises(ValueError):
            O12.checked(m.SerializeToString())


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_round_trip_as_the_library(spark, what):
    docs = frame(spark) if what == "cases" else spark.read.parquet(f"{SF001}/documents.parquet")
    got = O12.round_trip(docs, MODEL) if what == "cases" else QUERIES["op12_sentencepiece"](spark, SF001)
    want, texts = [], []
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))))
        texts.append((r.doc_id, LIBRARY.decode(ids)))
    assert multiset(map(tuple, got.collect())) == multiset(want)
    ids = O12.encode(docs, MODEL)
    assert multiset(map(tuple, O12.decode(ids, MODEL).collect())) == multiset(texts)
    assert O12.round_trip(empty(spark), MODEL).count() == 0
    assert O12.encode(docs, MODEL, end=False).where("array_contains(ids, 2)").count() == 0


def plain_variants(n, ratio=5):
    """Near words through the words with one code point left out."""
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
    near = {w: {x for i in range(len(w)) for x in holes[w[:i], w[i + 1:]]} - {w} for w in n}
    for w in n:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in n:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(str.maketrans(O13.UPPER, O13.LOWER))
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def test_any_vocabulary(spark):
    rng = random.Random(5)
    n = {}
    for _ in range(400):
        w = [rng.choice("abé") for _ in range(rng.randint(6, 9))]
        n["".join(w)] = rng.choice([5, 6, 25, 30, 150, 900])
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice(["", "x", "ab", "ÿ"])
            n["".join(w)] = rng.choice([5, 5, 7, 40, 4_000])
    n = {w: k for w, k in n.items() if len(w) >= 6} | {"chaina": 5, "chainab": 25, "chainabc": 125, "chainabcd": 625, "chainabcde": 3125}
    got = O13.variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(4))
    want = plain_variants(n)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert multiset(map(tuple, got.collect())) == multiset(want)
    assert next(r for r in want if r[0] == "chaina")[2] == "chainabcde"


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_variants_of_documents(spark, what):
    if what == "cases":
        docs, made = frame(spark), None
        made = O13.variants(O13.counts(O13.with_slips(O13.runs(docs))))
    else:
        docs, made = spark.read.parquet(f"{SF01}/documents.parquet"), QUERIES["op13_spelling"](spark, SF01)
    n = plain_words((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = made.collect()
    assert len(n) > 20 and multiset(map(tuple, got)) == multiset(plain_variants(n))
    assert what == "cases" or any(r.form for r in got)


def test_empty_vocabulary(spark):
    assert O13.variants(O13.counts(O13.with_slips(O13.runs(empty(spark))))).count() == 0
