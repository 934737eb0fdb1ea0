"""Language, toxicity and license scan: brute force and held-out accuracy."""

import itertools
import math
import re
import zlib

import numpy as np
from llm_cases import SF01, empty, frame, multiset, rows

from fieldlab.llm import op6_toxicity as O6
from fieldlab.llm import op7_licenses as O7
from fieldlab.llm import op9_language as O9


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r.doc_id: r for r in O9.identify(docs, O9.fit(docs)).collect()}
    all_ = docs.collect()
    assert all(got[r.doc_id].held_out == held_out(r.doc_id) for r in all_)
    tested = [got[r.doc_id].lang_pred == r.lang for r in all_ if held_out(r.doc_id) and r.lang]
    assert len(tested) > 100 and sum(tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_equals_plain_form_and_backs_off(spark):
    docs = frame(spark)
    model = O9.fit(docs)
    got = O9.identify(docs, model).collect()
    want = [(r[0], held_out(r[0]), *model.predict(r[1] or "")) for r in rows()]
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6))
    assert multiset(map(key, map(tuple, got))) == multiset(map(key, want))
    m = O9.Model.of(["de", "en"], {"the": {"en": 9}, "der": {"de": 9}}, {"^": {"de": 1, "en": 1}, "sch": {"de": 5}, "th": {"en": 3}}, 3)
    assert m.predict("schuh")[0] == "de" and m.predict("ath")[0] == "en" and m.predict("the schuh the")[0] == "en"
    assert m.predict("")[0] == m.predict("123 !")[0] == "und"


def test_language_without_rows(spark):
    model = O9.fit(empty(spark))
    assert O9.identify(empty(spark), model).count() == 0
    assert {r.lang_pred for r in O9.identify(frame(spark), model).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    small, usual = O9.fit(docs, sample_docs=10), O9.fit(docs)
    assert 2 * small.nbytes() < usual.nbytes() < 60 << 20
    got = {r.doc_id: r.lang_pred for r in O9.identify(docs, small).collect()}
    tested = [got[r.doc_id] == r.lang for r in docs.collect() if held_out(r.doc_id) and r.lang]
    assert sum(tested) / len(tested) > 0.9
    assert len(O9.fit(docs, max_langs=2).langs) == 2


def test_language_with_rare_words_only_stays(spark):
    """A language whose words all occur once is learned like any other, and so
    is one whose rows hold no word."""
    some = [i for i in range(400) if not held_out(i)]
    rare = ["".join("abcdefgh"[(k // 8 ** p) % 8] for p in range(4)) for k in range(33_000)]
    data = [(i, " ".join(["the", "and", "of"] * 30), "a") for i in some[:30]]
    data += [(i, " ".join(rare[1_100 * k:1_100 * (k + 1)]), "b") for k, i in enumerate(some[30:60])]
    data += [(some[60], "12 ²½", "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = O9.fit(docs)
    assert model.langs == ["a", "b", "c"]
    got = {r.doc_id: r.lang_pred for r in O9.identify(docs, model).collect()}
    assert all(got[i] == x for i, _, x in data[:60]) and got[some[60]] == "und"


def test_language_letters_only(spark):
    texts = ["²½①Ⅷ 12 _ !", "½a½", None, "", "İ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = O9.Model.of(["x", "y"], {"a": {"y": 3}}, {}, 0)
    got = {r.doc_id: r.lang_pred for r in O9.identify(docs, m).collect()}
    assert got == {0: "und", 1: "y", 2: "und", 3: "und", 4: "x"}


def test_language_hashes_are_those_of_spark(spark):
    keys = ["", "a", "^é$", "ß" * 40, "語"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").selectExpr("xxhash64(k) h").collect()
    assert [r.h for r in got] == O9.hashes(keys).tolist()


def test_language_ties_go_to_the_smaller_name(spark):
    m = O9.Model.of(["x", "y", "z"], {"a": {"z": 2, "y": 2}}, {}, 0)
    docs = spark.createDataFrame([(1, "a a"), (2, "unknown")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in O9.identify(docs, m).collect()} == {1: "y", 2: "x"}


def test_language_long_text_in_blocks(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = O9.fit(docs)
    text = " ".join(r.text or "" for r in docs.where("lang is not null").limit(300).collect())
    assert len(text) > 3 * O9.CHUNK
    got = O9.identify(spark.createDataFrame([(1, text), (2, "the")], "doc_id long, text string"), model).collect()
    want = model.predict(text)
    assert [(r.lang_pred, round(r.score, 6)) for r in got if r.doc_id == 1] == [(want[0], round(want[1], 6))]


def test_language_rare_and_hot(spark):
    """Each language has its own share: one at 0.01 % of the rows is learned
    from all of them, a hot one from ``sample_docs``; a language whose rows
    have one id is learned too."""
    some = [i for i in range(60_000) if not held_out(i)]
    rare, one_id, hot = some[:3], some[3], some[4:30_004]
    data = ([(i, "zorp quxly vint", "xx") for i in rare] + [(one_id, "mbolo ntaku", "yy")] * 400
            + [(i, f"the word number w{'abcdefghij'[i % 10]}", "en") for i in hot])
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = O9.fit(docs, sample_docs=100)
    assert model.langs == ["en", "xx", "yy"]
    assert model.predict("quxly vint")[0] == "xx" and model.predict("mbolo")[0] == "yy" and model.predict("the word")[0] == "en"
    assert math.exp(model.scores(["zorp"])[0][1]) > 0.15          # all three rows, not one


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(3)
    moves, first = rng.normal(size=(2, 2)), 0.4
    field = O6.Field({}, 0.0, first, moves, None)
    emission = rng.normal(size=30)
    lengths = [1, 4, 7, 2, 6]
    codes = rng.integers(0, 30, sum(lengths))
    chain = np.repeat([0, 2, 3, 7, 9], lengths)
    got, at = field.marginals(codes, chain, emission), 0
    for n in lengths:
        e, total, on = emission[codes[at:at + n]], 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(np.dot(tags, e) + first * tags[0] + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total, on = total + w, on + w * np.array(tags)
        assert np.allclose(got[at:at + n], on / total)
        at += n


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    field = O6.fit(docs, labels)
    got = {r.doc_id: r for r in O6.tag(docs, field).collect()}
    assert len(got) == docs.count() and all(r.held_out == held_out(d) and 0 <= r.score <= 1 for d, r in got.items())
    tested = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if held_out(r.doc_id)]
    right = sum((s >= 0.3) == (t == 1) for s, t in tested) / len(tested)
    assert len(tested) > 50 and right > 0.93
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [(r.doc_id, s) for r in got.values() for s in r.spans]
    assert spans and all(texts[d][s.start:s.end].isalpha() for d, s in spans)


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows())] + [(3, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    field = O6.fit(frame(spark), labels)
    assert O6.tag(frame(spark), field).count() == len(rows())
    none = O6.fit(empty(spark), labels.limit(0))
    assert O6.tag(empty(spark), none).count() == 0
    assert {r.score for r in O6.tag(frame(spark), none).collect()} == {0.0}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    return len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_license_base(spark):
    for docs in (frame(spark), spark.read.parquet(f"{SF01}/documents.parquet")):
        got = O7.scan(docs).collect()
        want = [(r.doc_id, *license_base(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert multiset((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == multiset(want)
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
            assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
            assert (r.score > 0) == (r.labels != "")
    assert O7.scan(empty(spark)).count() == 0


def test_license_diagonals(spark):
    bsd = next(t for label, t in O7.TEMPLATES if label == "bsd")
    words = bsd.split()
    edited = " ".join(words[:6] + ["and", "also"] + words[6:12] + words[13:])
    texts = ["foo bar " + bsd + " baz", "x " * 40 + edited, " ".join(reversed(words)), " ".join(words[:5]), "a b c " * 50 + bsd + " q " + bsd, None]
    got = {r.doc_id: r for r in O7.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["bsd", "bsd", "", "", "bsd", ""]
    assert got[0].spans == f"bsd:2:{2 + len(O7.words_of(bsd))}" and got[0].score == 1.0
    assert 0.8 < got[1].score < 1 and got[1].n_spans == 1 and got[4].n_spans == 2
