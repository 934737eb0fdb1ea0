"""Quality rules, secret scan, exact dedup against brute force."""

import functools
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import SF001, SF01, empty, frame, multiset, rows, texts

from fieldlab.llm import op1_quality, op2_secrets, op10_exact, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(lines), sum(x == y for x, y in zip(w, w[1:])))


def verdicts(docs, spread=2.0, prior=10.0, sure=2.0):
    """Plain form of the rules: (doc_id, counts, base_failed, kept)."""
    g = math.log(op1_quality.GAMMA)
    names = list(op1_quality.FIGURES)
    sketch = defaultdict(Counter)
    made = []
    for doc, text, lang, source in docs:
        n, chars, symbols, dup, rep, lines, same = c = counts(text)
        v = dict(zip(names, (chars / n, symbols / chars, dup / lines, rep / n, same / n))) if n else None
        made.append((doc, lang, source, c, v))
        if n >= 20 and 100 * rep <= 30 * n:
            for f in names:
                for key in ((lang, source), (lang,), ()):
                    sketch[key, f][math.ceil(math.log(v[f] + op1_quality.SHIFT) / g)] += 1

    def q(c, share):
        seen, total = 0, sum(c.values())
        for b in sorted(c):
            seen += c[b]
            if seen > share * (total - 1):
                return max(op1_quality.GAMMA ** b * 2 / (1 + op1_quality.GAMMA) - op1_quality.SHIFT, 0.0)

    @functools.cache
    def limits(lang, source, f):
        levels = [sketch.get((key, f)) for key in ((), (lang,), (lang, source))]
        if None in levels:
            return None
        center = None
        for c in levels:
            n = sum(c.values())
            center = q(c, 0.5) if center is None else (n * q(c, 0.5) + prior * center) / (n + prior)
        own = min(q(c, 0.5) - q(c, 0.1), q(c, 0.9) - q(c, 0.5))
        tail = lambda a, b: max(own, sorted(q(x, b) - q(x, a) for x in levels)[1])
        return center - spread * tail(0.1, 0.5), center + spread * tail(0.5, 0.9)

    out = []
    for doc, lang, source, c, v in made:
        base = c[0] < 20 or 100 * c[4] > 30 * c[0]
        good = True
        size = dict(zip(names, (c[0], c[1], c[5], c[0] / 16, c[0])))
        for f in names if v else ():
            if (t := limits(lang, source, f)) is None:
                continue
            if f == "word_length":
                noise = sure / (2 * math.sqrt(size[f]))
                good &= not (v[f] * (1 - noise) > t[1] or v[f] * (1 + noise) < t[0])
            else:
                e = size[f] * max(t[1], op1_quality.FLOOR)
                good &= v[f] * size[f] <= e + sure ** 2 / 2 + sure * math.sqrt(e + sure ** 2 / 4)
        out.append((doc, *c[:5], base, not base and good))
    return out


COLUMNS = ["doc_id", *op1_quality.COUNTS, "base_failed", "kept"]


def test_quality_cases(spark):
    for prior in (0.0, 10.0):
        got = op1_quality.rules(frame(spark), prior=prior).select(COLUMNS).collect()
        assert multiset(map(tuple, got)) == multiset(verdicts([r[:4] for r in rows()], prior=prior))
    assert op1_quality.rules(empty(spark)).count() == 0


def test_quality_tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = queries.QUERIES["op1_quality_rules"](spark, SF01).select(COLUMNS).collect()
    assert multiset(map(tuple, got)) == multiset(verdicts([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_quality_thresholds_follow_the_source(spark):
    rng = random.Random(5)

    def text(symbols, size=1):
        words = ["".join(rng.choice("abcdefgh") for _ in range(size * rng.randint(3, 7))) for _ in range(200)]
        return " ".join(w + "#" * (symbols // 200 + (i < symbols % 200)) for i, w in enumerate(words))

    # Code carries symbols and prose does not; 20 % of the mixed source is junk.
    code = [(i, text(rng.randint(60, 100)), "en", "code", "good") for i in range(80)]
    prose = [(100 + i, text(rng.randint(0, 2)), "en", "prose", "good") for i in range(1200)]
    mixed = [(2000 + i, text(80 if i % 5 == 0 else 0), "en", "mixed", "junk" if i % 5 == 0 else "good") for i in range(200)]
    wide = [(3000 + i, text(0, 3), "en", "long words", "good") for i in range(80)]
    odd = [(4000, text(80), "en", "prose", "junk"), (4001, text(400), "en", "code", "junk"),
           (4002, text(0, 3), "en", "prose", "junk"), (4003, text(0), "en", "long words", "junk")]
    docs = code + prose + mixed + wide + odd
    got = op1_quality.rules(spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[d[0]] == (d[4] == "good") for d in docs), [(d[0], d[3]) for d in docs if kept[d[0]] != (d[4] == "good")]


def test_quality_filter_keeps_rows_as_they_are(spark):
    kept = op1_quality.keep_good(frame(spark)).collect()
    want = [r for r, v in zip(rows(), verdicts([r[:4] for r in rows()])) if v[-1]]
    assert multiset(map(tuple, kept)) == multiset(want)
    assert op1_quality.keep_good(empty(spark)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    t = t or ""
    # An ASCII copy of equal length, so that ignoring case touches ASCII only.
    plain = "".join(c if ord(c) < 128 else "\x00" for c in t)
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(plain) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    found.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()), said


@pytest.mark.parametrize("what", ["cases", "sf"])
def test_secret_base(spark, what):
    docs = frame(spark) if what == "cases" else spark.read.parquet(f"{SF001}/documents.parquet")
    model = op2_secrets.fit(docs)
    got = op2_secrets.scan(docs, model).collect()
    want = [(r.doc_id, *base(r.text)[0]) for r in docs.select("doc_id", "text").collect()]
    assert multiset((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == multiset(want)
    said = {base(r.text)[1] for r in docs.collect()}
    for r in got:
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("markov")) in said


def test_secret_models(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = op2_secrets.fit(docs)
    hits = op2_secrets.scan(docs, model).collect()
    assert sum(r.n_markov for r in hits) < 0.02 * len(hits)
    for random_ in ("f3ef4d6b-2755a36d7d9c25bd72c4d5f6", "9f86d081884c7d659a2feaa0c55ad015"):
        assert model.score(random_) > 1
    for ordinary in ("internationalisation_2", "anotherordinarything"):
        assert model.score(ordinary) < 1
    assert [k for *_, k in op2_secrets.find("x = 7f3d9a0c44e81b2d-6c5f0e93a7b1", model)] == [3]
    assert op2_secrets.scan(empty(spark), op2_secrets.fit(empty(spark))).count() == 0


def test_secret_tokens_of_any_kind(spark):
    """Letters only, 16 to 19 characters, and the rest of a token around a base
    span are scored; words, numbers and rule lines are not secrets."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = op2_secrets.fit(docs)
    letters, short, head, tail = "qZxKvJwPmGhTrBnYcLdF", "Zq9x7Kp0Vw3TjR8m", "Xw9QzK7vRj2PgTbN", "ZkVq8XwJ3GpR"
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "QZ7XW4KJ9PVB"
    for token in (letters, short, short + "w", letters.swapcase()):
        assert op2_secrets.find(f"see {token} here", model) == [(4, 4 + len(token), 3)]
    assert op2_secrets.find(f"a {head}{hexes}-{tail} b", model) == [(2, 18, 3), (18, 50, 2), (50, 63, 3)]
    assert op2_secrets.find(f"{head}/{key}_{tail}", model) == [(0, 17, 3), (17, 33, 1), (33, 46, 3)]
    for plain in ("internationalisation and otherwise", "-" * 40 + " 12345678901234567890", "my_password=hunter2hunter2"):
        assert [k for *_, k in op2_secrets.find(plain, model) if k == 3] == []
    planted = spark.createDataFrame([(f"a {head}{hexes}-{tail} b {letters}. {short}",)], "text string")
    assert op2_secrets.redact(planted, model).first().text == "a " + "[SECRET]" * 3 + " b [SECRET]. [SECRET]"


def test_secret_redaction(spark):
    docs = frame(spark)
    model = op2_secrets.fit(docs)
    want = []
    for r in rows():
        t = r[1]
        if t is not None:
            covered = {i for s, e, _ in op2_secrets.find(t, model) for i in range(s, e)}
            parts = "".join("\x00" if i in covered else c for i, c in enumerate(t))
            t = re.sub("\x00+", "[SECRET]", parts) if covered else t
        want.append((r[0], t, *r[2:]))
    got = op2_secrets.redact(docs, model)
    assert got.columns == docs.columns
    assert multiset(map(tuple, got.collect())) == multiset(want)


def exact(docs):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for norm, g in groups.items():
        best = min(g)
        out += [(x[4], best[4], len(g), x is best, hashlib.sha256(norm.encode()).hexdigest()) for x in g]
    return out


@pytest.mark.parametrize("hot_share", [1e-3, 0.0])
def test_exact_cases(spark, hot_share):
    got = op10_exact.dedup(frame(spark), hot_share=hot_share, salt_bytes=2_000).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert multiset(map(tuple, got)) == multiset(exact([r[:2] for r in rows()]))
    assert op10_exact.dedup(empty(spark)).count() == 0
    kept = op10_exact.keep_one(frame(spark), hot_share=hot_share, salt_bytes=2_000)
    assert kept.columns == frame(spark).columns
    assert multiset((r.doc_id, len(r.text or "")) for r in kept.collect()) == multiset(
        (g[0], -b[0]) for g, b in ((x, min((-len(r[1] or ""), r[0] is None) for r in rows() if r[0] == x[0] and hashlib.sha256(
            re.sub(r"[\x20\x09-\x0D]", "", r[1] or "").encode()).hexdigest() == x[4])) for x in exact([r[:2] for r in rows()]) if x[3]))


def test_exact_hot_group(spark):
    """A text that most rows share, split over salts."""
    docs = spark.range(600).selectExpr("id as doc_id", "case when id % 3 = 0 then 'copy of a  text' else concat('text ', id) end as text")
    got = op10_exact.dedup(docs, hot_share=0.01).collect()
    assert [r.doc_id for r in got if r.kept and r.group_size > 1] == [0] and max(r.group_size for r in got) == 200


def test_cases_have_what_they_should():
    assert None in texts() and "" in texts() and max(len(t or "") for t in texts()) > 100_000


def test_filter_stays_above_the_counts(spark):
    """Pushed below them, it would evaluate their nested expressions many times."""
    plan = op1_quality.keep_good(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("split(" in line for line in filters)


def test_filter_of_the_sketches_stays_above_the_counts(spark, monkeypatch):
    """The same in the thresholds' pass, which reads the texts as well."""
    plans, cut = [], op1_quality.cut_lineage
    monkeypatch.setattr(op1_quality, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    op1_quality.keep_good(frame(spark))
    filters = [line for plan in plans for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert any("n_repeat_words" in line for line in filters) and not any("split(" in line or "zip_with(" in line for line in filters)


def test_exact_dedup_with_colliding_digests(spark, monkeypatch):
    """The texts decide, not the digest: with one digest for all, salted or not."""
    from pyspark.sql import functions as F
    want = exact([(r[0], r[1]) for r in rows()])
    monkeypatch.setattr(op10_exact, "digest", lambda norm: F.when(norm.isNotNull(), F.unhex(F.lit("00" * 32))))
    for share, size in ((1.0, 1 << 40), (0.05, 1 << 40), (1.0, 5_000)):
        got = op10_exact.dedup(frame(spark), hot_share=share, salt_bytes=size).collect()
        assert multiset(tuple(r)[:4] for r in got) == multiset(tuple(w)[:4] for w in want)
        assert op10_exact.keep_one(frame(spark), hot_share=share, salt_bytes=size).count() == sum(w[3] for w in want)


def test_salts_follow_the_group(spark):
    """A text with half of the rows is dealt over as many salts as it needs."""
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(4_000)], "doc_id long, text string").repartition(8)
    for share, size, least in ((0.01, 1 << 40, 45), (1.0, 1_000, 15)):
        runs = op10_exact._runs(docs, share, size, "doc_id", "text", [])
        sizes = [r["count"] for r in runs.where("salt >= 0").groupBy("salt").count().collect()]
        assert len(sizes) >= least and sum(sizes) == 2_000 and max(sizes) < 2.5 * 2_000 / least


def test_identifiers_and_names_stay(spark):
    """Ordinary names are no secrets, random tokens are; both rates by length,
    learned from 10,000 documents."""
    import random
    import string
    model = op2_secrets.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8))
    marked = lambda t: any(k == 3 for *_, k in op2_secrets.find(f"see {t} here", model))
    for name in ("Zimbabwe", "Tchaikovsky", "Dostoyevsky", "JavaScript", "ServiceFactory", "getUserByIdAndName", "GitHub-Actions",
                 "/usr/local/lib/python3", "utf8mb4_unicode_ci", "Schwarzenegger", "HTTPSConnectionPool", "x86_64-linux-gnu",
                 "AbstractSingletonProxyFactoryBean", "com.example.app.MainActivity", "Reykjavik", "XMLHttpRequest"):
        assert not marked(name), name
    rng = random.Random(4)
    for n, least in ((8, 0.5), (12, 0.65), (16, 0.8), (20, 0.9), (32, 0.95)):
        found = sum(marked("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))) for _ in range(300)) / 300
        assert found >= least, (n, found)

