"""The pipeline: every stage on awkward rows, and against the operators' brute forces."""

import corpus_pipeline as C
from llm_cases import SF001, SF01, empty, frame, multiset
from test_llm_dedup import classes, fingerprint
from test_llm_rules import base, exact, verdicts

from fieldlab.llm import op2_secrets


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "secret scan", "packing"]


def test_stages_on_awkward_rows(spark):
    for docs in (frame(spark), empty(spark)):
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= docs.count()
        assert C.STAGES[-1][1](spark, docs, SF001).count() >= docs.count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    good = {v[0] for v in verdicts([(r.doc_id, r.text, r.lang, r.source) for r in docs]) if v[-1]}
    docs = [r for r in docs if r.doc_id in good]
    kept = {x[0] for x in exact([(r.doc_id, r.text) for r in docs]) if x[3]}
    docs = [r for r in docs if r.doc_id in kept]
    root = classes([fingerprint(r.text) for r in docs])
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(root[fingerprint(r.text)], r.doc_id)
    docs = [r for r in docs if r.doc_id in first.values()]
    got = C.run(spark, SF001).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs}
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    assert all(a == b for a, b in whole.values())


def test_secrets_are_gone(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = C.secrets(spark, docs, SF01).collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    assert any(base(t)[1] for t in before.values()) and not any(op2_secrets.base_spans(r.text or "") for r in out)
    assert multiset(r.doc_id for r in out) == multiset(before)
    assert all(r.n_chars == len(r.text) for r in out)
