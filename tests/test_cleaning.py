"""Cleaning rules on the edge values of FIXTURES.md section 4."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlab.functions import cleaning as C
from fieldlab.operators.clean import clean

# (WebResult, stripped, DL, full, half); None = row dropped.
EDGES = [
    ("12.5", "12.5", "Measured value", 12.5, 12.5),
    ("<0.5", "<0.5", "<DL", 0.5, 0.25),
    ("> 2400 MPN", ">2400", ">DL", 2400.0, 2400.0),
    ("-1.2", "1.2", "Measured value", 1.2, 1.2),
    ("1e-5", "15", "Measured value", 15.0, 15.0),
    ("1,200", "1200", "Measured value", 1200.0, 1200.0),
    ("5.", "5.", "Measured value", 5.0, 5.0),
    (".5", ".5", "Measured value", 0.5, 0.5),
    ("<=5", "<=5", "<DL", None, None),
    (">=5", ">=5", ">DL", None, None),
    ("=5", "=5", "Measured value", None, None),
    ("<<5", "<<5", "<DL", None, None),
    ("5<", "5<", "Measured value", None, None),
    ("1.2.3", "1.2.3", "Measured value", None, None),
    (".", ".", "Measured value", None, None),
    ("ND", "", "Measured value", None, None),
    ("", "", "Measured value", None, None),
    (None, None, "Measured value", None, None),
]


def _raw(spark, results, quals=None, depths=None):
    n = len(results)
    quals = quals or ["J"] * n
    depths = depths or ["Epilimnion"] * n
    rows = [(f"S{i}", "2020-01-0{}".format(1 + i % 9), "P", r, q, d)
            for i, (r, q, d) in enumerate(zip(results, quals, depths))]
    return spark.createDataFrame(rows, "SamplingPoint string, DateSampled string, WebParameter string, "
                                       "WebResult string, Qualifier string, RelativeDepthSample string")


def test_strip_class_parse(spark):
    df = _raw(spark, [e[0] for e in EDGES])
    out = df.select("SamplingPoint", C.strip_result("WebResult").alias("s"),
                    C.dl_class(C.strip_result("WebResult")).alias("dl"),
                    C.parse_result(C.strip_result("WebResult")).alias("full"),
                    C.parse_result(C.strip_result("WebResult"), "half").alias("half")).collect()
    got = {r["SamplingPoint"]: r for r in out}
    for i, (_, s, dl, full, half) in enumerate(EDGES):
        r = got[f"S{i}"]
        assert r["s"] == s, EDGES[i]
        assert r["dl"] == dl, EDGES[i]
        assert r["full"] == full, EDGES[i]
        assert r["half"] == half, EDGES[i]


@pytest.mark.parametrize("profile,nondetect", [("current", "full"), ("v2", "half")])
def test_clean_drops_unparsed(spark, profile, nondetect):
    df = clean(_raw(spark, [e[0] for e in EDGES]), profile)
    vals = sorted(r["FinalResult"] for r in df.collect())
    col = 3 if nondetect == "full" else 4
    assert vals == sorted(e[col] for e in EDGES if e[col] is not None)


def test_v1_keeps_rows_and_parses_signs(spark):
    raw = ["-1.2", "1e-5", "< 4", "> 2400", "< 4.5 mg/L", " 7 ", None]
    df = clean(_raw(spark, raw), "v1").orderBy("SamplingPoint").collect()
    assert [r["FinalResult"] for r in df] == [-1.2, 1e-5, 2.0, 2400.0, None, 7.0, None]
    assert [r["DL"] for r in df] == ["Measured value"] * 2 + ["<DL", ">DL", "<DL"] + ["Measured value"] * 2


def test_qualifier_and_depth_profiles(spark):
    quals = [None, "", "J", " "]
    depths = [None, "", "   ", "\t"]
    df = _raw(spark, ["1", "2", "3", "4"], quals, depths)
    cur = {r["SamplingPoint"]: r for r in clean(df).collect()}
    assert [cur[f"S{i}"]["Qualifiers"] for i in range(4)] == ["None", "None", "J", " "]
    assert {cur[f"S{i}"]["RelativeDepthComments"] for i in range(4)} == {"surface"}
    v2 = {r["SamplingPoint"]: r for r in clean(df, "v2").collect()}
    assert {v2[f"S{i}"]["RelativeDepthComments"] for i in range(4)} == {"N/A"}
    v1 = {r["SamplingPoint"]: r for r in clean(df, "v1").collect()}
    assert [v1[f"S{i}"]["Qualifiers"] for i in range(4)] == [None, "None", "J", " "]
    assert {v1[f"S{i}"]["RelativeDepthComments"] for i in range(4)} == {None}


def test_depth_levels(spark):
    df = _raw(spark, ["1", "2", "3"], None, [" Epilimnion ", "benthic", "MID-DEPTH"])
    cur = {r["SamplingPoint"]: r["RelativeDepthComments"] for r in clean(df).collect()}
    assert cur == {"S0": "epilimnion", "S1": None, "S2": "mid-depth"}
    v2 = {r["SamplingPoint"]: r["RelativeDepthComments"] for r in clean(df, "v2").collect()}
    assert v2 == {"S0": "EPILIMNION", "S1": "BENTHIC", "S2": "MID-DEPTH"}
    ranks = df.select(C.depth_rank(C.depth_label("RelativeDepthSample")).alias("r")).collect()
    assert sorted((r["r"] is None, r["r"]) for r in ranks) == [(False, 2), (False, 4), (True, None)]


def test_legend_and_series_key(spark):
    df = _raw(spark, ["<1", "2"], ["", "J"])
    out = {r["SamplingPoint"]: r for r in clean(df).collect()}
    assert out["S0"]["legend_shape"] == "<DL"
    assert out["S1"]["legend_shape"] == "Qualifier"
    assert out["S0"]["SiteParam"] == "S0 - P"


def test_dates(spark):
    df = spark.createDataFrame([("2020-01-05",), ("2020/01/06",), ("2020-01-07 10:00:00",), ("junk",), (None,)],
                               "d string")
    got = [r[0] for r in df.select(C.to_sample_date("d")).collect()]
    assert [str(g) if g else None for g in got] == ["2020-01-05", "2020-01-06", "2020-01-07", None, None]


def test_numeric_result_rejected(spark):
    df = spark.createDataFrame([("S", "2020-01-01", "P", 1.5, None, None)],
                               "SamplingPoint string, DateSampled string, WebParameter string, "
                               "WebResult double, Qualifier string, RelativeDepthSample string")
    with pytest.raises(TypeError):
        clean(df)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), min_size=1, max_size=40))
def test_clean_never_raises(spark, texts):
    out = clean(_raw(spark, texts), drop_unparsed=False).collect()
    assert len(out) == len(texts)
    assert {r["DL"] for r in out} <= {">DL", "<DL", "Measured value"}
    for r in out:
        v = r["FinalResult"]
        assert v is None or (v >= 0 and math.isfinite(v))
