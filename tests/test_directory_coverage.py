"""Selection-order lookups, option lists and coverage gaps."""

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlab.operators import coverage as CV
from fieldlab.operators import directory as D


def _dir(spark):
    rows = [("S1", "Lake A"), ("S2", "Lake B"), ("S3", "Lake A"), ("S4", None), ("S5", "Lake C"),
            ("S5", "Lake B")]
    return spark.createDataFrame(rows, "SamplingPoint string, Description string")


def test_site_directory(spark):
    res = spark.createDataFrame([("S1",), ("S2",), ("S2",), ("S9",)], "SamplingPoint string")
    st_ = spark.createDataFrame([("S1", "A"), ("S2", "B"), ("S2", "B"), ("S2", "C")],
                                "StationID string, Description string")
    out = [tuple(r) for r in D.site_directory(res, st_).collect()]
    assert out == [("S1", "A"), ("S2", "B"), ("S2", "C"), ("S9", None)]


def test_describe_sites_order_and_unique(spark):
    out = [tuple(r) for r in D.describe_sites(spark, _dir(spark), ["S3", "S5", "S1", "S4", "S7"]).collect()]
    # S3 -> Lake A (pos 1), S5 -> first of (Lake B, Lake C) = Lake B, S1 -> Lake A again, S4 -> NULL
    assert out == [(1, "Lake A"), (2, "Lake B"), (4, None)]


def test_sites_for_all_and_first(spark):
    d = _dir(spark)
    out = [tuple(r) for r in D.sites_for(spark, d, ["Lake B", "Lake A", "Nope"]).collect()]
    assert out == [(1, "S2"), (1, "S5"), (2, "S1"), (2, "S3")]
    first = [tuple(r) for r in D.sites_for(spark, d, ["Lake B", "Lake A"], first=True).collect()]
    assert first == [(1, "S2"), (2, "S1")]


def test_same_set_and_valid_selection(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")
    b = spark.createDataFrame([("y",), ("x",)], "v string")
    c = spark.createDataFrame([("x",)], "v string")
    assert D.same_set(a, b, "v").first()["same"] is True
    assert D.same_set(a, c, "v").first()["same"] is False
    opts = spark.createDataFrame([("p1",), ("p3",)], "p string")
    out = [tuple(r) for r in D.valid_selection(spark, ["p3", "p2", "p1"], opts, "p").collect()]
    assert out == [(1, "p3"), (3, "p1")]


def test_search_cap(spark):
    d = _dir(spark)
    assert [r[0] for r in D.search_options(d, "SamplingPoint", "s", 3).collect()] == ["S1", "S2", "S3"]


def _clean_like(spark, pairs):
    return spark.createDataFrame([(s, p) for s, p in pairs] or [("", "")],
                                 "SamplingPoint string, WebParameter string").where("SamplingPoint <> ''")


def test_missing_message_texts(spark):
    df = _clean_like(spark, [("S1", "P1"), ("S2", "P2")])
    msg = CV.missing_message(df, ["S1", "S2"], ["P1", "P2"]).first()["message"]
    assert msg == ("No data available for the following site-parameter combinations: "
                   "S2 (P1), S1 (P2).")
    none = CV.missing_message(_clean_like(spark, []), ["S1"], ["P1"]).first()["message"]
    assert none == "No data available for selected sites and parameters."
    full = CV.missing_message(df.union(_clean_like(spark, [("S1", "P2"), ("S2", "P1")])),
                              ["S1", "S2"], ["P1", "P2"]).first()["message"]
    assert full is None


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["S1", "S2", "S3"]), st.sampled_from(["P1", "P2"])), max_size=10))
def test_missing_plus_observed_is_requested(spark, pairs):
    sites, params = ["S1", "S2", "S4"], ["P1", "P2", "P3"]
    df = _clean_like(spark, pairs)
    missing = {(r["Site"], r["Parameter"]) for r in CV.missing_pairs(df, sites, params).collect()}
    observed = {(r["Site"], r["Parameter"]) for r in CV.observed_pairs(df).collect()}
    requested = {(s, p) for s in sites for p in params}
    assert missing | (observed & requested) == requested
    assert not (missing & observed)


def test_selection_values_with_quotes(spark):
    from fieldlab.operators.select import select_results
    res = spark.createDataFrame([("O'Hara Lake", "2020-01-01", "pH", "7", None, None),
                                 ("Other", "2020-01-01", "pH", "8", None, None)],
                                "SamplingPoint string, DateSampled string, WebParameter string, "
                                "WebResult string, Qualifier string, RelativeDepthSample string")
    st = spark.createDataFrame([("O'Hara Lake", "North 'arm'")], "StationID string, Description string")
    out = select_results(res, st, ["O'Hara Lake", "x' OR '1'='1"], ["pH"]).collect()
    assert [(r["SamplingPoint"], r["Description"]) for r in out] == [("O'Hara Lake", "North 'arm'")]
