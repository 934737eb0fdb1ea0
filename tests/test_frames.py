"""Point ids, paging, labels and codes."""

import datetime as dt

from fieldlab.operators import frames as FM


def _df(spark, n=50):
    rows = [(f"S{i % 3}", f"P{i % 2}", dt.date(2020, 1, 1 + i % 28), float(i % 7), "None",
             ["surface", "epilimnion", None][i % 3], None, "Measured value" if i % 5 else "<DL",
             "Measured value" if i % 5 else "<DL", f"S{i % 3} - P{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "SamplingPoint string, WebParameter string, DateSampled date, "
                                       "FinalResult double, Qualifiers string, RelativeDepthComments string, "
                                       "Description string, DL string, legend_shape string, SiteParam string")


def test_point_id_consecutive_in_order(spark):
    df = _df(spark).repartition(5)
    out = FM.point_id(df).collect()
    ids = sorted(r["point_id"] for r in out)
    assert ids == list(range(1, 51))
    key = lambda r: tuple((v is not None, v) for v in (r[c] for c in FM.CLEAN_ORDER))
    by_id = sorted(out, key=lambda r: r["point_id"])
    assert [key(r) for r in by_id] == sorted(key(r) for r in out)


def test_page_and_display(spark):
    disp = FM.display_table(_df(spark))
    assert disp.columns == ["Site", "Parameter", "Date", "Result", "Detection Limit", "Qualifiers",
                            "Relative Depth"]
    pages = [FM.page(disp, k).collect() for k in range(6)]
    assert [len(p) for p in pages] == [10, 10, 10, 10, 10, 0]
    flat = [tuple(r) for p in pages for r in p]
    assert len(set(flat)) == len(set(tuple(r) for r in disp.collect()))


def test_labels_and_codes(spark):
    df = _df(spark, 6)
    lab = FM.point_label(df).orderBy("DateSampled").first()["label"]
    assert lab == ("Site: S0<br>Parameter: P0<br>Date: 2020-01-01<br>Result: 0<br>Qualifier: None"
                   "<br>Depth: surface")
    v1 = FM.point_label(df, "v1").orderBy("DateSampled").first()["label"]
    assert v1 == "Date: 01-01-2020 <br>Result: 0 <br>Qualifiers: None <br>Relative Depth: surface"
    shapes = {r["legend_shape"]: r["shape"] for r in FM.shape_code(df).collect()}
    assert shapes == {"<DL": 25, "Measured value": 16}
    sizes = {r["RelativeDepthComments"]: r["size"] for r in FM.size_code(df).collect()}
    assert sizes == {"surface": 2.5, "epilimnion": 2.5, None: None}
    assert FM.has_depth(df).first()["use_size"] is True
    assert FM.default_facet(df).first()["facet"] == "Site"


def test_value_range(spark):
    r = FM.value_range(_df(spark)).first()
    assert (r["min_value"], r["max_value"]) == (0.0, 6.0)
    assert abs(r["lo"] + 0.9) < 1e-12 and abs(r["hi"] - 6.9) < 1e-12
