"""Search index, locale order and column-wide dates."""

import datetime as dt

import pytest

from fieldlab.functions import cleaning as C
from fieldlab.operators import directory as D
from fieldlab.operators import search as SE
from fieldlab.operators.clean import factor_code

NAMES = ["Nitrate", "nitrate", "Nitrite (as N)", "Ångström", "zinc", "Zinc", "étain", "Étain", "Etain", "pH", "PH", "a", "", None, "ab ab", "x%_y", "aab", "İzmir"]


def options(spark):
    return spark.createDataFrame([(n,) for n in NAMES * 2], "name string").repartition(3)


@pytest.mark.parametrize("text", ["", "a", "A", "it", "nit", "NITR", "itrate", "ab ab", "abab", "Zin", "é", "tai", "%_", "x%_y", "p", "nope", "zmi", "(as n)"])
def test_index_equals_the_scan(spark, tmpdir_path, text):
    path = f"{tmpdir_path}/index"
    SE.build_search_index(options(spark), "name", path, partitions=4)
    got = [r.name for r in SE.search(spark, path, text, "name").collect()]
    assert got == [r.name for r in D.search_options(options(spark), "name", text).collect()]
    assert [r.name for r in SE.search(spark, path, text, "name", limit=1).collect()] == got[:1]


def test_a_search_reads_its_grams(spark, tmpdir_path):
    SE.build_search_index(options(spark), "name", f"{tmpdir_path}/index")
    plan = SE.search(spark, f"{tmpdir_path}/index", "nitra", "name")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "In(gram, [itr,nit,tra])" in pushed, pushed
    SE.build_search_index(options(spark).where("false"), "name", f"{tmpdir_path}/none")
    assert SE.search(spark, f"{tmpdir_path}/none", "a", "name").count() == 0


def test_locale_order(spark):
    names = lambda locale: [r.name for r in D.sorted_options(options(spark), "name", locale).collect()]
    assert names(None) == sorted({n for n in NAMES if n is not None}, key=lambda n: n.encode())
    root = names("UNICODE")
    assert set(root) == set(names(None)) and root[0] == ""
    order = [root.index(n) for n in ("a", "aab", "Ångström", "Etain", "étain", "Étain", "nitrate", "Nitrate", "pH", "PH", "zinc", "Zinc")]
    assert order == sorted(order)
    swedish = names("sv")
    assert swedish.index("Ångström") > swedish.index("Zinc")          # a letter after z
    codes = {r.name: r.code for r in factor_code(options(spark), "name", "code", locale="UNICODE").collect()}
    assert codes[None] is None and [codes[n] for n in root] == list(range(1, len(root) + 1))


def test_directory_in_locale_order(spark):
    res = spark.createDataFrame([("b",), ("B",), ("a",), ("Ä",), (None,)], "SamplingPoint string")
    st = spark.createDataFrame([("b", "x")], "StationID string, Description string")
    assert [r.SamplingPoint for r in D.site_directory(res, st, "UNICODE").collect()] == ["a", "Ä", "b", "B", None]
    assert [r.SamplingPoint for r in D.site_directory(res, st).collect()] == ["B", "a", "b", "Ä", None]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "at int, d string").repartition(3)


@pytest.mark.parametrize("values,want", [
    ([None, "2001/2/3", "2001-02-04", "2001/13/1", "x", "2002/12/31 10:00"], [None, (2001, 2, 3), None, None, None, (2002, 12, 31)]),
    (["2001-02-03T04:05", "2001/02/03", " 1999-1-9", "2001-02-30", ""], [(2001, 2, 3), None, (1999, 1, 9), None, None]),
    ([None, None], [None, None]), ([], [])])
def test_one_form_for_the_column(spark, values, want):
    got = {r["at"]: r["d"] for r in C.column_dates(column(spark, values), "d", "at").collect()}
    assert [got[i] for i in range(len(values))] == [w and dt.date(*w) for w in want]


def test_first_value_is_no_date(spark):
    with pytest.raises(ValueError, match="not a date"):
        C.column_dates(column(spark, [None, "soon", "2001-02-03"]), "d", "at")
