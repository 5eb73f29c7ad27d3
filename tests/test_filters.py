import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.filters import FilterError, compile_filter, describe_filter, filter_rows, parse, wildcard_to_regex
from millrace.options import Options


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            (1, "Alice", 100.5, ("SF", "CA"), [1001, 1002, 1003], ["vip", "new"], '{"zone":{"id":"7"}}', "[1,5]", True, "2026-01-15"),
            (2, "Bob", None, ("LA", "CA"), [1005, 1006], ["a.web.b"], None, "text", False, "2026-02-01"),
            (3, None, 3.0, None, [900, 950], [], '{"zone":{"id":"x"}}', "12", None, None),
        ],
        "id int, name string, amount double, address struct<city:string,state:string>, orders array<long>, tags array<string>, meta string, raw string, ok boolean, day string",
    )


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("amount > 50", [1]), ("amount != 3", [1]), ("name = 'Bob'", [2]), ('name != "Bob"', [1]), ("id >= 2 AND id < 3", [2]),
        ("id = 1 OR id = 2 AND amount > 5", [1]), ("(id = 1 OR id = 2) AND ok = false", [2]), ("orders > 1002", [1, 2]), ("orders CONTAINS 1005", [2]),
        ("orders[0] > 1000", [1, 2]), ("orders[2] = 1003", [1]), ("address.state = 'CA'", [1, 2]), ("meta.zone.id = 7", [1]), ("tags CONTAINS 'vip'", [1]),
        ("tags CONTAINS '*web*'", [2]), ("name CONTAINS 'Al'", []), ("name CONTAINS 'Al*'", [1]), ("name CONTAINS '?ob'", [2]), ("name IS NULL", [3]),
        ("name IS NOT NULL", [1, 2]), ("day >= '2026-02-01'", [2]), ("raw > 4", [1, 2, 3]), ("raw CONTAINS 5", [1]), ("raw = 12", [3]), ("id \\!= 1", [2, 3]),
        ("ok = true", [1]), ("address.city IS NULL", [3]),
    ],
)
def test_meaning(people, text, ids):
    assert sorted(r.id for r in filter_rows(people, text).collect()) == ids


def test_compat_precedence_and_nulls(people):
    compat = Options(compat=True)
    assert sorted(r.id for r in filter_rows(people, "id = 1 OR id = 2 AND amount > 5", compat).collect()) == [1]
    assert sorted(r.id for r in filter_rows(people, "id = 3 AND id = 3 OR id = 1", compat).collect()) == [3]
    assert sorted(r.id for r in filter_rows(people, "name != 'Bob'", compat).collect()) == [1, 3]
    assert sorted(r.id for r in filter_rows(people, "day = 2026", compat).collect()) == [1, 2]


@pytest.mark.parametrize("text", ["", "id", "id =", "id = x", "id = 1 AND", "(id = 1", "id ~ 'x'", "id = 1 id = 2", "= 1", "id IS 3", "id = 1 and id = 2"])
def test_errors(text):
    with pytest.raises(FilterError):
        parse(text)


def test_unknown_column(people):
    with pytest.raises(FilterError, match="no column"):
        compile_filter("nope = 1", people.schema)
    with pytest.raises(FilterError):
        compile_filter("address.zip = 1", people.schema)


def test_dotted_column_wins(spark):
    df = spark.createDataFrame([(("x",), "y")], "a struct<b:string>, `a.b` string")
    assert filter_rows(df, "a.b = 'y'").count() == 1


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    kept = filter_rows(df, "l_quantity > 40 AND l_returnflag = 'R'")
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert "GreaterThan(l_quantity,40.0)" in plan and "EqualTo(l_returnflag,R)" in plan


def test_wildcards_and_tree():
    assert wildcard_to_regex("a*[!b]?\\*") == "(?s)^a[^/]*[^b][^/]\\*$"
    assert describe_filter("a = 1 OR b = 2") == '{"or": [{"column": "a", "index": null, "op": "=", "value": 1}, {"column": "b", "index": null, "op": "=", "value": 2}]}'


@given(st.integers(-50, 50), st.integers(-50, 50))
def test_both_is_one_after_the_other(a, b):
    both = parse(f"x > {a} AND x < {b}")
    assert (both.left.value, both.right.value) == (a, b)
