import pytest
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.operators.relational import as_of_join, group, join, limit, pivot, select, sort, top_k, union, unpivot
from millrace.options import Options

COMPAT = Options(compat=True)


def test_select_keeps_order_and_duplicates(frame):
    df = frame([(1, "x", 2.0)], "a int, `b.c` string, d double")
    assert select(df, "d, b.c, a").columns == ["d", "b.c", "a"]
    assert select(df, ["a", "a"]).columns == ["a", "a"]
    with pytest.raises(ValueError, match="no column 'z'"):
        select(df, "z")


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 3), ("right", 3), ("full", 4), ("semi", 2), ("anti", 1)])
def test_join_kinds(frame, how, n):
    left = frame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    right = frame([(1, 10), (2, 20), (4, 40)], "id long, amount long")
    out = join(left, right, "id", how)
    assert out.count() == n
    if how in ("right", "full"):
        assert {r.id for r in out.collect()} >= {1, 2, 4}
    if how == "left":
        assert out.where("id = 3").first().amount is None


def test_join_keys_collisions_and_errors(frame, rows):
    left = frame([(2024, 1, 5)], "year int, month int, value int")
    right = frame([("2024", 1, 7)], "year string, month int, value int")
    out = join(left, right, "year,month")
    assert out.columns == ["year", "month", "value", "value_right"]
    assert rows(out) == [(2024, 1, 5, 7)]
    taken = left.withColumn("value_right", F.lit(0))
    with pytest.raises(ValueError, match="taken"):
        join(taken, right, "year,month")
    with pytest.raises(ValueError, match="right key"):
        join(left, right.drop("month"), "year,month")


def test_join_null_keys(frame):
    left, right = frame([(None, 1)], "k string, a int"), frame([(None, 2)], "k string, b int")
    assert join(left, right, "k").count() == 0
    assert join(left, right, "k", options=COMPAT).count() == 1
    assert join(left, right, "k", "right", options=COMPAT).count() == 1


def test_group(frame, rows):
    df = frame([("a", 1, "1"), ("a", 3, "x"), ("b", None, None)], "k string, v long, t string")
    out = group(df, "k", sum="v,t", avg="v", min="v", max="v", count="1")
    assert out.columns == ["k", "v_sum", "t_sum", "v_avg", "v_min", "v_max", "k_count"]
    assert rows(out) == [("a", 4.0, 1.0, 2.0, 1, 3, 2), ("b", None, None, None, None, None, 1)]
    assert rows(group(df, "k", sum="v", options=COMPAT)) == [("a", 4.0), ("b", 0.0)]
    assert rows(group(df.limit(0), "", count="*")) == [(0,)]
    with pytest.raises(ValueError, match="group column"):
        group(df, "z", count="1")
    with pytest.raises(ValueError, match="aggregate"):
        group(df, "k")


def test_sort_and_limits(frame):
    df = frame([(2, "b"), (1, "b"), (None, "a"), (3, "a")], "n int, t string")
    assert [r.n for r in sort(df, "t:desc, n").collect()] == [1, 2, None, 3]
    assert [r.n for r in sort(df, ["n:d"]).collect()] == [3, 2, 1, None]
    assert [r.n for r in top_k(df, "n:desc", 2).collect()] == [3, 2]
    assert [r.n for r in limit(sort(df, "n"), 2, 1).collect()] == [1, 2]
    assert [r.n for r in sort(df.coalesce(1), "t", stable=True).collect()] == [None, 3, 2, 1]
    text = frame([("10",), ("9",), ("x",)], "v string")
    assert [r.v for r in sort(text, "v", options=COMPAT).where("v <> 'x'").collect()] == ["9", "10"]
    with pytest.raises(ValueError, match="direction"):
        sort(df, "n:up")


def test_union(frame, rows):
    a, b = frame([(1, "x")], "A int, B string"), frame([(2.5, True)], "A double, C boolean")
    out = union([a, b])
    assert out.columns == ["A", "B", "C"]
    assert rows(out) == [(1.0, "x", None), (2.5, None, True)]
    assert dict(union([frame([(True,)], "v boolean"), frame([("t",)], "v string")]).dtypes) == {"v": "string"}
    with pytest.raises(ValueError):
        union([])


def test_pivot(frame, rows):
    df = frame([("d1", "West", 1), ("d1", "East", 2), ("d2", "West", 3), ("d2", "West", 4)], "date string, region string, amount long").coalesce(1)
    out = pivot(df, "date", "region", "amount")
    assert out.columns == ["date", "West", "East"]
    assert rows(out) == [("d1", 1, 2), ("d2", 4, None)]
    with pytest.raises(ValueError, match="clash"):
        pivot(frame([("x", "date", 1)], "date string, c string, v int"), "date", "c", "v")
    back = unpivot(out, "date", "West,East", "region", "amount")
    assert back.count() == 4 and unpivot(out, "date", "West,East", drop_nulls=True).count() == 3


def test_unpivot_types(frame, rows):
    df = frame([(1, 2.5, "a")], "x int, y double, z string")
    assert rows(unpivot(df, "", "x,y")) == [("x", 1.0), ("y", 2.5)]
    assert rows(unpivot(df, "x", "y,z")) == [(1, "y", "2.5"), (1, "z", "a")]


def test_as_of_join(frame, rows):
    left = frame([("a", 5), ("a", 1), (None, 5), ("b", None)], "k string, t int")
    right = frame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90), (None, 1, 1)], "k string, t int, v int")
    out = as_of_join(left, right, "k", "t", "t")
    assert out.columns == ["k", "t", "t_right", "v"]
    assert set(rows(out)) == {("a", 5, 5, 50), ("a", 1, None, None), (None, 5, None, None), ("b", None, None, None)}


def test_profiles(frame, rows):
    df = frame([(1.0, "x"), (2.0, None), (float("nan"), "x"), (None, "y"), (11.0, "y")], "v double, s string")
    assert rows(profile.null_stats(df).select("column_name", "n_nulls")) == [("s", 1), ("v", 1)]
    hist = profile.histogram(df, "v", 2).orderBy("bin").collect()
    assert [(h.bin, h.n) for h in hist] == [(0, 2), (1, 1)]
    assert rows(profile.histogram(df.where("v = 1"), "v")) == [(0, 1.0, 1.0, 1)]
    assert profile.histogram(df.where("v is null"), "v").count() == 0
    assert [tuple(r) for r in profile.top_values(df, "s", 2).collect()] == [("x", 2), ("y", 2)]
    assert rows(profile.describe(df)) == [(0, "v", "double"), (1, "s", "string")]
    assert profile.cell_text(None) == "NULL" and profile.cell_text("a" * 60).endswith("...") and profile.cell_text(1.239) == "1.24"
    assert profile.bars(["a"], [0]).startswith("a")
