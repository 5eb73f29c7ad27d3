import json
import os

import pyarrow as pa
import pytest

from millrace.options import Options
from millrace.sources import paths as P
from millrace.sources.read import from_arrow, load, preview_schema, read_lines
from millrace.sources.write import print_csv, store, write_arrow
from millrace.sources.xml_records import records


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    put.root = str(tmp_path)
    return put


def test_paths(folder):
    a, b = folder("a.csv", "id\n1\n"), folder("b.json", "[]")
    c = folder("sub/c.csv", "id\n2\n")
    root = folder.root
    assert P.has_wildcard("x*.csv") and P.has_wildcard("a[1]") and not P.has_wildcard("a.csv")
    assert P.resolve(root) == sorted([a, b, c])
    assert P.resolve(root, recursive=False) == [a, b]
    assert P.resolve(f"{root}/*.csv") == [a] and P.resolve(f"{root}/**/*.csv") == sorted([a, c])
    assert P.resolve(f"{a},{b},{a}") == [a, b] and P.resolve(root, "csv") == sorted([a, c])
    with pytest.raises(ValueError, match="at most"):
        P.resolve(root, max_files=2)
    for bad in (f"{root}/none*.csv", f"{root}/none.csv"):
        with pytest.raises(FileNotFoundError):
            P.resolve(bad)
    assert P.format_of("X.NDJSON") == "jsonl" and P.format_of("x.bin") == "csv"
    assert P.partition_values("a/day=1/k=__HIVE_DEFAULT_PARTITION__/f.csv") == {"day": "1", "k": None}


def test_csv_types_and_nulls(spark, folder):
    path = folder("t.csv", 'id,name,score,ok,day\n1," A, ""x""",1.5,true,2026-01-01\n2,,,,\n3,"two\nlines",2,false,2026-01-02\n')
    df = load(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "ok": "boolean", "day": "string"}
    got = df.orderBy("id").collect()
    assert got[0].name.strip() == 'A, "x"' and got[1].name is None and got[1].score is None and "lines" in got[2].name


def test_many_files(spark, folder):
    folder("d/1.csv", "id,name\n1,a\n")
    folder("d/2.csv", "id,age\n2,30\n")
    folder("d/3.csv", "id,name\n3.5,c\n")
    folder("d/4.tsv", "id\textra\n4\tz\n")
    df = load(spark, folder.root + "/d")
    assert df.columns == ["id", "name", "age", "extra"] and dict(df.dtypes)["id"] == "double" and df.count() == 4
    assert preview_schema(spark, folder.root + "/d/*.csv").fieldNames() == ["id", "name", "age"]


def test_partition_columns(spark, folder):
    for d in ("2026-03-01", "2026-03-02"):
        folder(f"p/date={d}/s.csv", f"customer,amount\nA,{len(d)}\n")
    df = load(spark, folder.root + "/p")
    assert df.columns == ["customer", "amount", "date"] and {r.date for r in df.collect()} == {"2026-03-01", "2026-03-02"}
    assert load(spark, folder.root + "/p", options=Options(partition_columns=False)).columns == ["customer", "amount"]


def test_json_shapes(spark, folder):
    nested = [{"c": "A", "address": {"city": "SF"}, "tags": ["x"]}, {"c": "B", "n": 1}]
    assert set(load(spark, folder("n.json", json.dumps(nested, indent=1))).columns) == {"c", "address.city", "tags", "n"}
    df = load(spark, folder("c.json", '{"a": [1, 2], "b": ["x", "y"]}'))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y")]
    assert load(spark, folder("o.json", '{"a": 1, "b": {"c": 2}}')).columns == ["a", "b.c"]
    assert load(spark, folder("l.jsonl", '{"a":1}\n\n{"a":2}\n')).count() == 2


def test_xml(spark, folder):
    doc = '<harbour><quay><berth><length>90</length><ship>Alba</ship></berth><berth><length>120</length></berth></quay><tide high="7"><hour>6</hour></tide></harbour>'
    got = records(doc)
    assert {"quay.berth.length": "90", "quay.berth.ship": "Alba"}.items() <= next(r for r in got if r.get("quay.berth.ship")).items()
    assert len(got) == 2 and all(r["tide.hour"] == "6" and r["tide.high"] == "7" for r in got)
    df = load(spark, folder("r.xml", "<rs><r><id>1</id><n>a</n></r><r><id>2</id><n/></r></rs>"))
    assert sorted((r["r.id"], r["r.n"]) for r in df.collect()) == [(1, "a"), (2, None)]
    assert records("<a>x</a>") == [{"value": "x"}] and records("<a><t>1</t><t>2</t><u k='3'>v</u></a>") == [{"u.k": "3", "u._text": "v", "t": "1"}, {"u.k": "3", "u._text": "v", "t": "2"}]
    assert load(spark, folder("s.xml", "<rs><r><id>1</id></r><r><id>2</id></r></rs>"), row_tag="r").count() == 2
    with pytest.raises(Exception, match="mismatched"):
        records("<a><b></a>")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "jsonl", "xml", "parquet", "arrow"])
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, 'q"x', None), (3, None, 2.0)], "id long, name string, v double")
    path = str(tmp_path / f"out.{fmt}")
    store(df, path, single_file=fmt not in ("parquet",))
    assert sorted(tuple(r) for r in load(spark, path, row_tag="record" if fmt == "xml" else None).select("id", "name", "v").collect()) == sorted(tuple(r) for r in df.collect())


def test_nested_columns_in_flat_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], ("x",))], "id int, a array<int>, s struct<t:string>")
    store(df, str(tmp_path / "n.csv"), single_file=True)
    assert open(tmp_path / "n.csv").read() == 'id,a,s\n1,"[1,2]","{""t"":""x""}"\n'


def test_arrow_nulls_and_unsigned(spark, tmp_path):
    df = from_arrow(spark, pa.table({"u": pa.array([2**63 + 1, None], pa.uint64())}))
    assert [r.u for r in df.collect()][1] is None and int(df.first().u) == 2**63 + 1
    write_arrow(df, str(tmp_path / "x.arrow"))
    assert load(spark, str(tmp_path / "x.arrow")).count() == 2


def test_lines(spark, capsys):
    df = read_lines(spark, ["a,b", "1,x", "2,"])
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    print_csv(df)
    assert capsys.readouterr().out == "a,b\n1,x\n2,\n"
    assert read_lines(spark, ['{"a": [1, 2]}'], "json").count() == 2
    assert os.path.sep


def test_sources_with_a_scheme(spark, tmp_path):
    """Paths that name their file system: patterns, folders, one file, stored tables, and writing."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    root = f"file://{tmp_path}"
    for at in ("x/one.csv", "x/deep/two.csv", "three.csv"):
        store(df, f"{root}/{at}", single_file=True)
    store(df, f"{root}/x/table.parquet")
    store(df, f"{root}/x/rows.json")
    store(df, f"{root}/x/rows.arrow")
    count = lambda source, **more: load(spark, source, **more).count()
    assert count(f"{root}/x/one.csv") == 2 and count(f"{root}/**/*.csv") == 6 and count(f"{root}/x/*.csv") == 2 and count(f"{root}/[!x]*.csv") == 2
    assert count(f"{root}/x/table.parquet") == 2 and count(f"{root}/x/rows.json") == 2 and count(f"{root}/x/rows.arrow") == 2
    assert count(f"{root}/x", fmt="csv") == 4 and count(f"{root}/x", fmt="csv", recursive=False) == 2 and count(f"{root}/x", fmt="parquet") == 2
    with pytest.raises(FileNotFoundError):
        load(spark, f"{root}/x/*.tsv")


def test_patterns_follow_the_shell():
    from millrace.sources.paths import pattern_of

    for pattern, good, bad in (("a/*.csv", ["a/x.csv"], ["a/b/x.csv"]), ("a/**/*.csv", ["a/x.csv", "a/b/c/x.csv"], ["b/x.csv"]), ("a/?.c", ["a/x.c"], ["a/xy.c"]), ("[ab]!.c", ["a!.c"], ["c!.c"]), ("[!ab].c", ["c.c"], ["a.c"])):
        assert all(pattern_of(pattern).fullmatch(x) for x in good) and not any(pattern_of(pattern).fullmatch(x) for x in bad)
