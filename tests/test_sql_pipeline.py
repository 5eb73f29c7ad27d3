import json

import pytest

from millrace.plans.cli import main, parse, pipeline_of
from millrace.plans.pipeline import PLUGINS, Pipeline, external, load_plugins, plugin
from millrace.plans.sql import SqlError, run_sql, strftime_pattern, translate


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0, "2026-01-31 10:00:00"), (2, "a", 30.0, "2026-02-01 00:30:00"), (3, "b", None, "2025-12-01 00:00:00"), (4, None, 0.0, None)], "id int, k string, v double, at string"
    ).selectExpr("id", "k", "v", "cast(at as timestamp) as at")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT id FROM stdin QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1 ORDER BY id", [2, 3, 4]),
        ("SELECT DISTINCT ON (k) id FROM stdin ORDER BY k, v DESC", [2, 3, 4]),
        ("SELECT k FROM stdin ORDER BY k, id LIMIT 4", ["a", "a", "b", None]),
        ("SELECT v / 0 AS q FROM stdin WHERE id = 1", [None]),
        ("SELECT concat(k, '-', id) AS c FROM stdin WHERE id IN (1, 4)", ["a-1", "-4"]),
        ("SELECT strftime(at, '%d.%m.%Y') AS d FROM stdin WHERE id = 1", ["31.01.2026"]),
        ("SELECT strftime('%H:%M', at) AS d FROM stdin WHERE id = 2", ["00:30"]),
        ("SELECT date_diff('month', TIMESTAMP '2025-12-31', at) AS d FROM stdin WHERE id < 4 ORDER BY id", [1, 2, 0]),
        ("SELECT date_diff('hour', TIMESTAMP '2026-01-31 10:59:00', at) AS d FROM stdin WHERE id = 2", [14]),
        ("SELECT size([1, 2, 3]) AS n", [3]),
        ("SELECT {'a': 1, 'b': 2}.b AS n", [2]),
        ("SELECT 7 // 2 AS n", [3]),
        ('SELECT "id" AS "the id" FROM stdin WHERE k = \'b\'', [3]),
        ("SELECT list_contains(list(id), 3) AS x FROM stdin", [True]),
        ("SELECT count(*) AS n FROM stdin -- all of them", [4]),
        ("SELECT i FROM (SELECT generate_series AS i FROM generate_series(1, 3)) WHERE i > 1", [2, 3]),
        ("SELECT quantile_cont(v, 0.5) AS m FROM stdin", [10.0]),
        ("SELECT 1 AS a UNION ALL BY NAME SELECT 2 AS a", [1, 2]),
    ],
)
def test_dialect(spark, t, query, want):
    assert [r[0] for r in run_sql(spark, query, t).collect()] == want


def test_sql_errors_and_extras(spark, t, tmp_path):
    for bad in ("", "  ;", "SELECT * FROM a POSITIONAL JOIN b", "SELECT strftime(x, '%Q') FROM t"):
        with pytest.raises(SqlError):
            translate(bad)
    assert run_sql(spark, "SUMMARIZE stdin", t).count() == 4
    (tmp_path / "x.csv").write_text("a\n5\n")
    assert run_sql(spark, f"SELECT sum(a) AS s FROM read_csv_auto('{tmp_path}/x.csv')").first().s == 5
    assert run_sql(spark, "SELECT * EXCLUDE (v) FROM stdin", t).columns == ["id", "k", "at"]
    assert run_sql(spark, "SELECT * FROM stdin USING SAMPLE 100%", t).count() == 4
    assert strftime_pattern("%Y week") == "yyyy ''w''''e''''e''''k''"
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_pipeline_is_data(spark, t, tmp_path):
    (tmp_path / "o.csv").write_text("k,w\na,1\n")
    p = Pipeline().then("filter", text="v >= 0").then("join", **{"with": str(tmp_path / "o.csv"), "on": "k"}).then("group", keys="k", sum="v", count="1").then("sql", query="SELECT k, v_sum * 2 AS d FROM stdin")
    assert [tuple(r) for r in Pipeline.from_json(p.to_json()).build(spark, t).collect()] == [("a", 80.0)]
    with pytest.raises(ValueError, match="no step"):
        Pipeline().then("fly")
    p.save_as_plugin("twice", str(tmp_path / "plugins"), "doubles")
    assert load_plugins(str(tmp_path / "plugins")) == ["twice"]
    assert Pipeline().then("run", name="twice").build(spark, t).first().d == 80.0
    with pytest.raises(ValueError, match="no plugin"):
        Pipeline().then("run", name="none").build(spark, t)


def test_plugins(spark, t):
    @plugin("least", "keeps values from LEAST on", "LEAST")
    def least(df, n):
        return df.where(df.v >= float(n))

    assert Pipeline().then("run", name="least", args=["10"]).build(spark, t).count() == 2
    assert PLUGINS["inventory"].run(spark).count() == 5
    got = external(t.select("id"), ["cat"]).collect()
    assert sorted(json.loads(r.value)["id"] for r in got) == [1, 2, 3, 4]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("millrace.plans.cli.local_session", lambda: spark)
    monkeypatch.setenv("MILLRACE_HISTORY", str(tmp_path / "log" / "history.jsonl"))
    monkeypatch.setenv("MILLRACE_PLUGINS", str(tmp_path / "none"))
    src = tmp_path / "s.csv"
    src.write_text("region,amount\nwest,10\neast,5\nwest,7\n")
    assert main(["load", str(src), "then", "filter", "amount > 5", "then", "group", "region", "--sum", "amount", "--count", "1"]) == 0
    assert capsys.readouterr().out == "region,amount_sum,region_count\nwest,17.0,2\n"
    assert main(["load", str(src), "then", "store", str(tmp_path / "o.jsonl")]) == 0
    assert (tmp_path / "o.jsonl").read_text().count("\n") == 3
    main(["load", str(src), "--schema-preview"])
    assert "amount: bigint" in capsys.readouterr().out
    monkeypatch.setenv("MILLRACE_PLUGINS", str(tmp_path / "kept"))
    main(["filter", "amount > 5", "then", "save", "large", "--desc", "large ones"])
    assert capsys.readouterr().out.strip().endswith("large.json")
    main(["load", str(src), "then", "run", "large", "then", "view", "-n", "1"])
    assert capsys.readouterr().out == "region | amount\n-------+-------\nwest   | 10\n"
    main(["load", str(src), "then", "store"])
    assert capsys.readouterr().out.startswith("region,amount\n")
    main(["history", "-n", "2"])
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 2 and said[0].endswith("then store") and "run large then view" in said[1]
    main(["load", str(src), "then", "filter", "amount > 6"])
    main(["save", "again", "--last"])
    assert json.loads((tmp_path / "kept" / "again.json").read_text())["steps"][1] == {"step": "filter", "text": "amount > 6"}
    (tmp_path / "log" / "history.jsonl").open("a").write('{"broken')
    main(["history"])
    assert len(capsys.readouterr().out.splitlines()) > 5
    main(["plugins"])
    assert "inventory" in capsys.readouterr().out
    steps = parse(["join", "a.csv", "b.csv", "--on", "k", "then", "pivot", "--index", "a", "--column", "b", "--values", "c", "then", "unpivot", "--values", "x,y", "then", "head", "-n", "3", "then", "nulls"])
    assert [s["step"] for s in pipeline_of(steps).steps] == ["load", "join", "pivot", "unpivot", "limit", "nulls"]


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace.functions.filters import filter_rows
    from millrace.streaming.windows import run_once, window_group

    src = str(tmp_path / "in")
    spark.createDataFrame([(i, f"2026-01-01 00:{i:02d}:00") for i in range(20)], "n int, at string").selectExpr("n", "cast(at as timestamp) at").write.parquet(src)
    stream = filter_rows(spark.readStream.schema("n int, at timestamp").parquet(src), "n >= 5")
    out = []
    run_once(window_group(stream, "at", "10 minutes", [F.sum("n").alias("s")], late="1 minute"), lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"), "complete")
    assert sorted(r.s for r in out) == [35, 145]


def test_programs_run_once_a_partition(spark):
    import subprocess

    from millrace.plans.pipeline import external

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100).repartition(2)
        assert sorted(int(r.value) for r in external(df, ["wc", "-l"]).collect())[0] > 10  # all batches of a partition, one process
        assert external(df, ["cat"]).count() == 100
        with pytest.raises(Exception, match="non-zero exit|CalledProcess"):
            external(df, ["false"]).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert subprocess is not None


def test_failed_casts_are_errors_and_settings_stay(spark):
    from millrace.plans.sql import run_sql

    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run_sql(spark, "SELECT CAST(v AS INTEGER) AS n FROM stdin", spark.createDataFrame([("x",)], "v string")).collect()
    assert run_sql(spark, "SELECT TRY_CAST(v AS INTEGER) AS n, 5 / 0 AS q, 7 // (1 - 1) AS d FROM stdin", spark.createDataFrame([("x",)], "v string")).first() == (None, None, None)
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_asof_join_in_sql(spark):
    from millrace.plans.sql import run_sql

    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), (None, 3)], "k string, t int").createOrReplaceTempView("trades")
    spark.createDataFrame([("a", 0, 10.0), ("a", 4, 11.0), ("b", 3, 12.0)], "k string, t int, price double").createOrReplaceTempView("quotes")
    got = sorted(tuple(r) for r in run_sql(spark, "SELECT q.k, q.t, p.price FROM trades q ASOF JOIN quotes p ON q.k = p.k AND q.t >= p.t").collect())
    assert got == [("a", 1, 10.0), ("a", 5, 11.0)]
    out = run_sql(spark, "SELECT * FROM trades ASOF LEFT JOIN quotes USING (k, t) WHERE t > 1")
    assert out.columns == ["k", "t", "price"] and sorted((tuple(r) for r in out.collect()), key=str) == [("a", 5, 11.0), ("b", 2, None), (None, 3, None)]
    with pytest.raises(ValueError, match="latest row"):
        run_sql(spark, "SELECT 1 FROM trades q ASOF JOIN quotes p ON q.k = p.k AND q.t <= p.t")


def test_unions_by_name_outside_literals(spark):
    from millrace.plans.sql import run_sql

    out = run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT x, 'UNION BY NAME' AS t FROM a UNION BY NAME SELECT 'z' AS t, 2 AS x ORDER BY x DESC")
    assert [(r.x, r.t) for r in out.collect()] == [(2, "z"), (1, "UNION BY NAME")]
