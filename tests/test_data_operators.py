"""The general data operators against plain brute force on small inputs, and their edge cases."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import clean_key, clean_key_py
from millrace.operators import compaction, hot_keys, references, row_check, schema_drift
from millrace.operators.schema_tree import Node, assign, edit_script, merge_schemas, unify

T0 = datetime(2024, 1, 1)


def test_clean_key_twins(spark):
    values = [None, "", " ", "\t ", " A  b\t C ", "ÉTÉ", "x y", "a,b"]
    got = [r.k for r in spark.createDataFrame([(v,) for v in values], "v string").select(clean_key("v").alias("k")).collect()]
    assert got == [clean_key_py(v) for v in values] == [None, None, None, None, "a b c", "été", "x y", "a,b"]


def test_key_totals_against_brute_force(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice(["Big", " big ", "BIG"] * 20 + ["a", "b", None, ""] + [f"k{i}" for i in range(30)]), rng.choice(["x", "Y", None]), rng.choice([1.5, 2.0, None, float("nan"), -3.0])) for _ in range(3000)]
    df = spark.createDataFrame(data, "customer string, region string, amount double").withColumn("n_rows", F.lit(9)).repartition(7)
    want = defaultdict(lambda: [0, 0, 0.0])
    for c, r, a in data:
        for f, k in (("customer", clean_key_py(c)), ("region", clean_key_py(r))):
            w = want[f, k]
            w[0] += 1
            if a is not None and a == a:
                w[1] += 1
                w[2] += a
    totals = hot_keys.key_totals(df, ["customer", "region"], "amount", blocks=3)
    assert {(r.field_name, r.key_value): [r.n_rows, r.n_values, r.total] for r in totals.collect()} == dict(want)
    hot = {(r.field_name, r.key_value) for r in hot_keys.hot_keys(totals, 0.2).collect()}
    assert hot == {("customer", "big"), ("region", "x"), ("region", "y")}
    assert hot_keys.key_totals(df.limit(0), ["customer"]).count() == 0
    assert hot_keys.key_totals(df.select("region"), ["region"]).agg(F.sum("n_rows")).first()[0] == 3000


def _fields(record):
    """Fields of a record, or None where its quoting is broken."""
    out, at = [], 0
    while True:
        if record[at : at + 1] == '"':
            i = at + 1
            while True:
                i = record.find('"', i)
                if i < 0:
                    return None
                if record[i + 1 : i + 2] == '"':
                    i += 2
                    continue
                break
            if record[i + 1 : i + 2] not in (",", ""):
                return None
            out.append(record[at + 1 : i].replace('""', '"'))
            at = i + 1
        else:
            i = record.find(",", at)
            i = len(record) if i < 0 else i
            out.append(record[at:i])
            at = i
        if at >= len(record):
            return out
        at += 1


def _sound(tab, record):
    f = _fields(record) if record is not None else None
    if f is None or len(f) != (5 if tab == "sales" else 4):
        return False
    v = f[3 if tab == "sales" else 1].strip(" ")
    rule = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?" if tab == "sales" else r"[A-Za-z0-9_%+-]+(\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    return v == "" or re.fullmatch(rule, v) is not None


def test_rows_against_a_plain_parser(spark):
    rng = random.Random(2)
    cells = ["a", "", '"q"', '"a,b"', '"x""y"', '"x\ny"', 'pl"ain', '"open', '"shut" ', "12.5", " -1e3 ", '"7"', '" 7 "', "1e", ".", "+.5", "1,5", "５", "a.b+c@x.y", "a..b@x.y", ".a@x.y", "a@x", "a@@x.y", '"a@x-1.y"', "\t1"]
    data = [(i, rng.choice(["sales", "customers"]), ",".join(rng.choice(cells) for _ in range(rng.choice([3, 4, 4, 5, 5, 6])))) for i in range(4000)]
    data += [(9001, "sales", None), (9002, "sales", ""), (9003, "other", "a,b,c,1,d"), (9004, None, "a,b,c,1,d"), (9005, "sales", 'a,b,c,1,"' + 'x""' * 50000 + '"'), (9006, "sales", "a" * 300000 + ",b,c,1.0,d")]
    df = spark.createDataFrame(data, "raw_id int, tab_name string, record_text string").withColumn("reason_extra", F.lit(1))
    schemas = [row_check.SALES, row_check.CUSTOMERS]
    bad = {r.raw_id: (r.broken_field, r.reason) for r in row_check.rejected(df, "record_text", "tab_name", schemas).collect()}
    assert set(bad) == {i for i, t, x in data if t not in ("sales", "customers") or not _sound(t, x)}
    assert bad[9001] == (None, "null_record") and bad[9002][1] == "missing_field" and bad[9003][1] == bad[9004][1] == "unknown_table"
    some = spark.createDataFrame([(1, 'a,b,"c",x,d'), (2, "a,b,c,1"), (3, 'a,"b" ,c,1,d'), (4, "a,b,c,1,d,e")], "i int, r string")
    why = {r.i: (r.broken_field, r.reason) for r in row_check.rejected(some, "r", None, [row_check.SALES]).collect()}
    assert why == {1: ("amount", "invalid_value"), 2: ("date", "missing_field"), 3: ("region", "broken_quoting"), 4: ("", "extra_fields")}
    assert row_check.rejected(df.limit(0), "record_text", "tab_name", schemas).count() == 0


def test_sound_rows_come_out_typed(spark):
    df = spark.createDataFrame([('"A, ""B""",west,,  1e2 ,"x\ny"',), ("a,b,c,,",), ("bad",)], "r string")
    got = [tuple(r) for r in row_check.typed(df, "r", row_check.SALES).collect()]
    assert got == [('A, "B"', "west", None, 100.0, "x\ny"), ("a", "b", "c", None, None)]


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_orphans_against_brute_force(spark, hot):
    rng = random.Random(hot)
    day = lambda n: T0 + timedelta(days=n)
    parents = [(rng.choice(["hot", "a", "b", "c", None]), day(s), day(s + rng.randint(0, 20)) if rng.random() < 0.7 else None) for s in (rng.randint(0, 100) for _ in range(150))]
    parents = [(k, s, e) for k, s, e in parents if rng.random() < 0.6 or k != "c"] + [("late", day(90), None), ("none", None, None)]
    refs = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c", "d", "late", "none", None]), day(rng.randint(0, 110)) if rng.random() < 0.97 else None) for i in range(900)]
    hot_parents = [("hot", day(d), day(d + 1)) for d in range(0, 60, 7)]
    parents = [p for p in parents if p[0] != "hot"] + hot_parents * 3
    r = spark.createDataFrame(refs, "row_id int, customer string, loaded_at timestamp").withColumn("deleted_at", F.lit("clash"))
    p = spark.createDataFrame(parents, "customer string, loaded_at timestamp, deleted_at timestamp")
    out = references.orphan_references(r, p, "customer", "loaded_at", "customer", "loaded_at", "deleted_at", hot=hot)
    assert out.columns == [*r.columns, "orphan_kind"]
    want = {i for i, k, t in refs if k is not None and not any(pk == k and s is not None and t is not None and s <= t and (e is None or e > t) for pk, s, e in parents)}
    got = {x.row_id: x.orphan_kind for x in out.collect()}
    assert set(got) == want
    for i, k, t in refs:
        if i in got:
            began = t is not None and any(pk == k and s is not None and s <= t and (e is None or e > s) for pk, s, e in parents)
            assert got[i] == ("after_run_end" if began else "no_run_before")
    assert references.orphan_references(r, p.limit(0), "customer", "loaded_at", "customer", "loaded_at").count() == sum(k is not None for _, k, _ in refs)
    assert references.orphan_references(r.limit(0), p, "customer", "loaded_at", "customer", "loaded_at").count() == 0


def test_runs_are_contiguous(spark):
    far = 1 << 45  # in another slice of time
    stays = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 5, 7), (1, 1, 6, 20), (1, 1, 30, 40), (2, 1, 1, 2), (3, 1, 0, far + 5), (3, 1, far, far + 9), (3, 1, far + 9, far + 10), (3, 1, far + 20, far + 30)], "_k1 long, _k2 long, _at long, _end long")
    got = sorted((r._k1, r._at, r._end) for r in references.parent_runs(stays).collect())
    assert got == [(1, 0, 20), (1, 30, 40), (2, 1, 2), (3, 0, far + 10), (3, far + 20, far + 30)]


def test_integer_keys_against_brute_force(spark):
    rng = random.Random(9)
    have = [rng.randint(-100, 100) for _ in range(120)] + [65535, 65536, 65537, -65536, 10**12, None]
    refs = [(i, rng.choice([rng.randint(-150, 150), 65534, 65535, 65536, 65538, 10**12, 10**12 + 1, None])) for i in range(600)]
    p = spark.createDataFrame([(k,) for k in have], "id long")
    r = spark.createDataFrame(refs, "row_id int, k long").withColumn("first", F.lit("clash"))
    got = {x.row_id for x in references.integer_orphans(r, p, "k", "id").collect()}
    assert got == {i for i, k in refs if k is not None and k not in have}
    assert references.integer_orphans(r, p.limit(0), "k", "id").count() == sum(k is not None for _, k in refs)
    assert references.integer_orphans(r.limit(0), p, "k", "id").count() == 0
    assert max(len(x._runs) for x in references.key_runs(spark.range(200_000), "id").collect()) == 1


def _unpacked(path):
    import zstandard

    with open(path, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as reader:
        return reader.read()


def test_small_files_and_containers(spark, tmp_path):
    files = [(1, "d1", "a,b", ","), (2, "d1", "a,b", ","), (3, "d1", "b,a", ","), (4, None, None, ","), (5, "d2", "a,b", ","), (6, "d1", "a,b", ",")]
    lines = [(1, 1, "x,1"), (1, 2, "é,2"), (2, 1, "x,1"), (3, 1, "y"), (4, 1, None), (6, 1, "z" * 5000), (99, 1, "nobody")]
    f = spark.createDataFrame(files, "file_id long, day string, header_line string, delim string").withColumn("container_x", F.lit(0))
    x = spark.createDataFrame(lines, "file_id long, line_no int, line_text string")
    sized = compaction.measure(f, x)
    assert {r.file_id: (r.true_bytes, r.n_lines) for r in sized.collect()} == {1: (13, 2), 2: (8, 1), 3: (6, 1), 4: (1, 1), 5: (4, 0), 6: (5005, 1)}
    assert {r.file_id for r in compaction.small_files(sized, 2048).collect()} == {1, 2, 3, 4, 5}
    out = compaction.compact_lines(compaction.plan_containers(sized, ["day"], 4096), x, f"file://{tmp_path}/out").collect()
    assert all(r.valid for r in out) and sum(r.n_files for r in out) == 6 and len(out) == 5
    tall = spark.createDataFrame([(7, i, f"{i},{'v' * (i % 9)}") for i in range(1, 901)], "file_id long, line_no int, line_text string")
    one = spark.createDataFrame([(7, "d", "a,b", ",")], "file_id long, day string, header_line string, delim string")
    cut = compaction.compact_lines(compaction.plan_containers(compaction.measure(one, tall), ["day"], 2000), tall).collect()
    assert len(cut) == 4 and all(r.valid for r in cut) and sum(r.n_lines for r in cut) == 900 and max(r.n_bytes for r in cut) < 2100
    written = sorted(_unpacked(r.path).decode() for r in out)
    assert written == sorted(["a,b\nx,1\né,2\nx,1\n", "b,a\ny\n", "\n", "a,b\n", "a,b\n" + "z" * 5000 + "\n"])
    assert compaction.measure(f.limit(0), x).count() == 0


def test_stored_files_are_joined(spark, tmp_path):
    import zstandard

    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.csv").write_bytes(b"h\n" + b"".join(b"%d,%d\n" % (i, j) for j in range(i)) + (b"tail" if i == 2 else b""))
        (src / f"{i}.jsonl.zst").write_bytes(zstandard.compress(b'{"i":%d}\n' % i))
    got = compaction.compact_paths(spark, f"{src}/*.csv", f"{tmp_path}/out", header_lines=1).collect()
    assert len(got) == 1 and got[0].valid and got[0].n_files == 5
    data = (tmp_path / "out" / got[0].container).read_bytes()
    assert data.count(b"h\n") == 1 and data.count(b"tail\n") == 1 and len(data.splitlines()) == 1 + 10 + 1
    frames = compaction.compact_paths(spark, f"{src}/*.zst", f"{tmp_path}/out2").collect()
    joined = (tmp_path / "out2" / frames[0].container).read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(joined, read_across_frames=True) as reader:
        assert sorted(reader.read().splitlines()) == [b'{"i":%d}' % i for i in range(5)]


def test_assignment_is_the_cheapest():
    import itertools

    rng = random.Random(3)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            cost = [[rng.random() for _ in range(n)] for _ in range(n)]
            got = assign(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i][j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))))


def test_edit_scripts():
    old = Node("", "struct", (Node("id", "long"), Node("addr", "struct", (Node("city", "string"), Node("zip", "long"))), Node("gone", "string")))
    new = Node("", "struct", (Node("address", "struct", (Node("city", "string"), Node("zip", "string"))), Node("id", "long"), Node("fresh", "date")))
    assert {(e.what, e.old, e.new) for e in edit_script(old, new).edits} == {("renamed", "addr", "address"), ("retyped", "addr.zip", "address.zip"), ("removed", "gone", None), ("added", None, "fresh")}
    a = Node("", "struct", (Node("s", "struct", (Node("x", "long"), Node("y", "long"))), Node("t", "struct", (Node("z", "long"),))))
    b = Node("", "struct", (Node("s", "struct", (Node("x", "long"),)), Node("t", "struct", (Node("z", "long"), Node("y", "long")))))
    assert [(e.what, e.old, e.new) for e in edit_script(a, b).edits] == [("moved", "s.y", "t.y")]
    assert edit_script(a, a).cost == 0 and not edit_script(a, a).edits


def test_unify_frames(spark, rows):
    one = spark.createDataFrame([(1, ("SF", 5))], "id int, address struct<city:string,zip:int>")
    two = spark.createDataFrame([(2.5, ("LA", "x"), True)], "id double, address struct<city:string,zip:string>, ok boolean")
    out, edits = unify([one, two])
    assert rows(out.select("id", "address.city", "address.zip", "ok")) == [(1.0, "SF", "5", None), (2.5, "LA", "x", True)]
    assert {(e.what, e.new) for e in edits[0]} == {("retyped", "id"), ("retyped", "address.zip"), ("added", "ok")}
    assert merge_schemas([one.schema]) == one.schema


def _drift_files():
    heads = {
        1: ("f", 1, ",", "customer,region,product,amount,date"), 2: ("f", 2, ";", '"Date";"Prod";"CUSTOMER";"region";"amount"'), 3: ("f", 3, ",", "customer,region,amount,date,qty"),
        4: ("f", 4, ",", "customer,region,item,amount,date,qty"), 5: ("f", 5, ",", "customer,region,item,amount,date"), 6: ("g", 1, ",", "customer,region"), 7: ("f", 6, ",", "customer,region,item,total,date"), 8: ("g", 2, ",", None),
    }
    cells = {1: "A,w,lamp,1.5,2024-01-01", 2: "2024-01-01;17;A;w;1.5", 3: "A,w,2,2024-01-01,5", 4: "A,w,99,2,2024-01-01,", 5: "", 7: "A,w,lamp,3.5,20240101", 6: 'A,"w,x"'}
    return heads, cells


KNOWN = {"customer": ("customer",), "region": ("region",), "product": ("product", "prod", "item"), "amount": ("amount", "total"), "date": ("date",)}


@pytest.mark.parametrize("block", [4096, 2])
def test_drift_report(spark, block):
    heads, cells = _drift_files()
    files = spark.createDataFrame([(k, *v) for k, v in heads.items()], "file_id long, feed string, seq_no int, delim string, header_line string").withColumn("types", F.lit("clash"))
    lines = spark.createDataFrame([(k, 1, v) for k, v in cells.items() if v] + [(99, 1, "x"), (1, 2, None)], "file_id long, line_no int, line_text string")
    got = {(r.file_id, r.field_name, r.change_kind) for r in schema_drift.drift_report(files, lines, KNOWN, block=block).collect()}
    assert got == {
        (2, "product", "renamed"), (2, "product", "retyped"), (3, "product", "removed"), (3, "amount", "retyped"), (3, "qty", "added"), (4, "product", "added"), (5, "qty", "removed"),
        (7, "amount", "renamed"), (7, "amount", "retyped"), (7, "product", "retyped"), (7, "date", "retyped"), (8, "customer", "removed"), (8, "region", "removed"),
    }
    assert schema_drift.drift_report(files.limit(0), lines).count() == 0
    assert schema_drift.drift_report(files, lines.limit(0)).where("change_kind = 'retyped'").count() == 0


def test_consistent_table(spark):
    heads, cells = _drift_files()
    files = spark.createDataFrame([(k, *v, "2024-3-4") for k, v in heads.items()], "file_id long, feed string, seq_no int, delim string, header_line string, date string")
    lines = spark.createDataFrame([(k, 1, v) for k, v in cells.items()], "file_id long, line_no int, line_text string")
    got = {r.file_id: r for r in schema_drift.consistent_table(files, lines, KNOWN).collect()}
    assert len(got) == len(cells)
    assert (got[2]["product"], got[2].amount, got[2].customer, got[2].date) == ("17", "1.5", "A", "2024-01-01")
    assert got[6].region == "w,x" and got[6].date == "2024-3-4" and got[3].others == {"qty": "5"} and got[5].customer is None
    odd = spark.createDataFrame([("KRN 1,234.50",), ("107,80",), ("-3",), ("x",), (None,)], "m string").select(schema_drift.money(F.col("m")).alias("v"))
    assert [r.v for r in odd.collect()] == [1234.5, 107.8, -3.0, None, None]
    days = spark.createDataFrame([("2024-3-4",), ("20240304",), ("4.3.2024",), ("2024-03-04 10:00",), ("2024-13-40",), ("1709510400",), ("1709510400999",)], "d string").select(schema_drift.calendar_date(F.col("d")).cast("string").alias("v"))
    assert [r.v for r in days.collect()] == ["2024-03-04"] * 4 + [None] + ["2024-03-04"] * 2


def test_unlisted_names_are_tied_by_their_cells(spark):
    rng = random.Random(5)
    things = ["desk lamp", "garden stool", "fan", "kettle", "shelf"]
    heads = [
        (1, "a", 1, "customer,product,amount,date"),
        (2, "a", 2, "customer,Bezeichnung,amount,date"),
        (3, "a", 3, "customer,Bezeichnung,Betrag,date,qty"),
        (4, "a", 4, "customer,product,Betrag,Verkauft am,qty"),
        (5, "b", 1, "customer,product,amount,date,qty"),
        (6, "b", 2, "customer,product,date,qty,note"),
    ]
    cells = {
        "customer": lambda: f"c{rng.randint(1, 9)}", "product": lambda: rng.choice(things), "amount": lambda: f"{rng.uniform(20, 90):.2f}",
        "date": lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "qty": lambda: str(rng.randint(1, 6)), "note": lambda: "call first",
    }
    same = {"bezeichnung": "product", "betrag": "amount", "verkauft am": "date"}
    made = [(i, k, [cells[same.get(h.lower(), h)]() for h in head.split(",")], head) for i, _, _, head in heads for k in range(40)]
    files = spark.createDataFrame([(i, f, n, ",", h, None) for i, f, n, h in heads], "file_id long, feed string, seq_no int, delim string, header_line string, date string")
    lines = spark.createDataFrame([(i, k, ",".join(c)) for i, k, c, _ in made], "file_id long, line_no int, line_text string")
    for block in (4096, 2):
        got = {(r.file_id, r.field_name, r.change_kind) for r in schema_drift.drift_report(files, lines, block=block).collect()}
        assert got == {
            (2, "product", "renamed"), (3, "amount", "renamed"), (3, "qty", "added"), (4, "product", "renamed"), (4, "date", "renamed"),
            (6, "amount", "removed"), (6, "note", "added"),
        }
    rows = {(r.file_id, r.line_no): r for r in schema_drift.consistent_table(files, lines).collect()}
    assert len(rows) == len(made)
    for i, k, c, head in made:
        want = {same.get(h.lower(), h): x for h, x in zip(head.split(","), c, strict=True)}
        r = rows[i, k]
        assert [r[f] for f in ("customer", "product", "amount", "date")] == [want.get(f) for f in ("customer", "product", "amount", "date")]
        assert dict(r.others or {}) == {h: x for h, x in want.items() if h in ("qty", "note")}


def test_small_files_come_from_the_validated_containers(spark, tmp_path, monkeypatch):
    from millrace.plans import data_queries

    files = [(1, "a,b", "2024-01-01"), (2, "a,b", "2024-01-01"), (3, None, "2024-01-01"), (4, "a,b", None), (5, "ä", "2024-01-02")]
    spark.createDataFrame(files, "file_id long, header_line string, date string").withColumn("delim", F.lit(",")).write.parquet(f"{tmp_path}/sales_files.parquet")
    rows = [(1, 1, "x" * 2042), (2, 1, "x" * 2043), (3, 1, "x" * 2046), (5, 1, None), (5, 2, "é"), (9, 1, "no file")]
    spark.createDataFrame(rows, "file_id long, line_no int, line_text string").write.parquet(f"{tmp_path}/file_rows.parquet")
    monkeypatch.setattr(data_queries, "fresh_dir", lambda *_: f"file://{tmp_path}/out")
    got = {r.file_id for r in data_queries.p5_found(spark, str(tmp_path)).collect()}
    assert got == {1, 3, 4, 5}
    assert not (tmp_path / "out").exists()  # removed once they were checked
    planned, text = data_queries._planned(spark, str(tmp_path)), spark.read.parquet(f"{tmp_path}/file_rows.parquet")
    sizes = {r.file_id: (r.n_lines, r.true_bytes) for r in compaction.compact_measured(planned, text, f"file://{tmp_path}/kept").collect()}
    assert sizes == {1: (1, 2047), 2: (1, 2048), 3: (1, 2047), 4: (0, 4), 5: (2, 7)}
    # the containers hold three headers of four bytes or less, once each, and every line
    stored = [_unpacked(x) for x in (tmp_path / "kept").glob("*.zst")]
    assert sorted(map(len, stored)) == sorted([4 + 2043 + 2044, 2047, 4, 3 + 1 + 3]) and not list((tmp_path / "kept").glob("*.tmp"))
    planned = data_queries._planned(spark, str(tmp_path)).withColumn("n_lines", F.col("n_lines") + (F.col("file_id") == 2).cast("long"))
    with pytest.raises(ValueError, match="planned"):
        compaction.compact_measured(planned, spark.read.parquet(f"{tmp_path}/file_rows.parquet"))


def test_stored_bytes_are_read_again_and_frames_are_whole(spark, tmp_path):
    from pyarrow import fs as pafs

    local = pafs.LocalFileSystem()
    whole = pa.compress(b"record one\n" * 50, codec="zstd", asbytes=True)
    (tmp_path / "a.zst").write_bytes(whole[:-3])
    (tmp_path / "b.zst").write_bytes(whole + b"\x50\x2a\x4d\x18\x02\x00\x00\x00ab")
    with pytest.raises(ValueError, match="within a zstandard frame"):
        compaction._join_files(local, [f"{tmp_path}/a.zst", f"{tmp_path}/b.zst"], f"{tmp_path}/out.zst", 0)
    pieces = compaction._join_files(local, [f"{tmp_path}/b.zst"] * 2, f"{tmp_path}/out.zst", 0)[3]
    assert compaction._stored(local, f"{tmp_path}/out.zst", pieces)
    bad = bytearray((tmp_path / "out.zst").read_bytes())
    bad[-1] ^= 1
    for data in (bytes(bad), bytes(bad[:-1]), bytes(bad) + b"x"):
        (tmp_path / "out.zst").write_bytes(data)
        assert not compaction._stored(local, f"{tmp_path}/out.zst", pieces)


def test_large_files_are_framed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "_FRAME", 500)
    files = spark.createDataFrame([(1, "d", "a,b", ","), (2, "d", "a,b", ",")], "file_id long, day string, header_line string, delim string")
    lines = spark.createDataFrame([(f, i, f"{f},{i},{'é' * (i % 7)}") for f, n in ((1, 800), (2, 5)) for i in range(1, n + 1)], "file_id long, line_no int, line_text string").repartition(5)
    planned = compaction.plan_containers(compaction.measure(files, lines), ["day"], 4000)
    out = compaction.compact_lines(planned, lines, f"file://{tmp_path}/out").collect()
    assert all(r.valid for r in out) and len(out) >= 4
    got = [x for r in out for x in _unpacked(r.path).decode().splitlines() if x != "a,b"]
    assert sorted(got) == sorted(r.line_text for r in lines.collect())
    assert sum(r.n_bytes for r in compaction.stored_sums(spark.createDataFrame([(r.container, r.path, True) for r in out], "container string, path string, has_header boolean")).collect()) == sum(len(x.encode()) + 1 for x in got)


def test_block_sums_hold_one_block_at_a_time(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("k"), F.lit(1.0).alias("v")).repartition(6)
    got = hot_keys.key_totals(df, ["k"], "v", blocks=97).collect()
    assert len(got) == 5000 and all((r.n_rows, r.n_values, r.total) == (4, 4, 4.0) for r in got)


def test_leaf_costs_decide_a_script():
    old = Node("", "struct", (Node("price", "double"), Node("day", "date")))
    new = Node("", "struct", (Node("betrag", "double"), Node("qty", "long")))
    script = edit_script(old, new, lambda a, b: 0.4 if (a.name, b.name) == ("price", "betrag") else 1e6)
    assert script.kept == {"price": "betrag"} and {(e.what, e.old, e.new) for e in script.edits} == {("renamed", "price", "betrag"), ("removed", "day", None), ("added", None, "qty")}
