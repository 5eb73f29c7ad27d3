"""Queries over the general data problems (p1 to p5) and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_key
from millrace.operators import compaction, hot_keys, references, row_check, schema_drift
from millrace.operators.schema_tree import unify
from millrace.session import cut_lineage, fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = hot_keys.key_totals(table(spark, sf_dir, "sales"), ["customer", "region"], "amount")
    return totals.withColumn("total", F.round("total", 2))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = hot_keys.key_totals(table(spark, sf_dir, "sales"), ["customer", "region"], "amount")
    return hot_keys.hot_keys(totals, 0.03).select("field_name", "key_value")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = schema_drift.drift_report(table(spark, sf_dir, "sales_files"), table(spark, sf_dir, "file_rows"))
    return report.select("file_id", "field_name", "change_kind").distinct()


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema_drift.consistent_table(table(spark, sf_dir, "sales_files"), table(spark, sf_dir, "file_rows"))
    return rows.withColumns({"amount": schema_drift.money(F.col("amount")), "date": schema_drift.calendar_date(F.col("date")), "others": F.to_json("others")})


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table without the columns that stay the files' own."""
    return p2_table(spark, sf_dir).drop("others")


def p2_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested web sales as three drifting versions (fields moved, renamed, retyped, left out), made one table again."""
    web = table(spark, sf_dir, "web_sales").select("row_id", "customer", "amount", "date", "metadata")
    first = web.where(F.pmod("row_id", F.lit(3)) == 0)
    second = web.where(F.pmod("row_id", F.lit(3)) == 1).withColumn("amount", F.col("amount").cast("string")).withColumn(
        "metadata", F.struct(F.col("metadata.discount").alias("discounts"), F.col("metadata.shipping").alias("shipping"))
    )
    third = web.where(F.pmod("row_id", F.lit(3)) == 2).select("row_id", "date", "metadata", F.col("customer").alias("customers"))
    out, _ = unify([first, second, third])
    names = {c: F.col(c) for c in out.columns}
    customer = names["customers"] if "customers" in names else names["customer"]
    inner = dict(out.schema["metadata"].dataType.fieldNames() and {n: F.col(f"metadata.{n}") for n in out.schema["metadata"].dataType.fieldNames()})
    discount = inner.get("discounts", inner.get("discount"))
    return out.select("row_id", customer.alias("customer"), F.col("amount").cast("double").alias("amount"), "date", discount.alias("discount"), inner["shipping"].alias("shipping"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_check.rejected(table(spark, sf_dir, "raw_rows"), "record_text", "tab_name", [row_check.SALES, row_check.CUSTOMERS]).select("raw_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_check.rejected(table(spark, sf_dir, "raw_rows"), "record_text", "tab_name", [row_check.SALES, row_check.CUSTOMERS]).select(
        "raw_id", "tab_name", "broken_field", "reason"
    )


def p3_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_check.typed(table(spark, sf_dir, "raw_rows").where(F.col("tab_name") == "sales"), "record_text", row_check.SALES, ["raw_id"])


def p3_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_check.typed(table(spark, sf_dir, "raw_rows").where(F.col("tab_name") == "customers"), "record_text", row_check.CUSTOMERS, ["raw_id"])


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("tab_name"), "row_id", clean_key("customer").alias("customer"), "loaded_at")
        for t in ("sales", "web_sales")
    ]
    return parts[0].unionByName(parts[1])


def _orphans(spark: SparkSession, sf_dir: str, refs: DataFrame) -> DataFrame:
    parents = table(spark, sf_dir, "customers").select(clean_key("customer").alias("customer"), "loaded_at", "deleted_at")
    return references.orphan_references(refs, parents, "customer", "loaded_at", "customer", "loaded_at", "deleted_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir, _references(spark, sf_dir)).select("tab_name", "row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _references(spark, sf_dir)
    return references.orphan_report(refs.where(F.col("customer").isNotNull()), _orphans(spark, sf_dir, refs), "tab_name", "loaded_at")


#: References whose keys are integers: table and column, and the table and column they refer to.
_INTEGER = (("file_rows", "file_id", "sales_files", "file_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_nationkey", "region", "r_regionkey"))


def p4_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of integer keys, per table, key of the reference and how often it occurs."""
    out = []
    for t, key, parent, parent_key in _INTEGER:
        orphans = references.integer_orphans(table(spark, sf_dir, t).select(key), table(spark, sf_dir, parent), key, parent_key)
        out.append(orphans.groupBy(F.lit(t).alias("tab_name"), F.col(key).cast("long").alias("key_value")).agg(F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "sales_files").select("file_id", schema_drift.calendar_date(F.col("date")).alias("day"), "delim", "header_line")
    return compaction.plan_containers(compaction.measure(files, table(spark, sf_dir, "file_rows")), ["day"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small files, by the bytes that the validated containers got of each."""
    joined = compaction.compact_measured(_planned(spark, sf_dir), table(spark, sf_dir, "file_rows"), fresh_dir(spark, "p5-found"), keep=False)
    return compaction.small_files(joined, compaction.SMALL_BYTES).select("file_id")


def p5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = compaction.compact_lines(_planned(spark, sf_dir), table(spark, sf_dir, "file_rows"), fresh_dir(spark, "p5-layout"))
    return manifest.select("container", "n_files", "n_lines", "n_bytes", "stored_bytes", "valid")


def p5_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date: lines, bytes and checksum of what the layout's containers hold when they are read again."""
    planned = cut_lineage(_planned(spark, sf_dir))  # a row a file
    manifest = compaction.compact_lines(planned, table(spark, sf_dir, "file_rows"), fresh_dir(spark, "p5-stored")).where("path is not null")
    base = F.regexp_replace("container", r"^(whole-[^-]*)-[0-9]+$", "$1")
    days = planned.groupBy(F.col("container").alias("_c")).agg(F.first("day").alias("day"), F.first("header_line").isNotNull().alias("has_header"))
    dated = manifest.withColumn("_c", base).join(days, "_c").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    sums = compaction.stored_sums(dated).join(dated.select("container", "day"), "container")
    return sums.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_bytes", "line_sum")])


def p5_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date: files before and after, lines and body bytes, from the containers' plan."""
    day = F.date_format("day", "yyyy-MM-dd").alias("day")
    head = F.when(F.col("header_line").isNull(), 0).otherwise(F.octet_length("header_line") + 1)
    planned = _planned(spark, sf_dir)
    return planned.groupBy(day).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum(F.col("true_bytes") - head).alias("body_bytes"), F.sum("line_crc_sum").alias("line_crc_sum")
    ).drop("line_crc_sum")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_totals": p1_totals,
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p2_rows": p2_rows,
    "p2_nested": p2_nested,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p3_sales": p3_sales,
    "p3_customers": p3_customers,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_integer": p4_integer,
    "p5_found": p5_found,
    "p5_layout": p5_layout,
    "p5_stored": p5_stored,
    "p5_dates": p5_dates,
}


def _key(col: str) -> str:
    return f"nullif(lower(trim(regexp_replace({col}, '[ \\t\\x{{00A0}}\\x{{2007}}\\x{{202F}}]+', ' ', 'g'))), '')"


_KEYS = f"""
    SELECT 'customer' AS field_name, {_key("customer")} AS key_value, amount FROM sales
    UNION ALL SELECT 'region', {_key("region")}, amount FROM sales"""
_FREE = '(?:"[^"]*(?:""[^"]*)*"|[^",][^,]*|)'
_NUM = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_MAIL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def _day(text: str) -> str:
    """SQL for a date (UTC) from the spellings that occur."""
    ways = ((r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)), (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", (1, 2, 3)), (r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", (3, 2, 1)))
    part = lambda p, i, n: f"lpad(regexp_extract(trim({text}), '{p}', {i}), {n}, '0')"
    cases = [f"WHEN regexp_matches(trim({text}), '{p}') THEN TRY_CAST({part(p, y, 4)} || '-' || {part(p, m, 2)} || '-' || {part(p, d, 2)} AS DATE)" for p, (y, m, d) in ways]
    seconds = f"WHEN regexp_matches(trim({text}), '^1[0-9]{{9}}$') THEN DATE '1970-01-01' + CAST(floor(CAST(trim({text}) AS BIGINT) / 86400) AS INTEGER)"
    return f"CASE {seconds} {' '.join(cases)} END"


_DAY = _day("date")


def _cell(rule: str) -> str:
    return f'(?: *(?:{rule})? *|" *(?:{rule})? *")'


_SALES_RE = r"\A" + ",".join([_FREE] * 3 + [_cell(_NUM), _FREE]) + r"\z"
_CUST_RE = r"\A" + ",".join([_FREE, _cell(_MAIL), _FREE, _FREE]) + r"\z"
_COLUMNS = {"sales": ("customer", "region", "product", "amount", "date"), "customers": ("customer", "email", "tier", "signup_date")}
_RULES = {"amount": _cell(_NUM), "email": _cell(_MAIL)}


def _broken(tab: str, n: int) -> str:
    """SQL for a record's first broken field and what is wrong with it, nulls where it is sound."""
    names = _COLUMNS[tab]
    ruled = [_RULES.get(c, _FREE) for c in names]
    cases = []
    for k in range(1, n + 1):
        before, free = ",".join(ruled[: k - 1]), ",".join([_FREE] * k)
        why = f"WHEN NOT regexp_matches(record_text, '\\A{free}(?:,|\\z)', 's') THEN 'broken_quoting' ELSE 'invalid_value'"
        ended = f"WHEN regexp_matches(record_text, '\\A{','.join([_FREE] * (k - 1))}\\z', 's') THEN 'missing_field' " if k > 1 else ""
        cases.append(f"WHEN NOT regexp_matches(record_text, '\\A{','.join(ruled[:k])}(?:,|\\z)', 's') THEN {{'f': '{names[k - 1]}', 'r': CASE {ended}{why} END}}")
    return f"CASE {' '.join(cases)} WHEN NOT regexp_matches(record_text, '\\A{','.join(ruled)}\\z', 's') THEN {{'f': '', 'r': 'extra_fields'}} ELSE {{'f': NULL, 'r': NULL}} END"


def _typed_sql(tab: str, whole: str, columns: dict[str, int], kinds: dict[str, str]) -> str:
    """SQL for the sound records of a table as typed columns; of columns marked 1 outer blanks go."""
    ruled = [_RULES.get(c, _FREE) for c in columns]
    groups = ",".join(f"({r})" for r in ruled)
    cells = ", ".join(f"regexp_extract(record_text, '\\A{groups}\\z', {i}, 's') AS c{i}" for i in range(1, len(ruled) + 1))
    bare = lambda i: f"CASE WHEN starts_with(c{i}, '\"') THEN replace(c{i}[2:-2], '\"\"', '\"') ELSE c{i} END"
    out = []
    for i, (c, trimmed) in enumerate(columns.items(), start=1):
        value = f"CASE WHEN trim({bare(i)}) <> '' THEN {f'trim({bare(i)})' if trimmed else bare(i)} END"
        out.append(f"TRY_CAST({value} AS {kinds[c]}) AS {c}" if c in kinds else f"{value} AS {c}")
    return f"SELECT raw_id, {', '.join(out)} FROM (SELECT raw_id, {cells} FROM raw_rows WHERE tab_name = '{tab}' AND regexp_matches(record_text, '{whole}', 's'))"


_REFS = f"""
    SELECT 'sales' AS tab_name, row_id, {_key("customer")} AS k, loaded_at FROM sales
    UNION ALL SELECT 'web_sales', row_id, {_key("customer")}, loaded_at FROM web_sales"""
_ORPHANS = f"""refs AS ({_REFS}), par AS (SELECT {_key("customer")} AS k, loaded_at AS lo, deleted_at AS hi FROM customers),
    orphans AS (SELECT * FROM refs r WHERE k IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM par p WHERE p.k = r.k AND p.lo <= r.loaded_at AND (p.hi IS NULL OR p.hi > r.loaded_at)))"""
_SIZES = """body AS (SELECT file_id, count(*) AS n_lines, sum(strlen(line_text) + 1) AS b FROM file_rows GROUP BY file_id),
    sized AS (SELECT f.*, coalesce(n_lines, 0) AS n_lines, coalesce(b, 0) AS body, strlen(header_line) + 1 + coalesce(b, 0) AS true_bytes
              FROM sales_files f LEFT JOIN body USING (file_id))"""

#: Names that the fields go by in the test tables (fixed values): the SQL is told them, the operator isn't.
_NAMES = {
    "customer": ("customer", "client", "buyer", "customer name"),
    "region": ("region", "area", "territory"),
    "product": ("product", "prod", "item", "article", "ware", "product_name", "sku title"),
    "amount": ("amount", "amt", "value", "total", "paid", "nettotal", "sale_amount"),
    "date": ("date", "dt", "day", "sale_date", "soldon", "order date"),
}
_FIELD = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(a) for a in names)}) THEN '{f}'" for f, names in _NAMES.items()) + " ELSE name END"
_SPLIT = {",": ",", ";": ";", "|": r"\|", "\t": r"\t"}
_CELLS = "CASE delim " + " ".join(
    f"""WHEN {"chr(9)" if d == "\t" else repr(d)} THEN regexp_extract_all(delim || {{line}}, '{e}("(?:[^"]|"")*"|[^{e}]*)', 1)""" for d, e in _SPLIT.items()
) + " END"
_DRIFT = f"""files AS (SELECT file_id, feed, seq_no, delim, {_CELLS.format(line="header_line")} AS names FROM sales_files),
    cols AS (SELECT file_id, feed, seq_no, pos, {_FIELD} AS field, name FROM
        (SELECT file_id, feed, seq_no, pos, lower(trim(trim(trim(names[pos]), '"'))) AS name FROM files, unnest(range(1, len(names) + 1)) t(pos))),
    cells AS (SELECT file_id, {_CELLS.format(line="line_text")} AS c FROM file_rows JOIN sales_files USING (file_id)),
    flat AS (SELECT file_id, pos, CASE WHEN starts_with(c[pos], '"') THEN replace(c[pos][2:-2], '""', '"') ELSE c[pos] END AS cell FROM cells, unnest(range(1, len(c) + 1)) t(pos)),
    kinds AS (SELECT file_id, pos, CASE WHEN bool_and(regexp_full_match(cell, '[+-]?[0-9]+')) THEN 'long'
        WHEN bool_and(regexp_full_match(cell, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')) THEN 'double'
        WHEN bool_and(regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'date' ELSE 'string' END AS kind FROM flat WHERE cell <> '' GROUP BY file_id, pos),
    typed AS (SELECT c.*, last_value(k.kind IGNORE NULLS) OVER (PARTITION BY feed, field ORDER BY seq_no ROWS UNBOUNDED PRECEDING) AS kind FROM cols c LEFT JOIN kinds k USING (file_id, pos)),
    pairs AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY seq_no) AS before FROM sales_files),
    now AS (SELECT p.file_id, p.before, t.field, t.name, t.kind FROM pairs p JOIN typed t USING (file_id) WHERE p.before IS NOT NULL),
    old AS (SELECT p.file_id, t.field, t.name, t.kind FROM pairs p JOIN typed t ON t.file_id = p.before)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_DRIFT}, joined AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.field, o.field) AS field_name, n.field AS nf, o.field AS of, n.name AS nn, o.name AS oname, n.kind AS nk, o.kind AS ok
            FROM now n FULL JOIN old o ON n.file_id = o.file_id AND n.field = o.field)
        SELECT file_id, field_name, 'added' AS change_kind FROM joined WHERE of IS NULL UNION ALL SELECT file_id, field_name, 'removed' FROM joined WHERE nf IS NULL
        UNION ALL SELECT file_id, field_name, 'renamed' FROM joined WHERE nn <> oname UNION ALL SELECT file_id, field_name, 'retyped' FROM joined WHERE nk <> ok""",
    "p2_rows": f"""WITH {_DRIFT}, lines AS (SELECT file_id, line_no, {_CELLS.format(line="line_text")} AS c FROM file_rows JOIN sales_files USING (file_id)),
        every AS (SELECT l.file_id, l.line_no, k.field, nullif(CASE WHEN starts_with(c[k.pos], '"') THEN replace(c[k.pos][2:-2], '""', '"') ELSE c[k.pos] END, '') AS cell FROM lines l JOIN cols k USING (file_id)),
        wide AS (SELECT file_id, line_no, {", ".join(f"max(cell) FILTER (WHERE field = '{f}') AS {f}" for f in _NAMES)} FROM every GROUP BY ALL),
        bare AS (SELECT w.* EXCLUDE (amount, date), regexp_replace(amount, '[^0-9,.+eE-]', '', 'g') AS a, coalesce(w.date, f.date) AS day FROM wide w JOIN sales_files f USING (file_id))
        SELECT file_id, line_no, customer, region, product, TRY_CAST(CASE WHEN regexp_matches(a, '^[+-]?[0-9]+,[0-9]{{1,2}}$') THEN replace(a, ',', '.') ELSE replace(a, ',', '') END AS DOUBLE) AS amount, {_day("day")} AS date FROM bare""",
    "p2_nested": """SELECT row_id, customer, CASE WHEN row_id % 3 = 2 THEN NULL ELSE amount END AS amount, date, metadata.discount AS discount, metadata.shipping AS shipping FROM web_sales""",
    "p1_totals": f"""SELECT field_name, key_value, count(*) AS n_rows, count(amount) FILTER (WHERE NOT isnan(amount)) AS n_values,
        round(coalesce(sum(amount) FILTER (WHERE NOT isnan(amount)), 0), 2) AS total FROM ({_KEYS}) GROUP BY 1, 2""",
    "p1_found": f"""WITH t AS (SELECT field_name, key_value, count(*) AS n FROM ({_KEYS}) WHERE key_value IS NOT NULL GROUP BY 1, 2)
        SELECT field_name, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) AS s FROM t) WHERE n >= 0.03 * s""",
    "p3_found": f"""SELECT raw_id FROM raw_rows WHERE record_text IS NULL OR NOT CASE tab_name
        WHEN 'sales' THEN regexp_matches(record_text, '{_SALES_RE}', 's') WHEN 'customers' THEN regexp_matches(record_text, '{_CUST_RE}', 's') ELSE false END""",
    "p3_reasons": f"""WITH marked AS (SELECT raw_id, tab_name, record_text, {_broken("sales", 5)} AS s, {_broken("customers", 4)} AS c FROM raw_rows),
        told AS (SELECT raw_id, tab_name, CASE WHEN record_text IS NULL THEN {{'f': NULL, 'r': 'null_record'}} WHEN tab_name = 'sales' THEN s WHEN tab_name = 'customers' THEN c ELSE {{'f': NULL, 'r': 'unknown_table'}} END AS t FROM marked)
        SELECT raw_id, tab_name, t.f AS broken_field, t.r AS reason FROM told WHERE t.r IS NOT NULL""",
    "p3_sales": _typed_sql("sales", _SALES_RE, {"customer": 0, "region": 0, "product": 0, "amount": 1, "date": 0}, {"amount": "DOUBLE"}),
    "p3_customers": _typed_sql("customers", _CUST_RE, {"customer": 0, "email": 1, "tier": 0, "signup_date": 0}, {}),
    "p4_found": f"WITH {_ORPHANS} SELECT tab_name, row_id FROM orphans",
    "p4_report": f"""WITH {_ORPHANS}, kinds AS (SELECT tab_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_orphans,
            count(*) FILTER (WHERE EXISTS (SELECT 1 FROM par p WHERE p.k = o.k AND p.lo <= o.loaded_at AND (p.hi IS NULL OR p.hi > p.lo))) AS n_ended
            FROM orphans o GROUP BY 1, 2),
        every AS (SELECT tab_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_refs FROM refs WHERE k IS NOT NULL GROUP BY 1, 2)
        SELECT tab_name, month, n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_ended, 0) AS n_ended,
            coalesce(n_orphans, 0) - coalesce(n_ended, 0) AS n_never FROM every LEFT JOIN kinds USING (tab_name, month)""",
    "p4_integer": " UNION ALL ".join(
        f"SELECT '{t}' AS tab_name, CAST({k} AS BIGINT) AS key_value, count(*) AS n FROM {t} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL) GROUP BY 2" for t, k, p, pk in _INTEGER
    ),
    "p5_found": f"WITH {_SIZES} SELECT file_id FROM sized WHERE true_bytes < 2048",
    "p5_stored": f"""WITH dated AS (SELECT file_id, {_DAY} AS day FROM sales_files)
        SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n_lines, CAST(sum(strlen(coalesce(line_text, '')) + 1) AS BIGINT) AS n_bytes, CAST(sum(CAST(('0x' || substr(md5(coalesce(line_text, '')), 1, 8)) AS BIGINT)) AS BIGINT) AS line_sum
        FROM file_rows JOIN dated USING (file_id) GROUP BY 1""",
    "p5_dates": f"""WITH {_SIZES}, dated AS (SELECT *, CASE WHEN date IS NULL THEN NULL ELSE concat_ws('-', split_part(date, '-', 1),
            lpad(split_part(date, '-', 2), 2, '0'), lpad(split_part(date, '-', 3), 2, '0')) END AS day FROM sized)
        SELECT day, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(body) AS BIGINT) AS body_bytes FROM dated GROUP BY day""",
}
