"""One query or more for every operator of the pipeline engine, and the SQL each is checked against."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.operators.compaction import compact_paths
from millrace.operators.relational import as_of_join, filter_rows, group, join, limit, pivot, select, sort, top_k, union, unpivot
from millrace.plans.pipeline import PLUGINS, Pipeline
from millrace.plans.sql import run_sql
from millrace.session import fresh_dir
from millrace.sources.read import from_arrow, load, preview_schema
from millrace.sources.write import store
from millrace.streaming.windows import session_group, window_group

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def _add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _add_sql(name: str, query: str, table: str, oracle: str | None = None) -> None:
    """A query over the table ``stdin``; the oracle runs the same text over the table itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for other in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part", "events"):
            if other in query:
                spark.read.parquet(f"{sf_dir}/{other}.parquet").createOrReplaceTempView(other)
        return run_sql(spark, query, spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[name] = run
    SQL[name] = oracle or f"WITH stdin AS (SELECT * FROM {table}) SELECT * FROM ({query})"


# scans, projections, filters
_add("scan_parquet", lambda t: t("nation"), "SELECT * FROM nation")
_add("select_cols", lambda t: select(t("lineitem"), "l_orderkey, l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem")
for _name, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _add(f"filter_{_name}", lambda t, op=_op: select(filter_rows(t("lineitem"), f"l_quantity {op} 25"), "l_orderkey,l_linenumber,l_quantity"), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
_FILTERS = {
    "filter_text_eq": ("orders", "o_orderstatus = 'O'", "o_orderstatus = 'O'"),
    "filter_and": ("lineitem", "l_quantity > 40 AND l_returnflag = 'R'", "l_quantity > 40 AND l_returnflag = 'R'"),
    "filter_or": ("orders", "o_totalprice > 300000 OR o_orderstatus = 'P'", "o_totalprice > 300000 OR o_orderstatus = 'P'"),
    "filter_precedence": ("orders", "o_orderstatus = 'P' OR o_orderstatus = 'O' AND o_totalprice > 200000", "o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_totalprice > 200000)"),
    "filter_parens": ("orders", "(o_orderstatus = 'P' OR o_orderstatus = 'O') AND o_totalprice > 200000", "(o_orderstatus = 'P' OR o_orderstatus = 'O') AND o_totalprice > 200000"),
    "filter_date_literal": ("orders", "o_orderdate >= '1996-01-01' AND o_orderdate < '1996-04-01'", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'"),
    "filter_contains_wild": ("part", "p_name CONTAINS '*a*e*'", "regexp_full_match(p_name, '[^/]*a[^/]*e[^/]*')"),
    "filter_contains_scalar": ("nation", "n_regionkey CONTAINS 2", "n_regionkey = 2"),
    "filter_nested_path": ("events", "props.k > 50", "CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"),
    "filter_any_array": ("web_sales", "tags CONTAINS 'gift'", "list_contains(tags, 'gift')"),
    "filter_struct_path": ("web_sales", "metadata.discount >= 0.2", "metadata.discount >= 0.2"),
    "filter_is_null": ("web_sales", "metadata.shipping IS NULL AND customer IS NOT NULL", "metadata.shipping IS NULL AND customer IS NOT NULL"),
}
_IDS = {"lineitem": "l_orderkey, l_linenumber", "orders": "o_orderkey", "part": "p_partkey", "nation": "n_nationkey", "events": "event_id", "web_sales": "row_id"}
for _name, (_table, _text, _where) in _FILTERS.items():
    _add(_name, lambda t, table=_table, text=_text: select(filter_rows(t(table), text), _IDS[table]), f"SELECT {_IDS[_table]} FROM {_table} WHERE {_where}")
_add("filter_implicit_any", lambda t: select(filter_rows(t("embeddings"), "embedding > 0.35"), "vec_id"), "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0")
_add("filter_index", lambda t: select(filter_rows(t("embeddings"), "embedding[0] > 0"), "vec_id"), "SELECT vec_id FROM embeddings WHERE embedding[1] > 0")

# order
def _placed(df: DataFrame) -> DataFrame:
    """Sorted rows with their place: one partition, in the order of the ranges that were sorted."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


_add("sort_multi", lambda t: _placed(sort(t("nation"), "n_regionkey, n_name:desc")), "SELECT *, row_number() OVER (ORDER BY n_regionkey, n_name DESC) AS place FROM nation")
for _way, _nulls in (("asc", "FIRST"), ("desc", "LAST")):
    _add(
        f"sort_nulls_{_way}",
        lambda t, way=_way: _placed(sort(t("customers").select("tier", "cust_row"), f"tier:{way}, cust_row")),
        f"SELECT tier, cust_row, row_number() OVER (ORDER BY tier {_way} NULLS {_nulls}, cust_row) AS place FROM customers",
    )
_add("topk_values", lambda t: select(top_k(t("orders"), "o_totalprice:desc, o_orderkey", 50), "o_orderkey,o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
_add("limit_offset", lambda t: limit(sort(t("nation"), "n_nationkey"), 5, 10), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")

# groups
for _f, _call in (("sum", {"sum": "l_quantity"}), ("avg", {"avg": "l_quantity"}), ("min", {"min": "l_extendedprice"}), ("max", {"max": "l_extendedprice"}), ("count", {"count": "1"})):
    _column = {"sum": "l_quantity", "avg": "l_quantity", "min": "l_extendedprice", "max": "l_extendedprice", "count": "l_orderkey"}[_f]
    _add(f"group_{_f}", lambda t, call=_call: group(t("lineitem"), "l_returnflag", **call), f"SELECT l_returnflag, {_f}({_column if _f != 'count' else '*'}) AS {_column}_{_f} FROM lineitem GROUP BY 1")
_add("group_multi_key", lambda t: group(t("lineitem"), "l_returnflag,l_linestatus", sum="l_quantity", count="1"), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, count(*) AS l_orderkey_count FROM lineitem GROUP BY 1, 2")
_ALL = {f: "o_totalprice" for f in ("sum", "avg", "min", "max", "count")}
_add(
    "group_all_aggs",
    lambda t: group(t("orders"), "o_orderstatus", **_ALL).withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_avg": F.round("o_totalprice_avg", 4)}),
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_avg, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(*) AS o_totalprice_count FROM orders GROUP BY 1",
)
_add("group_global", lambda t: group(t("nation"), "", count="1", max="n_nationkey"), "SELECT count(*) AS n_nationkey_count, max(n_nationkey) AS n_nationkey_max FROM nation")

# joins: one side filtered, so that some rows have no match
_NATIONS = "n_nationkey < 15"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = select(filter_rows(t("supplier"), "s_nationkey > 5"), "s_suppkey,s_nationkey").withColumnRenamed("s_nationkey", "k")
    right = select(filter_rows(t("nation"), _NATIONS), "n_nationkey,n_name,n_regionkey").withColumnRenamed("n_nationkey", "k")
    return left, right


_LR = "l AS (SELECT s_suppkey, s_nationkey AS k FROM supplier WHERE s_nationkey > 5), r AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation WHERE n_nationkey < 15)"
for _how in ("inner", "left", "right", "full"):
    _add(f"join_{_how}", lambda t, how=_how: join(*_sides(t), "k", how), f"WITH {_LR} SELECT s_suppkey, k, n_name, n_regionkey FROM l {_how.upper()} JOIN r USING (k)")
_add("join_semi", lambda t: join(*_sides(t), "k", "semi"), f"WITH {_LR} SELECT * FROM l WHERE k IN (SELECT k FROM r)")
_add("join_anti", lambda t: join(*_sides(t), "k", "anti"), f"WITH {_LR} SELECT * FROM l WHERE k NOT IN (SELECT k FROM r)")
_add(
    "join_multi_key",
    lambda t: join(select(t("lineitem"), "l_orderkey,l_linenumber,l_quantity"), select(filter_rows(t("lineitem"), "l_quantity > 45"), "l_orderkey,l_linenumber,l_tax"), "l_orderkey,l_linenumber"),
    "SELECT l_orderkey, l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_quantity > 45) b USING (l_orderkey, l_linenumber)",
)
_add(
    "join_collision",
    lambda t: join(t("nation"), t("nation").select("n_regionkey", "n_name"), "n_regionkey"),
    "SELECT a.n_nationkey, a.n_name, n_regionkey, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_regionkey)",
)
_add(
    "join_one_to_many",
    lambda t: join(select(t("customer"), "c_custkey,c_name"), select(t("orders"), "o_custkey,o_orderkey").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"),
    "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders) USING (c_custkey)",
)
_add(
    "join_asof",
    lambda t: as_of_join(
        t("events").where("event_type = 'purchase'").select("user_id", "event_id", "ts"), t("events").where("event_type = 'click'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("click_id")), "user_id", "ts", "seen"
    ).select("event_id", "seen"),
    """WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS seen FROM events WHERE event_type = 'click')
       SELECT event_id, (SELECT max(seen) FROM c WHERE c.user_id = p.user_id AND c.seen <= p.ts) AS seen FROM p""",
)

# unions and reshaping
_add(
    "union_evolution",
    lambda t: union([t("nation").select("n_name", "n_regionkey"), t("region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("extra"))]),
    "SELECT n_name, n_regionkey, NULL AS extra FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region",
)
_add(
    "union_promotion",
    lambda t: union([t("nation").select(F.col("n_nationkey").alias("v")), t("supplier").select(F.col("s_acctbal").alias("v"))]),
    "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier",
)
_add(
    "pivot_basic",
    lambda t: pivot(group(t("orders"), "o_orderpriority,o_orderstatus", max="o_totalprice"), "o_orderpriority", "o_orderstatus", "o_totalprice_max", ["F", "O", "P"]),
    "SELECT o_orderpriority, " + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1",
)
_add(
    "pivot_multi_index",
    lambda t: pivot(group(t("lineitem"), "l_linenumber,l_linestatus,l_returnflag", count="1"), "l_linenumber,l_linestatus", "l_returnflag", "l_orderkey_count", ["A", "N", "R"]),
    "SELECT l_linenumber, l_linestatus, " + ", ".join(f"nullif(count(*) FILTER (WHERE l_returnflag = '{s}'), 0) AS \"{s}\"" for s in "ANR") + " FROM lineitem GROUP BY 1, 2",
)
_add(
    "pivot_missing",
    lambda t: pivot(t("nation"), "n_regionkey", "n_nationkey", "n_name"),
    "SELECT n_regionkey, " + ", ".join(f'max(n_name) FILTER (WHERE n_nationkey = {i}) AS "{i}"' for i in range(25)) + " FROM nation GROUP BY 1",
)
_add("unpivot_basic", lambda t: unpivot(t("supplier"), "s_suppkey", "s_acctbal,s_nationkey", "field", "value"), "SELECT s_suppkey, 's_acctbal' AS field, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier")
_add("unpivot_no_id", lambda t: unpivot(t("nation"), "", "n_nationkey,n_regionkey"), "SELECT 'n_nationkey' AS variable, n_nationkey AS value FROM nation UNION ALL SELECT 'n_regionkey', n_regionkey FROM nation")
_add("unpivot_mixed_types", lambda t: unpivot(t("nation"), "n_nationkey", "n_name,n_regionkey"), "SELECT n_nationkey, 'n_name' AS variable, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")

# profiles
_add(
    "describe_schema",
    lambda t: profile.describe(t("nation")).withColumn("column_type", F.replace("column_type", F.lit("bigint"), F.lit("int"))),
    "SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS position, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest(['int', 'string', 'int']) AS column_type",
)
_add(
    "null_stats",
    lambda t: profile.null_stats(t("sales").select("customer", "region", "amount", "date")).select("column_name", "n_rows", "n_nulls"),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM sales" for c in ("customer", "region", "amount", "date")),
)
_add(
    "histogram_numeric",
    lambda t: profile.histogram(t("lineitem"), "l_quantity").select("bin", "n"),
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) t(i) LEFT JOIN b ON bin = i""",
)
_add("top_values", lambda t: profile.top_values(t("sales"), "region", 5), "SELECT coalesce(region, 'NULL') AS value, count(*) AS n FROM sales GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
_add("distinct_count", lambda t: profile.distinct_count(t("sales"), "product"), "SELECT count(DISTINCT product) + max(CASE WHEN product IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM sales")
_add("preview", lambda t: profile.preview(sort(t("region"), "r_regionkey"), 3), "SELECT * FROM region ORDER BY r_regionkey LIMIT 3")


# formats: written, read again, compared with the source
def _round_trip(fmt: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        df = select(t("supplier"), "s_suppkey,s_name,s_nationkey,s_acctbal")
        path = fresh_dir(df.sparkSession, "round").removeprefix("file://") + f".{fmt}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        store(df, path)
        out = load(df.sparkSession, path, row_tag="record" if fmt == "xml" else None)
        return out.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"), F.col("s_acctbal").cast("double"))

    return run


for _fmt in ("csv", "tsv", "json", "jsonl", "xml", "parquet", "arrow"):
    _add(f"roundtrip_{_fmt}", _round_trip(_fmt), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def _glob(t: Tables) -> DataFrame:
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "glob").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    store(df.where("n_regionkey < 2").select("n_nationkey", "n_name"), f"{folder}/a.csv", single_file=True)
    store(df.where("n_regionkey >= 2").select("n_nationkey", "n_regionkey"), f"{folder}/b.csv", single_file=True)
    return load(df.sparkSession, f"{folder}/*.csv")


_add("load_glob", _glob, "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN n_name END AS n_name, CASE WHEN n_regionkey >= 2 THEN CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation")


def _partitioned(t: Tables) -> DataFrame:
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "parts").removeprefix("file://")
    for k in range(5):
        os.makedirs(f"{folder}/day={k}", exist_ok=True)
        store(df.where(f"n_regionkey = {k}").select("n_nationkey", "n_name"), f"{folder}/day={k}/x.csv", single_file=True)
    return load(df.sparkSession, folder)


_add("load_partitioned", _partitioned, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS day FROM nation")


def _nested(t: Tables) -> DataFrame:
    df = t("web_sales")
    path = fresh_dir(df.sparkSession, "nested").removeprefix("file://") + ".jsonl"
    store(df.select("row_id", "metadata", "tags"), path)
    return load(df.sparkSession, path).select("row_id", "`metadata.discount`", "`metadata.shipping`")


_add("flatten_json", _nested, 'SELECT row_id, metadata.discount AS "metadata.discount", metadata.shipping AS "metadata.shipping" FROM web_sales')


def _columnar_json(t: Tables) -> DataFrame:
    """One object of equally long arrays, of the 25 fixed nations."""
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "columns").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    rows = df.select("n_nationkey", "n_name").collect()
    with open(f"{folder}/n.json", "w") as f:
        json.dump({"n_nationkey": [r.n_nationkey for r in rows], "n_name": [r.n_name for r in rows]}, f)
    return load(df.sparkSession, f"{folder}/n.json")


_add("load_columnar_json", _columnar_json, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def _preview(t: Tables) -> DataFrame:
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "preview").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    store(df.select("n_nationkey", "n_name"), f"{folder}/a.csv", single_file=True)
    store(df.select("n_nationkey", "n_regionkey"), f"{folder}/b.csv", single_file=True)
    schema = preview_schema(df.sparkSession, f"{folder}/*.csv")
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column_name string, column_type string")


_add("load_schema_preview", _preview, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest(['bigint', 'string', 'bigint']) AS column_type")


def _stored_files(t: Tables) -> DataFrame:
    """Stored files, one a nation and region, joined byte by byte into few and read again."""
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "files")
    store(df.repartition(7, "n_nationkey").select("n_nationkey", "n_name"), f"{folder}/in", "csv")
    manifest = compact_paths(df.sparkSession, f"{folder}/in/*.csv", f"{folder}/out", header_lines=1)
    if manifest.where(~F.col("valid")).count():
        raise ValueError("a container doesn't hold what it was made of")
    return load(df.sparkSession, f"{folder}/out")


_add("compact_stored_files", _stored_files, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def _xml(t: Tables) -> DataFrame:
    df = t("nation")
    folder = fresh_dir(df.sparkSession, "xml").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    rows = [(r.n_nationkey, r.n_name) for r in df.select("n_nationkey", "n_name").collect()]  # the 25 fixed nations
    with open(f"{folder}/n.xml", "w") as f:
        f.write("<atlas>" + "".join(f'<nation id="{k}"><name>{n}</name></nation>' for k, n in rows) + "</atlas>")
    return load(df.sparkSession, f"{folder}/n.xml")


_add("flatten_xml", _xml, 'SELECT CAST(n_nationkey AS BIGINT) AS "nation.id", n_name AS "nation.name" FROM nation')
_add("arrow_input", lambda t: from_arrow(t("region").sparkSession, t("region").toArrow()), "SELECT * FROM region")


# SQL over stdin
_add_sql("sql_group_having", "SELECT o_orderstatus, count(*) AS n FROM stdin GROUP BY o_orderstatus HAVING n > 10", "orders")
_add_sql("sql_window_rank", "SELECT n_name, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM stdin", "nation")
_add_sql("sql_window_pct", "SELECT s_suppkey, round(100 * s_acctbal / sum(s_acctbal) OVER (), 6) AS pct FROM stdin", "supplier")
_add_sql("sql_window_frame", "SELECT s_suppkey, sum(s_suppkey) OVER (ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM stdin", "supplier", "SELECT s_suppkey, CAST(sum(s_suppkey) OVER (ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM supplier")
_add_sql("sql_window_lag", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM stdin", "orders")
_add_sql("sql_window_ntile", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q FROM stdin", "supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS q FROM supplier")
_add_sql("sql_cte_topn", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM stdin GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM t ORDER BY s DESC, o_custkey LIMIT 10", "orders")
_add_sql("sql_scalar_subquery", "SELECT s_suppkey FROM stdin WHERE s_acctbal > (SELECT avg(s_acctbal) FROM stdin)", "supplier")
_add_sql("sql_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM stdin a JOIN stdin b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
_add_sql("sql_case_segment", "SELECT CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS segment, count(*) AS n FROM stdin GROUP BY 1", "customer")
_add_sql("sql_count_distinct_stddev", "SELECT count(DISTINCT c_nationkey) AS n, round(stddev(c_acctbal), 4) AS s, round(variance(c_acctbal), 2) AS v FROM stdin", "customer")
_add_sql("sql_percentile_cont", "SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM stdin", "orders")
_add_sql("sql_list", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM stdin GROUP BY 1", "nation")
_add_sql("sql_strings", "SELECT upper(n_name) AS u, concat(n_name, '-', NULL) AS c, length(n_name) AS l FROM stdin", "nation", "SELECT upper(n_name) AS u, concat(n_name, '-', NULL) AS c, CAST(length(n_name) AS INTEGER) AS l FROM nation")
_add_sql("sql_date_trunc", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM stdin GROUP BY 1", "orders", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1")
_add_sql("sql_strftime", "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM stdin GROUP BY 1", "orders")
_add_sql("sql_date_diff", "SELECT o_orderkey, date_diff('month', TIMESTAMP '1992-01-15', o_orderdate) AS d FROM stdin", "orders")
_add_sql("sql_no_from", "SELECT 1 AS x, 7 // 2 AS y, 'a' || 'b' AS z", "region", "SELECT 1 AS x, CAST(7 // 2 AS BIGINT) AS y, 'a' || 'b' AS z")
_add_sql("sql_round_math", "SELECT p_partkey, round(p_retailprice * 1.1, 2) AS p, p_size % 7 AS r FROM stdin", "part")
_add_sql("sql_semi", "SELECT c_custkey FROM stdin WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer")
_add_sql("sql_anti", "SELECT c_custkey FROM stdin WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "customer")
_add_sql("sql_cross", "SELECT r_name, n_name FROM stdin CROSS JOIN nation", "region")
_add_sql("sql_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM stdin a JOIN region b ON a.n_nationkey < b.r_regionkey", "nation")
_add_sql("sql_lateral", "SELECT r_name, x.n FROM stdin, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x", "region")
_add_sql("sql_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM stdin", "customer")
_add_sql("sql_intersect", "SELECT n_regionkey AS k FROM stdin INTERSECT SELECT r_regionkey FROM region", "nation")
_add_sql("sql_except", "SELECT n_nationkey AS k FROM stdin EXCEPT SELECT r_regionkey FROM region", "nation")
_add_sql("sql_union_distinct", "SELECT n_regionkey AS k FROM stdin UNION SELECT r_regionkey FROM region", "nation")
_add_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM stdin GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_add_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM stdin GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_add_sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM stdin GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem")
_add_sql("sql_filter_clause", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS n FROM stdin", "orders")
_add_sql("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", "region")
_add_sql("sql_qualify", "SELECT o_custkey, o_orderkey FROM stdin QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "orders")
_add_sql("sql_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM stdin ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "orders")
_add_sql("sql_exclude", "SELECT * EXCLUDE (n_regionkey) FROM stdin", "nation")
_add_sql("sql_replace", "SELECT * REPLACE (upper(n_name) AS n_name) FROM stdin", "nation")
_add_sql("sql_arg_max", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS k FROM stdin GROUP BY 1", "orders")
_add_sql("sql_string_agg", "SELECT n_regionkey, length(string_agg(n_name, ',')) AS l FROM stdin GROUP BY 1", "nation", "SELECT n_regionkey, CAST(length(string_agg(n_name, ',')) AS INTEGER) AS l FROM nation GROUP BY 1")
_add_sql("sql_array_literal", "SELECT n_nationkey, list_contains([1, 2, 3], n_nationkey) AS c FROM stdin", "nation")
_add_sql("sql_json", "SELECT event_id, props ->> '$.k' AS k FROM stdin", "events")
_add_sql("sql_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM stdin GROUP BY ALL", "orders")
_add_sql("sql_division_by_zero", "SELECT n_nationkey, n_nationkey / n_regionkey AS q, n_nationkey % (n_regionkey - 1) AS r, sum(n_nationkey) OVER (PARTITION BY n_regionkey) / n_regionkey AS s FROM stdin", "nation",
         "SELECT n_nationkey, n_nationkey / nullif(n_regionkey, 0) AS q, n_nationkey % nullif(n_regionkey - 1, 0) AS r, sum(n_nationkey) OVER (PARTITION BY n_regionkey) / nullif(n_regionkey, 0) AS s FROM nation")
_add_sql("sql_try_cast", "SELECT s_suppkey, TRY_CAST(s_name AS INTEGER) AS n, CAST(s_nationkey AS VARCHAR) AS k FROM stdin", "supplier")
_add_sql("sql_approx_distinct", "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.2 * count(DISTINCT o_custkey) AS near FROM stdin", "orders")
_add_sql("sql_mode", "SELECT o_orderstatus IS NOT NULL AS k, mode(o_orderkey % 2 = 5) AS m FROM stdin GROUP BY 1", "orders")
_add_sql("sql_approx_quantile", "SELECT abs(approx_quantile(o_totalprice, 0.5) - median(o_totalprice)) <= 0.05 * median(o_totalprice) AS near FROM stdin", "orders")
_add_sql("sql_ignore_nulls", "SELECT n_nationkey, last_value(nullif(n_regionkey, 3) IGNORE NULLS) OVER (ORDER BY n_nationkey) AS v FROM stdin", "nation")
_add_sql("sql_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM stdin", "orders")
_add_sql("sql_named_window", "SELECT n_nationkey, sum(n_nationkey) OVER w AS s, count(*) OVER w AS n FROM stdin WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)", "nation", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
_add_sql("sql_full_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM stdin WHERE n_nationkey < 15) FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM stdin WHERE n_nationkey > 5) USING (k)", "nation",
         "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) l FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey > 5) r USING (k)")
_add_sql("sql_union_by_name", "WITH r AS (SELECT r_regionkey AS k, r_name AS name FROM region) SELECT n_nationkey AS k, n_name || ' UNION BY NAME ' AS name FROM stdin UNION ALL BY NAME SELECT name, k, 1 AS extra FROM r ORDER BY k, name LIMIT 12", "nation")
_add_sql("sql_sample", "SELECT count(*) BETWEEN 0 AND 25 AS fits FROM (SELECT * FROM stdin USING SAMPLE 50 PERCENT)", "nation")
_add_sql("sql_struct_literal", "SELECT n_nationkey, {'name': n_name, 'region': n_regionkey}.name AS name, struct_extract(row_, 'region') AS r FROM (SELECT *, {'region': n_regionkey} AS row_ FROM stdin)", "nation",
         "SELECT n_nationkey, n_name AS name, n_regionkey AS r FROM nation")
_add_sql("sql_unpivot_statement", "UNPIVOT (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM stdin) ON s_acctbal, s_nationkey INTO NAME field VALUE amount", "supplier",
         "SELECT s_suppkey, 's_acctbal' AS field, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier")
_add_sql("sql_pivot_statement", "PIVOT stdin ON o_orderstatus USING max(o_totalprice) GROUP BY o_orderpriority", "orders",
         "SELECT o_orderpriority, " + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
_add_sql("sql_asof", "SELECT p.event_id, c.seen FROM (SELECT user_id, event_id, ts FROM stdin WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts AS seen FROM stdin WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.seen", "events",
         "SELECT event_id, (SELECT max(c.ts) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts) AS seen FROM events p WHERE event_type = 'purchase'")
_add_sql("sql_summarize", "SUMMARIZE stdin", "customer", None)
QUERIES["sql_summarize"] = lambda spark, sf_dir: run_sql(spark, "SUMMARIZE stdin", spark.read.parquet(f"{sf_dir}/customer.parquet")).select("column_name", "min", "max", F.round("avg", 4).alias("avg"), "count", "null_percentage")
SQL["sql_summarize"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, {f'round(avg({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS avg, count(*) AS count, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage FROM customer"
    for c, n in (("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False))
)
_add_sql("sql_nulls_last", "SELECT k FROM (SELECT nullif(n_regionkey, 0) AS k, n_nationkey FROM stdin) ORDER BY k, n_nationkey LIMIT 12", "nation")
_add_sql("sql_generate_series", "SELECT generate_series AS i FROM generate_series(1, 10)", "region", "SELECT CAST(generate_series AS INTEGER) AS i FROM generate_series(1, 10)")
_add_sql("sql_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM stdin) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "orders",
         "SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) AS {s.lower()}" for s in "FOP") + " FROM orders GROUP BY 1")


# pipelines, plugins, event-time windows
def _flagship(t: Tables) -> DataFrame:
    orders = filter_rows(t("orders"), "o_totalprice > 1000 AND o_orderdate >= '1993-01-01'").withColumnRenamed("o_custkey", "c_custkey")
    lines = filter_rows(t("lineitem"), "l_returnflag = 'R'").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumnRenamed("l_orderkey", "o_orderkey")
    rich = join(join(lines, orders, "o_orderkey"), select(t("customer"), "c_custkey,c_nationkey").withColumnRenamed("c_nationkey", "n_nationkey"), "c_custkey")
    named = join(rich, select(t("nation"), "n_nationkey,n_name"), "n_nationkey")
    return sort(group(named, "n_name", sum="revenue", count="revenue").withColumn("revenue_sum", F.round("revenue_sum", 4)), "revenue_sum:desc")


_add(
    "pipeline_flagship",
    _flagship,
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue_sum, count(*) AS revenue_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY n_name""",
)
_add(
    "pipeline_plugin",
    lambda t: PLUGINS["high-value"].run(t("orders"), "o_custkey", "o_totalprice", "2000000").withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2)),
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum, count(*) AS o_orderkey_count FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000",
)
_add("plugin_inventory", lambda t: PLUGINS["inventory"].run(t("region")), "SELECT * FROM (VALUES ('laptop', 15, 999.99::DOUBLE), ('mouse', 120, 25.5), ('keyboard', 85, 75.0), ('monitor', 42, 350.0), ('headset', 60, 89.99)) v(item, quantity, price)")


def _ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer value by segment, as one stored pipeline: load, group, SQL."""
    steps = Pipeline().then("load", source=f"{sf_dir}/orders.parquet").then("filter", text="o_totalprice > 0").then("group", keys="o_custkey", sum="o_totalprice", count="1")
    steps = steps.then("sql", query="SELECT CASE WHEN o_totalprice_sum > 1500000 THEN 'top' ELSE 'other' END AS segment, count(*) AS n, CAST(sum(o_orderkey_count) AS BIGINT) AS orders FROM stdin GROUP BY 1")
    return Pipeline.from_json(steps.to_json()).build(spark)


QUERIES["pipeline_ltv"] = _ltv
SQL["pipeline_ltv"] = "SELECT CASE WHEN s > 1500000 THEN 'top' ELSE 'other' END AS segment, count(*) AS n, CAST(sum(c) AS BIGINT) AS orders FROM (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS c FROM orders WHERE o_totalprice > 0 GROUP BY 1) GROUP BY 1"
_add(
    "window_tumbling",
    lambda t: window_group(t("events"), "ts", "1 day", [F.count(F.lit(1)).alias("n")], ["event_type"]).select("window_start", "event_type", "n"),
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
_add(
    "window_session",
    lambda t: session_group(t("events"), "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ["user_id"]).select("user_id", "session_start", "n"),
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
