"""Queries over the text and number problems of training data (p6 to p9), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_key
from millrace.llm import digests, mixing, mojibake, packing, tokens
from millrace.session import cut_lineage

#: Tokens a container holds.
CAPACITY = 8192
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "sales").select(clean_key("region").alias("region"), F.date_format("loaded_at", "yyyy-MM").alias("month"), "amount")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.digest(_amounts(spark, sf_dir), ["region", "month"], "amount")


def _certified(amounts: DataFrame, digest: DataFrame, keys: list[str]) -> DataFrame:
    return digests.certify(amounts, keys, "amount", digests.quantiles(digest, keys, PERCENTILES), PERCENTILES)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified percentiles of each region and month, and, with a null month, of each region over all months."""
    return digests.certify_both(_amounts(spark, sf_dir), ["region", "month"], "month", "amount", _monthly(spark, sf_dir), PERCENTILES)


def p6_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = digests.combine(_monthly(spark, sf_dir), ["region"])
    return _certified(_amounts(spark, sf_dir), combined, ["region"]).select("region", "percentile", "n", "within_bound")


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles, and whether the digests' estimates lie between the exact ones a bound below and above."""
    amounts = _amounts(spark, sf_dir)
    merged = cut_lineage(digests.combine(_monthly(spark, sf_dir), ["region"]))  # a row a region
    least = merged.agg(F.min("n")).first()[0] or 1
    got = digests.quantiles(merged, ["region"], PERCENTILES).select(F.col("region").alias("_r"), F.posexplode("estimates").alias("_i", "estimate"))
    marks = [(i, q, max(q - b, 0.0), min(q + b, 1.0)) for i, q in enumerate(PERCENTILES) for b in [digests.rank_bound(q, least)]]
    exact = cut_lineage(digests.exact_quantiles(amounts, ["region"], "amount", sorted({x for m in marks for x in m[1:]})))  # a row a region and quantile
    wide = got.join(F.broadcast(spark.createDataFrame(marks, "_i int, _q double, _lo double, _hi double")), "_i")
    for name, at in (("exact", "_q"), ("low", "_lo"), ("high", "_hi")):
        side = exact.select(F.col("region").alias("_e"), F.col("percentile").alias("_p"), F.col("value").alias(name), F.col("n").alias(f"n_{name}"))
        wide = wide.join(side, F.col("_r").eqNullSafe(F.col("_e")) & (F.col(at) == F.col("_p"))).drop("_e", "_p")
    within = F.col("estimate").between(F.col("low"), F.col("high"))
    return wide.select(F.col("_r").alias("region"), F.col("_q").alias("percentile"), F.col("n_exact").alias("n"), F.round("exact", 4).alias("exact"), within.alias("within_bound"))


def p6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select("region", "month", "n", "low", "high")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    sized = tokens.with_token_counts(documents, "text", ["doc_id"])
    return packing.pack_items(sized, "doc_id", "n_tokens", CAPACITY, n_items=documents.count())


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents placed, and how many containers, pieces or documents break a rule of the packing."""
    packed = cut_lineage(p7_containers(spark, sf_dir))
    per = packed.groupBy("container").agg(F.sum("n_units").alias("u"), F.max("container_units").alias("told"))
    bad = per.agg(F.sum(((F.col("u") > CAPACITY) | (F.col("u") != F.col("told"))).cast("long")).alias("n_bad_containers"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_units").alias("units"), F.max(F.col("first_unit") + F.col("n_units")).alias("end"))
    split = (F.col("pieces") > 1) & (F.col("units") <= CAPACITY)
    one = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(split.cast("long")).alias("n_wrongly_split"), F.sum((F.col("units") != F.col("end")).cast("long")).alias("n_with_gaps"))
    return one.join(F.broadcast(bad))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir), CAPACITY)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source with records: its feasible share, whether the labelled tokens come within 0.005 of it (and half of the longest document), uses beyond the cap, documents taken twice."""
    selection, shares = _mixed(spark, sf_dir)
    caps = _table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    over = selection.where(F.col("source").isNotNull()).join(F.broadcast(caps), "source", "left").groupBy("source").agg(
        F.sum((F.col("times") > F.coalesce("max_repeats", F.lit(0))).cast("long")).alias("n_over_cap"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_twice")
    )
    zero = F.lit(0).cast("long")
    weight = F.col("times") * F.col("n_tokens")
    longest = selection.agg((F.max("n_tokens") / F.sum(weight)).alias("longest"))  # one row
    near = F.abs(F.col("labelled_share") - F.col("feasible_share")) <= 0.005 + F.col("longest") / 2
    rows = shares.where("feasible_share > 0").join(over, "source", "left").join(F.broadcast(longest))
    return rows.select("source", F.round("feasible_share", 9).alias("feasible_share"), near.alias("near"), F.coalesce("n_over_cap", zero).alias("n_over_cap"), F.coalesce("n_twice", zero).alias("n_twice"))


def p8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how the classifier does on held-out labelled rows, beside always naming the largest source."""
    report = mixing.train(_table(spark, sf_dir, "documents"), "text", "source").report
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} double" for k in report))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_table(spark, sf_dir, "documents"), "doc_id", "text", restore=False).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is found, the documents that can be told by a sign alone: a replacement character, or a byte order mark that was read wrongly."""
    found = p9_found(spark, sf_dir)
    sign = F.col("text").contains("\ufffd") | F.col("text").startswith("ï»¿") | F.col("text").startswith("п»ї") | F.col("text").startswith("∩╗┐")
    return _table(spark, sf_dir, "documents").where(sign).join(found, "doc_id", "left_semi").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_percentiles": p6_percentiles,
    "p6_certified": p6_certified,
    "p6_exact": p6_exact,
    "p6_digests": p6_digests,
    "p7_containers": p7_containers,
    "p7_check": p7_check,
    "p7_fill": p7_fill,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_check": p8_check,
    "p8_classifier": p8_classifier,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
    "p9_signs": p9_signs,
}

_REGION = "nullif(lower(trim(regexp_replace(region, '[ \\t\\x{00A0}\\x{2007}\\x{202F}]+', ' ', 'g'))), '')"
_AMOUNTS = f"SELECT {_REGION} AS region, strftime(loaded_at, '%Y-%m') AS month, amount FROM sales WHERE amount IS NOT NULL AND NOT isnan(amount) AND NOT isinf(amount)"
SQL: dict[str, str] = {
    "p6_certified": f"""WITH a AS ({_AMOUNTS}), g AS (SELECT region, count(*) AS n FROM a GROUP BY region)
        SELECT region, CAST(p AS DOUBLE) AS percentile, n, true AS within_bound FROM g, (SELECT unnest([{", ".join(map(str, PERCENTILES))}]) AS p)""",
    "p6_digests": f"WITH a AS ({_AMOUNTS}) SELECT region, month, count(*) AS n, min(amount) AS low, max(amount) AS high FROM a GROUP BY region, month",
    "p6_exact": f"""WITH a AS ({_AMOUNTS}), g AS (SELECT region, count(*) AS n, quantile_cont(amount, [{", ".join(map(str, PERCENTILES))}]) AS e FROM a GROUP BY region)
        SELECT region, unnest([{", ".join(map(str, PERCENTILES))}])::DOUBLE AS percentile, n, round(unnest(e), 4) AS exact, true AS within_bound FROM g""",
    "p7_check": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_wrongly_split, CAST(0 AS BIGINT) AS n_with_gaps, CAST(0 AS BIGINT) AS n_bad_containers FROM documents",
    "p8_check": """WITH present AS (SELECT source, target_share / (SELECT sum(target_share) FROM mix_targets) AS t FROM mix_targets WHERE target_share > 0 AND max_repeats > 0
            AND source IN (SELECT source FROM documents WHERE text <> ''))
        SELECT source, round(t + (1 - (SELECT sum(t) FROM present)) / (SELECT count(*) FROM present), 9) AS feasible_share, true AS near, CAST(0 AS BIGINT) AS n_over_cap, CAST(0 AS BIGINT) AS n_twice FROM present""",
    "p9_signs": "SELECT doc_id FROM documents WHERE contains(text, chr(65533)) OR starts_with(text, 'ï»¿') OR starts_with(text, 'п»ї') OR starts_with(text, '∩╗┐')",
}
