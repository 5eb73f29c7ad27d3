"""What a table looks like: schema, nulls, histograms, frequent values, a preview."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import qcol


def describe(df: DataFrame) -> DataFrame:
    """``position, column_name, column_type`` for each column; reads no data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def null_stats(df: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_nulls, null_share`` for each column, in one pass."""
    counts = [F.sum(qcol(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    zero = F.lit(0).cast("long")
    items = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.coalesce(F.col(f"n{i}"), zero).alias("n_nulls")) for i, c in enumerate(df.columns)]
    rows = one.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    return rows.withColumn("null_share", F.when(F.col("n_rows") > 0, F.col("n_nulls") / F.col("n_rows")).otherwise(F.lit(0.0)))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max and avg of the column's values; nulls and NaN are left out."""
    v = qcol(column).cast("double")
    usable = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return usable.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin, low, high, n``: equal-width bins, the last one closed, at most as many as values; empty bins have n = 0.

    All values equal: bin 0 holds them.  Null and NaN values are left out; without any, no rows.
    """
    s = numeric_summary(df, column).first()
    spark = df.sparkSession
    kind = "bin int, low double, high double, n bigint"
    if not s.n:
        return spark.createDataFrame([], kind)
    bins = max(1, min(bins, s.n))
    width = (s.high - s.low) / bins
    v = qcol(column).cast("double")
    place = F.least(F.floor((v - F.lit(s.low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.createDataFrame([(i, s.low + i * width, s.high if i == bins - 1 else s.low + (i + 1) * width) for i in range(bins)], "bin int, low double, high double")
    return edges.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """``value, n``: the ``k`` most frequent values as text, null as ``NULL``; ties go by the value."""
    value = F.coalesce(qcol(column).cast("string"), F.lit("NULL")).alias("value")
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of different values, null counted as one."""
    return df.agg((F.count_distinct(qcol(column)) + F.max(F.when(qcol(column).isNull(), 1).otherwise(0))).alias("n_distinct"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows."""
    return df.limit(n)


def cell_text(value: object, width: int = 50) -> str:
    """A cell as shown in a grid: NULL for null, two decimals for fractions, long text cut with three points."""
    if value is None:
        return "NULL"
    text = f"{value:.2f}" if isinstance(value, float) and math.isfinite(value) else str(value)
    return text if len(text) <= width else text[: width - 3] + "..."


def bars(labels: list[str], counts: list[int], width: int = 50) -> str:
    """A bar a line, the longest ``width`` signs wide, labels cut at 30."""
    most = max(counts, default=0)
    return "\n".join(f"{cell_text(label, 30):<30} {'█' * (math.ceil(n / most * width) if most else 0)} {n}" for label, n in zip(labels, counts, strict=True))


def render(df: DataFrame, n: int = 20) -> str:
    """The first ``n`` rows as a grid of text."""
    rows = [[cell_text(v) for v in r] for r in df.limit(n).collect()]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    lines = [" | ".join(f"{v:<{w}}" for v, w in zip(line, widths, strict=True)).rstrip() for line in [df.columns, *rows]]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])
