"""Time slices of hot keys: so that no key's rows, however many, meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOREVER = 2**63 - 1
KEY = ["_k1", "_k2", "_slice"]
#: No key, and no slice of a key, holds more than so great a part of all rows: there can be no more hot keys and slices than that.
PARTS = 2000


def find_hot(moments: DataFrame, hot_rows: int) -> list[tuple[int, int, list[int]]]:
    """Of ``_k1, _k2, _at``: the keys with more than ``hot_rows`` rows and a PARTS-th of all, each with its slices' starts.

    Slices hold about equally many rows, that many at most: their starts are quantiles of the key's
    instants.  What is sent to the driver are at most PARTS keys with PARTS instants each.
    """
    counts = moments.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    limit = max(hot_rows, total // PARTS)
    found = counts.where(F.col("n") > limit).collect()
    if not found:
        return []
    keys = moments.sparkSession.createDataFrame([(r._k1, r._k2) for r in found], "_k1 long, _k2 long")
    steps = [i / PARTS for i in range(1, PARTS)]
    cuts = moments.join(F.broadcast(keys), ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.percentile_approx("_at", steps, 10 * PARTS).alias("cuts")).collect()
    n_rows = {(r._k1, r._k2): r.n for r in found}
    out = []
    for r in cuts:
        slices = min(PARTS, -(-n_rows[r._k1, r._k2] // limit))
        starts = sorted({r.cuts[i * (PARTS - 1) // slices] for i in range(1, slices)}) if r.cuts else []
        out.append((r._k1, r._k2, [-FOREVER - 1, *starts]))
    return out


def hot_frame(spark: SparkSession, found: list[tuple[int, int, list[int]]]) -> DataFrame | None:
    return spark.createDataFrame(found, "_k1 long, _k2 long, starts array<long>") if found else None


def sliced(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds ``_slice``, the slice a row lies in: 0 for all rows of a key that isn't hot."""
    if hot is None:
        return df.withColumn("_slice", F.lit(0))
    starts = F.broadcast(hot.select("_k1", "_k2", "starts"))
    at = F.coalesce(F.col("_at"), F.lit(FOREVER))
    place = F.size(F.filter("starts", lambda x: x <= at)) - 1
    return df.join(starts, ["_k1", "_k2"], "left").withColumn("_slice", F.when(F.col("starts").isNull(), 0).otherwise(place)).drop("starts")
