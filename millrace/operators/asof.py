"""Each row with the latest row of another table that isn't after it, also where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import qcol
from millrace.operators.slices import KEY, find_hot, hot_frame, sliced

_INSTANTS = (T.DateType, T.TimestampType, T.TimestampNTZType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _order(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("long")


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Each left row with the latest right row of equal keys that isn't after it (nulls where there is none).

    The two sides are laid together and the last right row is carried forward, so nothing is
    multiplied: one shuffle on the keys, whatever the number of matches.  Keys with more than
    ``hot_rows`` rows are cut into slices of time, each begun with the right row that is the last
    before it.  Of right rows of one time the greatest counts; null keys and null times match
    nothing; every left row comes out once.  Times are dates, timestamps or whole numbers.
    """
    for df, at in ((left, left_at), (right, right_at)):
        if not isinstance(df.schema[at].dataType, _INSTANTS):
            raise ValueError(f"{at!r} must be a date, a timestamp or a whole number")
    rest = [c for c in right.columns if c not in on]
    names = [c if c not in left.columns else f"{c}_right" for c in rest]
    if len(set(names) | set(left.columns)) < len(names) + len(left.columns):
        raise ValueError("column names clash even with the suffix _right: rename them first")
    keys = [F.xxhash64(*[qcol(k) for k in on]).alias("_k1"), F.xxhash64(F.lit(1), *[qcol(k) for k in on]).alias("_k2")]
    none = reduce(lambda a, b: a | b, [qcol(k).isNull() for k in on])
    side_l = left.select(*keys, _order(qcol(left_at), left.schema[left_at].dataType).alias("_at"), F.lit(1).alias("_side"), F.struct(*[qcol(c) for c in left.columns]).alias("_l"), none.alias("_none"))
    row = F.struct(*[qcol(c).alias(n) for c, n in zip(rest, names, strict=True)])
    usable = right.where(~none & qcol(right_at).isNotNull())
    side_r = usable.select(*keys, _order(qcol(right_at), right.schema[right_at].dataType).alias("_at"), F.lit(0).alias("_side"), row.alias("_r"))
    found = find_hot(side_l.where(~F.col("_none")).select("_k1", "_k2", "_at").unionByName(side_r.select("_k1", "_k2", "_at")), hot_rows)
    hot = hot_frame(left.sparkSession, found)
    cut_l = sliced(side_l, hot)
    # rows without a key match nothing: they are spread instead of meeting in one task
    cut_l = cut_l.withColumn("_k1", F.when(F.col("_none"), F.monotonically_increasing_id()).otherwise(F.col("_k1"))).withColumn("_at", F.when(~F.col("_none"), F.col("_at")))
    cut_r = sliced(side_r, hot)
    if hot is not None:
        lasts = cut_r.join(F.broadcast(hot.select("_k1", "_k2")), ["_k1", "_k2"], "left_semi").groupBy(*KEY).agg(F.max_by("_r", F.struct("_at", "_r")).alias("_r"))
        slices = hot.select("_k1", "_k2", F.posexplode("starts").alias("_slice", "_at"))
        before = Window.partitionBy("_k1", "_k2").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        opened = slices.join(lasts, KEY, "left").withColumn("_r", F.last("_r", ignorenulls=True).over(before))
        cut_r = cut_r.unionByName(opened.where(F.col("_r").isNotNull()).withColumn("_side", F.lit(-1)).select(*cut_r.columns))
    order = Window.partitionBy(*KEY).orderBy(F.col("_at").asc_nulls_first(), "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cut_l.drop("_none").unionByName(cut_r, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*[F.col("_l").getField(c).alias(c) for c in left.columns], *[F.col("_m").getField(n).alias(n) for n in names])
