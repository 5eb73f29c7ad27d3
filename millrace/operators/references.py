"""References to records that don't exist at the time they are made.

A parent key (two hashes) and an instant are integers; the stays of a key are compressed into
contiguous runs of instants, a reference is matched as of its instant to the preceding run start of
its key, and is an orphan where there is none or it lies at or beyond the run's end.

A few keys may hold most references.  Which ones they are is told by a frequent-items sketch in one
pass without a shuffle; their runs, at most HOT keys', are sent to where the references are, and
what refers to them is decided there.  All other keys hold less than a SKETCH-th of the references
each: only these are shuffled, narrow, for an equi-join with a row a key.

Keys that are integers themselves are compressed into runs of contiguous keys instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import qcol

FOREVER = 2**63 - 1
KEY = ["_k1", "_k2"]
#: Keys whose references are decided without a shuffle, and items that the sketch which finds them keeps.
HOT, SKETCH = 1_000, 16_384
#: Stays of one key are merged in slices of time of 2**40 microseconds (13 days) first.
_SLICE = 40
#: Integer keys are matched in buckets of 2**16.
_BUCKET = 16


def _instant(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def _hash(key: Column) -> list[Column]:
    """96 bits of the key."""
    return [F.xxhash64(key).alias("_k1"), F.hash(F.lit(1), key).alias("_k2")]


def _merged(stays: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stays of equal ``by`` made disjoint: touching and overlapping ones become one."""
    order = Window.partitionBy(*by).orderBy("_at", F.desc("_end"))
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = stays.withColumn("_new", F.when(F.col("_at") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_run").agg(F.min("_at").alias("_at"), F.max("_end").alias("_end")).drop("_run")


def parent_runs(stays: DataFrame) -> DataFrame:
    """Stays ``_k1, _k2, _at, _end`` compressed into disjoint runs.

    A key's stays are merged by slices of time first, so that a key with very many of them doesn't
    meet in one task before it is compressed.
    """
    sliced = stays.select(*KEY, "_at", "_end", F.shiftright("_at", _SLICE).alias("_slice"))
    return _merged(_merged(sliced, [*KEY, "_slice"]).drop("_slice"), KEY)


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, at: str, parent_key: str, start: str, end: str | None = None, hot: int = HOT) -> DataFrame:
    """The rows of ``refs`` whose key no parent has at the row's time, with ``orphan_kind``.

    A parent row is there from ``start`` until just before ``end`` (null: for good).  orphan_kind is
    ``after_run_end`` where an earlier run has ended and ``no_run_before`` where none has begun.
    Keys are compared as given (clean them before).  Rows of refs with a null key refer to nothing
    and aren't reported; rows with a null time are, as ``no_run_before``.  Parents with a null key
    or start, or that end by their start, are never there.  Repeated rows are all reported.  All
    columns of ``refs`` come through; their names must not begin with an underscore.  The separate
    runs of one key make one row (16 bytes each).  ``hot`` changes what is shuffled, not the result.
    """
    if any(c.startswith("_") for c in refs.columns):
        raise ValueError("column names that begin with an underscore are reserved")
    moments = refs.select("*", *_hash(F.col(key)), _instant(F.col(at)).alias("_t"))
    last = F.lit(FOREVER) if end is None else F.coalesce(_instant(F.col(end)), F.lit(FOREVER))
    stays = (
        parents.where(F.col(parent_key).isNotNull() & F.col(start).isNotNull())
        .select(*_hash(F.col(parent_key)), _instant(F.col(start)).alias("_at"), last.alias("_end"))
        .where(F.col("_end") > F.col("_at"))
    )
    runs = parent_runs(stays).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_at", "_end"))).alias("_runs"))
    often = refs.agg(F.expr(f"approx_top_k(`{key}`, {hot}, {max(SKETCH, hot)})").alias("_top"))
    keys = often.select(F.explode("_top").alias("_i")).select(*_hash(F.col("_i.item"))).distinct()  # at most ``hot`` rows
    known = F.broadcast(keys.join(runs, KEY, "left").select(*KEY, F.col("_runs").alias("_hot"), F.lit(True).alias("_is_hot")))
    # null keys are let go here, not by a filter of their own: the planner would work out a computed key once more for that
    first = moments.join(known, KEY, "left").withColumn("_kind", F.when(F.col(key).isNull(), "").when(F.col("_is_hot"), _judged("_hot")))
    # what is decided and sound goes no further; decided orphans are spread, they match nothing
    left = first.where(F.col("_kind").isNull() | (F.col("_kind") != "")).drop("_hot", "_is_hot")
    spread = {"_k1": F.when(F.col("_kind").isNull(), F.col("_k1")).otherwise(F.monotonically_increasing_id()), "_k2": F.when(F.col("_kind").isNull(), F.col("_k2"))}
    # the join adaptive execution may split: an equi-join whose right side has a row a key
    matched = left.withColumns(spread).join(runs, KEY, "left").withColumn("_kind", F.coalesce("_kind", _judged("_runs")))
    return matched.where(F.col("_kind") != "").select(*refs.columns, F.col("_kind").alias("orphan_kind"))


def _judged(runs: str) -> Column:
    """The kind of orphan that a row is by its key's runs, "" for none."""
    before = F.filter(runs, lambda r: r["_at"] <= F.col("_t"))
    until = F.element_at(before, -1)["_end"]
    none = F.col(runs).isNull() | F.col("_t").isNull() | (F.col("_t") < F.element_at(runs, 1)["_at"])
    return F.when(none, "no_run_before").when(until <= F.col("_t"), "after_run_end").otherwise("")


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """``_bucket, _runs``: sorted integer keys compressed into runs of contiguous ones (first and last key), by buckets of 65,536 keys.

    However many parents there are, a bucket has at most 32,768 runs; keys without gaps make one.
    """
    number = qcol(key).cast("long").alias("_k")
    keys = parents.where(qcol(key).isNotNull()).select(number).distinct().withColumn("_bucket", F.shiftright("_k", _BUCKET))
    # within a run of contiguous keys, key and place rise alike
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_k"))
    runs = keys.withColumn("_run", F.col("_k") - place).groupBy("_bucket", "_run").agg(F.min("_k").alias("first"), F.max("_k").alias("last"))
    return runs.groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))


def integer_orphans(refs: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The rows of ``refs`` whose integer key isn't among the parents'.

    A key is matched to the preceding run start of its bucket and is an orphan beyond that run's end.
    A null key refers to nothing; repeated rows are all reported; all columns of ``refs`` come through.
    The right side has a row for 65,536 keys: the planner broadcasts it where it is small, and may
    split a bucket with very many references where it isn't.
    """
    if any(c.startswith("_") for c in refs.columns):
        raise ValueError("column names that begin with an underscore are reserved")
    rows = refs.where(qcol(key).isNotNull()).withColumn("_k", qcol(key).cast("long")).withColumn("_bucket", F.shiftright("_k", _BUCKET))
    before = F.filter("_runs", lambda r: r["first"] <= F.col("_k"))
    beyond = F.col("_runs").isNull() | (F.size(before) == 0) | (F.element_at(before, -1)["last"] < F.col("_k"))
    return rows.join(key_runs(parents, parent_key), "_bucket", "left").where(beyond).select(*[qcol(c) for c in refs.columns])


def orphan_report(refs: DataFrame, orphans: DataFrame, table: str, at: str) -> DataFrame:
    """Orphans per table and month of ``at``: ``table, month, n_refs, n_orphans, n_ended, n_never``; months without orphans stay in."""
    month = F.date_format(F.col(at), "yyyy-MM").alias("month")
    every = refs.groupBy(F.col(table), month).agg(F.count(F.lit(1)).alias("n_refs"))
    ended = F.sum((F.col("orphan_kind") == "after_run_end").cast("long"))
    bad = orphans.groupBy(F.col(table).alias("_t"), month.alias("_m")).agg(F.count(F.lit(1)).alias("n_orphans"), ended.alias("n_ended"))
    on = F.col(table).eqNullSafe(F.col("_t")) & F.col("month").eqNullSafe(F.col("_m"))
    zero = F.lit(0).cast("long")
    joined = every.join(bad, on, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_orphans", "n_ended")})
    return joined.select(table, "month", "n_refs", "n_orphans", "n_ended", (F.col("n_orphans") - F.col("n_ended")).alias("n_never"))
