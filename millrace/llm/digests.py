"""Percentiles of very large numeric columns from digests that can be kept and combined.

A digest holds sorted clusters of values, each a mean and a weight.  A size function of the quantile
keeps clusters small at both ends; digests are merged by pooling their clusters in order and
clustering them anew.  A second pass counts, for every estimate, the values below and up to it,
which turns the stated bound on the rank error into a certificate; an estimate that isn't within its
bound is not given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: A digest has at most COMPRESSION / 2 + 2 clusters.
COMPRESSION = 400
#: Merging of more partial digests than this a group goes in two steps.
FAN_IN = 256
#: Groups whose estimates may be broadcast for the counting pass (a few hundred bytes each); beyond that rows are joined, each group in SALTS parts.
BROADCAST_GROUPS = 20_000
SALTS = 64
#: Values a worker keeps of one group and of all, and digests (6 kB each), before it clusters or hands on what it has.
_BUFFER, _BUFFER_ALL, _DIGESTS = 1 << 16, 1 << 22, 2_000
_DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"


def cluster(means: np.ndarray, weights: np.ndarray, compression: float = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Sorted clusters under the size function k(q) = c / 2pi * asin(2q - 1): one cluster for each unit of k."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    unit = np.floor(compression / (2 * np.pi) * (np.arcsin(2 * middle - 1) + np.pi / 2)).astype(np.int64)
    starts = np.flatnonzero(np.diff(unit, prepend=-1))
    joined = np.add.reduceat(weights, starts)
    return np.add.reduceat(means * weights, starts) / joined, joined


def estimate(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at quantile ``q``, between the midpoints of neighbouring clusters."""
    if q <= 0:
        return low
    if q >= 1:
        return high
    total = weights.sum()
    at = np.concatenate([[0.0], np.cumsum(weights) - weights / 2, [total]])
    value = np.concatenate([[low], means, [high]])
    return float(np.interp(q * total, at, value))


def rank_bound(q: float, n: int, compression: float = COMPRESSION) -> float:
    """The stated bound on the rank error, as a share of the values: a cluster's width at ``q``, and two values."""
    return 2 * math.pi * math.sqrt(max(q * (1 - q), 1.0 / max(n, 1) * 0.25)) / compression + 2.0 / max(n, 1)


def _partial(n_keys: int, compression: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: dict[tuple, list[np.ndarray]] = {}
        held: dict[tuple, int] = {}
        done: dict[tuple, list] = {}

        def compress(key: tuple) -> None:
            values = np.concatenate(raw.pop(key))
            held.pop(key)
            low, high = float(values.min()), float(values.max())
            means, weights = values, np.ones(len(values))
            if key in done:
                n, lo, hi, m, w = done[key]
                low, high = min(low, lo), max(high, hi)
                means, weights = np.concatenate([m, means]), np.concatenate([w, weights])
            means, weights = cluster(means, weights, compression)
            done[key] = [int(round(weights.sum())), low, high, means, weights]

        def rows() -> Iterator[pa.RecordBatch]:
            for key, (n, low, high, means, weights) in done.items():
                columns = [pa.array([k], pa.string()) for k in key] + [pa.array([part_id], pa.int32()), pa.array([n]), pa.array([low]), pa.array([high])]
                columns += [pa.array([means], pa.list_(pa.float64())), pa.array([weights], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"k{i}" for i in range(n_keys)] + ["_part", "n", "low", "high", "means", "weights"])
            done.clear()

        part_id = TaskContext.get().partitionId()
        for batch in batches:
            pdf = batch.to_pandas()
            keys = list(pdf.columns[:n_keys])
            for key, part in pdf.groupby(keys, sort=False, dropna=False)[pdf.columns[n_keys]]:
                key = tuple(None if x is None or x != x else x for x in key)
                raw.setdefault(key, []).append(part.to_numpy(np.float64))
                held[key] = held.get(key, 0) + len(part)
                if held[key] >= _BUFFER:
                    compress(key)
            if len(raw) > _DIGESTS or sum(held.values()) > _BUFFER_ALL:
                for key in list(raw):
                    compress(key)
                    if len(done) > _DIGESTS:
                        yield from rows()
            if len(done) > _DIGESTS:
                yield from rows()
        for key in list(raw):
            compress(key)
        yield from rows()

    return run


def _merger(keys: Sequence[str], compression: float):
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        means, weights = cluster(np.concatenate(list(pdf["means"])), np.concatenate(list(pdf["weights"])), compression)
        row = [*key, int(pdf["n"].sum()), float(pdf["low"].min()), float(pdf["high"].max()), means, weights]
        return pd.DataFrame([row], columns=[*keys, "n", "low", "high", "means", "weights"])

    return merge


def combine(digests: DataFrame, keys: Sequence[str], compression: float = COMPRESSION) -> DataFrame:
    """Digests merged to one for each value of ``keys``: of months to years, of splits to groups, in any order."""
    kind = ", ".join(f"`{k}` string" for k in keys) + ", " + _DIGEST
    return digests.groupBy(*keys).applyInPandas(_merger(keys, compression), kind)


def _splits(df: DataFrame) -> int:
    """About how many tasks read ``df``, from the planner's estimate of its bytes; nothing is run."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(1, size // split)


def digest(df: DataFrame, keys: Sequence[str], value: str, compression: float = COMPRESSION) -> DataFrame:
    """One digest for each group: ``keys..., n, low, high, means, weights``.

    Null and NaN values are left out, infinite ones too; a group without usable values gives no row.
    Keys are compared as text, a null key is a group.  Values are clustered within input splits, so
    only clusters move, however large a group is; with many splits they are merged in two steps.
    """
    usable = F.col(value).cast("double")
    finite = df.where(usable.isNotNull() & ~F.isnan(usable) & (F.abs(usable) != float("inf")))
    columns = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    kind = ", ".join(f"{k} string" for k in names) + ", _part int, " + _DIGEST
    partial = finite.select(*columns, usable.alias("v")).mapInArrow(_partial(len(keys), compression), kind)
    splits = _splits(df)
    if splits > FAN_IN:
        step = partial.withColumn("_part", (F.col("_part") % math.isqrt(splits)).cast("string"))
        partial = combine(step, [*names, "_part"], compression)
    merged = combine(partial, names, compression)
    return merged.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def quantiles(digests: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """``keys..., n, estimates``: for each digest the values at the quantiles ``at``."""
    kind = ", ".join(f"`{k}` string" for k in keys) + ", n bigint, estimates array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[[*keys, "n"]].copy()
            out["estimates"] = [[estimate(r.means, r.weights, r.low, r.high, q) for q in at] for r in pdf.itertuples()]
            yield out

    return digests.select(*keys, "n", "low", "high", "means", "weights").mapInPandas(run, kind)


def _finite(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``k0, k1, ..., v``: the usable values."""
    usable = F.col(value).cast("double")
    finite = df.where(usable.isNotNull() & ~F.isnan(usable) & (F.abs(usable) != float("inf")))
    return finite.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], usable.alias("v"))


def _counted(rows: DataFrame, points: DataFrame, keys: list[str], sets: Sequence[str], n_at: int) -> DataFrame:
    """Rows per group, and for each set of estimates in ``points`` the values below and up to each."""
    named = points.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    if points.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(named), cond)
    else:
        salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, cond & (F.col("_s") == F.col("_salt")))
    counts = []
    for s in sets:
        for i in range(n_at):
            e = F.element_at(s, i + 1)
            counts += [F.sum((F.col("v") < e).cast("long")).alias(f"{s}_b{i}"), F.sum((F.col("v") <= e).cast("long")).alias(f"{s}_u{i}")]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(s).alias(s) for s in sets], *counts)


def _rows_of(counted: DataFrame, keys: Sequence[str], names: Sequence[str], s: str, at: Sequence[float], compression: float) -> DataFrame:
    """A row a group and quantile from ``_counted``'s row a group."""
    items = []
    for i, q in enumerate(at):
        below, upto, n = F.col(f"{s}_b{i}"), F.col(f"{s}_u{i}"), F.col("n")
        wanted = F.lit(q) * n
        error = F.greatest(below - wanted, wanted - upto, F.lit(0.0)) / n
        bound = F.lit(2 * math.pi / compression) * F.sqrt(F.greatest(F.lit(q * (1 - q)), F.lit(0.25) / n)) + F.lit(2.0) / n
        items.append(
            F.struct(
                F.lit(q).alias("percentile"), F.when(error <= bound, F.element_at(s, i + 1)).alias("estimate"), n.alias("n"), below.alias("n_below"), upto.alias("n_up_to"),
                error.alias("rank_error"), bound.alias("rank_bound"), (error <= bound).alias("within_bound"),
            )
        )
    out = counted.select(*names, F.explode(F.array(*items)).alias("r")).select(*names, "r.*")
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def certify(df: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame, at: Sequence[float], compression: float = COMPRESSION) -> DataFrame:
    """Counts the values below and up to each estimate and returns the certified percentiles.

    A row a group and quantile: ``keys..., percentile, estimate, n, n_below, n_up_to, rank_error,
    rank_bound, within_bound``.  rank_error is how far, as a share of n, the wanted rank lies outside
    the ranks that the estimate has; beyond rank_bound the estimate is null.  The values aren't moved:
    each split counts its own.
    """
    names = [f"k{i}" for i in range(len(keys))]
    # a row a group, used for its size and for the join: made once
    points = cut_lineage(estimates.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("estimates").alias("own")))
    return _rows_of(_counted(_finite(df, keys, value), points, names, ["own"], len(at)), keys, names, "own", at, compression)


def certify_both(df: DataFrame, keys: Sequence[str], rolled: str, value: str, digests: DataFrame, at: Sequence[float], compression: float = COMPRESSION) -> DataFrame:
    """``certify`` of each group's digest and, with a null ``rolled``, of the digests combined over ``rolled``, by one counting pass.

    ``rolled`` is the last of ``keys``.  A group's row carries its own estimates and those of the
    combined digest; the counts for the latter are added up over ``rolled``.
    """
    outer = [k for k in keys if k != rolled]
    names = [f"k{i}" for i in range(len(keys))]
    upper = names[:-1]
    digests = cut_lineage(digests)  # what is kept: a digest a group
    own = quantiles(digests, keys, at).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("estimates").alias("own"))
    whole = quantiles(combine(digests, outer, compression), outer, at).select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(outer)], F.col("estimates").alias("all"))
    cond = F.lit(True)
    for i in range(len(outer)):
        cond = cond & F.col(f"k{i}").eqNullSafe(F.col(f"o{i}"))
    points = cut_lineage(own.join(whole, cond).select(*names, "own", "all"))
    counted = cut_lineage(_counted(_finite(df, [*outer, rolled], value), points, names, ["own", "all"], len(at)))  # a row a group
    sums = [F.sum(f"all_{x}{i}").alias(f"all_{x}{i}") for i in range(len(at)) for x in "bu"]
    together = counted.groupBy(*upper).agg(F.sum("n").alias("n"), F.first("all").alias("all"), *sums)
    rows = _rows_of(together, outer, upper, "all", at, compression).withColumn(rolled, F.lit(None).cast("string"))
    return _rows_of(counted, [*outer, rolled], names, "own", at, compression).unionByName(rows)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """``keys..., percentile, n, value``: exact quantiles, linear between neighbouring ranks, by one distributed sort.

    Rows are sorted over ranges of group and value, so that no group meets in one task; a row's rank
    follows from its place in its range and the group's rows in the ranges before.  Dearer than
    digests, and what they are checked against.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = _finite(df, keys, value)
    placed = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "v").sortWithinPartitions(*names, "v")
    placed = cut_lineage(placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    runs = placed.groupBy(*names, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*names).orderBy("_range")  # a row a group and range
    runs = runs.withColumn("_before", F.sum("_m").over(before) - F.col("_m")).withColumn("n", F.sum("_m").over(Window.partitionBy(*names)))
    wanted = runs.withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("_p", F.col("_q") * (F.col("n") - 1))
    wanted = wanted.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p"))))).where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_m")))
    picked = wanted.select(*[F.col(k).alias(f"_{k}") for k in names], "n", "_q", "_p", "_r", (F.col("_first") + F.col("_r") - F.col("_before")).alias("_at"))
    found = placed.select("_id", "v").join(F.broadcast(picked) if len(at) <= 100 else picked, F.col("_id") == F.col("_at"))
    weight = F.when(F.floor("_p") == F.ceil("_p"), 1.0).when(F.col("_r") == F.floor("_p"), F.ceil("_p") - F.col("_p")).otherwise(F.col("_p") - F.floor("_p"))
    out = found.groupBy(*[f"_{k}" for k in names], "_q").agg(F.max("n").alias("n"), F.sum(F.col("v") * weight).alias("value"))
    return out.select(*[F.col(f"_{n}").alias(k) for n, k in zip(names, keys, strict=True)], F.col("_q").alias("percentile"), "n", "value")
