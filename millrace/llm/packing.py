"""Items of varying length put into containers of fixed capacity, by multiway differencing.

Every item starts as a partial partition of k windows with one filled.  The two partial partitions
with the largest imbalance are merged again and again, the fullest windows of the one onto the
emptiest of the other, until one partition is left, whose windows are nearly equal.  k starts at the
least that the total allows and rises while a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed together: 2,000 fill containers of about ten items to 99.4 %, ten times as many to 99.5 % at 30 times the work an item.
SHARD_ITEMS = 2_000

_Slot = tuple[int, object]


def _merge(a: list[_Slot], b: list[_Slot], k: int) -> list[_Slot]:
    """Both lists hold filled windows, fullest first; windows not listed are empty."""
    lone = k - len(b)  # so many of a's fullest windows meet empty ones
    if len(a) <= lone:
        if b[0][0] <= a[-1][0]:
            a.extend(b)
            return a
        return sorted(a + b, key=lambda s: -s[0])
    out = a[:lone]
    rising = b[::-1]
    out += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[lone:], rising, strict=False)]
    out += rising[len(a) - lone :]
    out.sort(key=lambda s: -s[0])
    return out


def difference(sizes: Sequence[int], k: int) -> list[tuple[int, list[int]]]:
    """At most k windows of nearly equal sums: each its sum and the positions of its items."""
    heap: list[tuple[int, int, list[_Slot]]] = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        first = heapq.heappop(heap)[2]
        second = heap[0][2]
        merged = _merge(first, second, k)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heapreplace(heap, (-spread, stamp, merged))
        stamp += 1
    windows = []
    for total, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                items.append(node)
        windows.append((total, items))
    return windows


def pack(sizes: Sequence[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Windows within ``capacity`` for items none of which exceeds it; empty items join the first window."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    full = [i for i, s in enumerate(sizes) if s > 0]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    if not full:
        return [(0, empty)] if empty else []
    some = [sizes[i] for i in full]
    least = max(1, -(-sum(some) // capacity))

    def attempt(k: int) -> list[tuple[int, list[int]]] | None:
        windows = difference(some, k)
        return windows if max(w[0] for w in windows) <= capacity else None

    k, step, tried = least, 1, least - 1
    found = attempt(k)
    while found is None:
        tried = k
        k = min(k + step, len(some))  # one window an item always fits
        step *= 2
        found = attempt(k)
    while k - tried > 1:  # the least count between the last that failed and the first that fit
        middle = (k + tried) // 2
        better = attempt(middle)
        if better is None:
            tried = middle
        else:
            k, found = middle, better
    windows = [(total, [full[i] for i in items]) for total, items in found]
    if empty:
        windows[0] = (windows[0][0], windows[0][1] + empty)
    return windows


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS, n_items: int | None = None) -> DataFrame:
    """``container, <item_id>, piece_no, first_unit, n_units, container_units``: one row a placed piece.

    An item is split only if it alone exceeds the capacity: into pieces that each fill a container
    and a rest that is packed like any other item.  Items of size 0 or null take no room but do get
    a container.  Repeated items and null ids are items like others.  Items are dealt evenly to
    shards of about ``shard_items``, whatever their ids or sizes, and each shard is packed on its
    own; an empty table gives no rows.  ``n_items``, where it is known more cheaply than by counting
    ``items``, only sets the number of shards.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = dict(items.dtypes)[item_id]
    shards = max(1, -(-(items.count() if n_items is None else n_items) // shard_items))
    spark = items.sparkSession
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    row = F.monotonically_increasing_id()
    dealt = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), row.alias("row"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        sizes = pdf["size"].to_numpy(np.int64)
        rests = np.where(sizes > capacity, sizes % capacity, sizes)
        positions = np.flatnonzero((rests > 0) | (sizes <= 0))
        ids = list(pdf["id"])
        out = []
        n = 0
        for i in np.flatnonzero(sizes > capacity):
            for piece in range(int(sizes[i]) // capacity):
                out.append((f"{key[0]}-{n}", ids[i], piece, piece * capacity, capacity, capacity))
                n += 1
        for total, members in pack([int(rests[i]) for i in positions], capacity):
            for m in members:
                i = positions[m]
                before = (int(sizes[i]) - int(rests[i])) if sizes[i] > capacity else 0
                out.append((f"{key[0]}-{n}", ids[i], before // capacity, before, max(int(rests[i]), 0), total))
            n += 1
        return pd.DataFrame(out, columns=["container", item_id, "piece_no", "first_unit", "n_units", "container_units"])

    schema = f"container string, `{item_id}` {kind}, piece_no int, first_unit bigint, n_units bigint, container_units bigint"
    # few bytes but much work: a given number of partitions, which adaptive execution doesn't coalesce
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, units placed, the largest container and the share of all room that is used."""
    per = packed.groupBy("container").agg(F.sum("n_units").alias("u"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("u").alias("n_units"), F.max("u").alias("largest"), (F.sum("u") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("fill")
    )
