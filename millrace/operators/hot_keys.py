"""Totals per key when a few keys hold most rows.

Keys are dictionary-encoded within equal input splits, the rows of a split are added into dense
accumulator arrays with ``numpy.bincount``, and the arrays, cut into blocks of the key space, are
summed across splits.  A key costs one array cell per split however many rows it has, so no task
sees more of a hot key than of any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_key_py, qcol

_BLOCK_TYPE = (
    "field_name string, block int, keys array<string>, n_rows array<bigint>, n_values array<bigint>, total array<double>"
)
_TOTAL_TYPE = "field_name string, key_value string, n_rows bigint, n_values bigint, total double"
#: A split's dictionary is emitted and begun anew at this size, which bounds a worker's memory.
DICTIONARY_LIMIT = 500_000


class _Accumulator:
    """One field's dictionary and its dense arrays; position 0 stands for the null key."""

    def __init__(self) -> None:
        self.raw: dict[str | None, int] = {None: 0}
        self.clean: dict[str | None, int] = {None: 0}
        self.names: list[str | None] = [None]
        self.rows = np.zeros(1024, np.int64)
        self.values = np.zeros(1024, np.int64)
        self.total = np.zeros(1024, np.float64)

    def code(self, raw: str | None) -> int:
        found = self.raw.get(raw)
        if found is None:
            key = clean_key_py(raw)
            found = self.clean.get(key)
            if found is None:
                found = self.clean[key] = len(self.names)
                self.names.append(key)
            self.raw[raw] = found
        return found

    def room(self) -> None:
        while len(self.names) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.total = np.concatenate([self.total, np.zeros_like(self.total)])

    def add(self, column: pa.Array, usable: np.ndarray, amounts: np.ndarray) -> None:
        encoded = column.dictionary_encode()
        codes = np.fromiter((self.code(x) for x in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
        at = np.asarray(pc.fill_null(encoded.indices, -1), dtype=np.int64)
        position = np.append(codes, 0)[at]  # -1, a null, takes the last, which is 0
        self.room()
        size = len(self.names)
        self.rows[:size] += np.bincount(position, minlength=size)
        self.values[:size] += np.bincount(position[usable], minlength=size)
        self.total[:size] += np.bincount(position[usable], weights=amounts[usable], minlength=size)

    def blocks(self, n_blocks: int) -> Iterator[tuple[int, np.ndarray]]:
        home = np.fromiter(
            (zlib.crc32(x.encode("utf-8", "surrogatepass")) % n_blocks if x is not None else 0 for x in self.names), np.int64, len(self.names)
        )
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[order])) + 1
        for part in np.split(order, edges):
            part = part[self.rows[part] > 0]
            if len(part):
                yield int(home[part[0]]), part


def _encode_splits(fields: Sequence[str], n_blocks: int, has_value: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {f: _Accumulator() for f in fields}

        def flush(field: str) -> Iterator[pa.RecordBatch]:
            acc = state[field]
            state[field] = _Accumulator()
            for block, part in acc.blocks(n_blocks):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([field]),
                        pa.array([block], pa.int32()),
                        pa.array([[acc.names[i] for i in part]], pa.list_(pa.string())),
                        pa.array([acc.rows[part]], pa.list_(pa.int64())),
                        pa.array([acc.values[part]], pa.list_(pa.int64())),
                        pa.array([acc.total[part]], pa.list_(pa.float64())),
                    ],
                    names=["field_name", "block", "keys", "n_rows", "n_values", "total"],
                )

        for batch in batches:
            if has_value:
                value = batch.column(len(fields)).cast(pa.float64())
                amounts = np.asarray(pc.fill_null(value, float("nan")), dtype=np.float64)
            else:
                amounts = np.full(batch.num_rows, np.nan)
            usable = ~np.isnan(amounts)
            for i, field in enumerate(fields):
                state[field].add(batch.column(i), usable, amounts)
                if len(state[field].raw) > DICTIONARY_LIMIT:
                    yield from flush(field)
        for field in fields:
            yield from flush(field)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds array blocks, which come in the order of field and block: one dictionary a block, arrays scatter-added.

    A worker holds one block of the key space at a time, however many its partition has.
    """
    code: dict[str | None, int] = {}
    sums = [np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.float64)]
    now: tuple[str, int] | None = None

    def out() -> Iterator[pa.RecordBatch]:
        names = list(code)
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            columns = [pa.array([now[0]] * len(part), pa.string()), pa.array(part, pa.string()), *(pa.array(x[lo : lo + len(part)]) for x in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["field_name", "key_value", "n_rows", "n_values", "total"])

    for batch in batches:
        for field, block, keys, *parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
            if (field, block) != now:
                if code:
                    yield from out()
                code, now = {}, (field, block)
                for x in sums:
                    x[:] = 0
            at = np.fromiter((code.setdefault(k, len(code)) for k in keys.as_py()), np.int64, len(keys))
            while len(code) > len(sums[0]):
                sums = [np.concatenate([x, np.zeros_like(x)]) for x in sums]
            for x, part in zip(sums, parts, strict=True):
                np.add.at(x, at, part.values.to_numpy())
    if code:
        yield from out()


def _blocks(df: DataFrame, partitions: int) -> int:
    """Blocks of the key space: four a partition, more where the planner expects more than 64 MB of input for each."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return partitions * min(256, max(4, -(-size // (partitions * (64 << 20)))))


def key_totals(df: DataFrame, keys: Sequence[str], value: str | None = None, blocks: int | None = None) -> DataFrame:
    """Rows, usable values and their sum for each clean key of each of ``keys``.

    Returns ``field_name, key_value, n_rows, n_values, total``.  Null, blank and empty keys of a field
    share the row whose key_value is null.  Null and NaN values count as rows but not as values; a key
    without usable values has total 0.0.  Repeated rows count as often as they occur; an empty table
    gives no rows; other columns of ``df`` are not read.  ``blocks`` (default: see ``_blocks``) is the
    number of pieces the key space is reduced in; a worker holds one at a time.
    """
    if not keys:
        raise ValueError("key_totals needs at least one key column")
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [qcol(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    if value is not None:
        columns.append(qcol(value).cast("double").alias("v"))
    chosen = df.select(*columns)
    n_blocks = blocks or _blocks(chosen, partitions)
    encoded = chosen.mapInArrow(_encode_splits(list(keys), n_blocks, value is not None), _BLOCK_TYPE)
    placed = encoded.repartition(partitions, "field_name", "block").sortWithinPartitions("field_name", "block")
    return placed.mapInArrow(_sum_blocks, _TOTAL_TYPE)


def hot_keys(totals: DataFrame, share: float = 0.03) -> DataFrame:
    """Of ``key_totals``: the non-null keys that hold at least ``share`` of their field's rows with a key.

    Adds ``field_rows`` and ``share``.  The field sums are one row a field, so joining them costs
    nothing; both uses of ``totals`` share one exchange.
    """
    keyed = totals.where(F.col("key_value").isNotNull())
    sums = keyed.groupBy(F.col("field_name").alias("f")).agg(F.sum("n_rows").alias("field_rows"))
    joined = keyed.join(F.broadcast(sums), F.col("field_name") == F.col("f")).drop("f")
    # rows * 1.0 >= share * rows_of_the_field, in the form that loses least
    return joined.withColumn("share", F.col("n_rows") / F.col("field_rows")).where(F.col("n_rows") >= F.lit(share) * F.col("field_rows"))
