"""The pipeline's steps, each a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.filters import filter_rows
from millrace.functions.text import qcol
from millrace.functions.types import promote
from millrace.operators import asof
from millrace.options import DEFAULT, Options

__all__ = ["as_of_join", "filter_rows", "group", "join", "limit", "pivot", "select", "sort", "top_k", "union", "unpivot"]


def _known(df: DataFrame, names: Sequence[str], what: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no {what} {', '.join(map(repr, missing))}; there are: {', '.join(df.columns)}")


def names_of(columns: str | Sequence[str]) -> list[str]:
    """``"a, b"`` or ``["a", "b"]`` as names without outer blanks."""
    parts = columns.split(",") if isinstance(columns, str) else list(columns)
    return [p.strip() for p in parts if p.strip()]


def select(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """The columns named, in that order; a name may come twice."""
    names = names_of(columns)
    if not names:
        raise ValueError("select needs a column")
    _known(df, names)
    return df.select(*[qcol(n) for n in names])


_DIRECTIONS = {"asc": True, "a": True, "ascending": True, "desc": False, "d": False, "descending": False}


def sort_keys(keys: str | Sequence[str]) -> list[tuple[str, bool]]:
    """``"region, amount:desc"`` as pairs of name and whether it ascends."""
    out = []
    for part in names_of(keys):
        name, _, way = part.rpartition(":")
        if not name:
            name, way = part, "asc"
        if way.lower() not in _DIRECTIONS:
            raise ValueError(f"{way!r} is no sort direction")
        out.append((name.strip(), _DIRECTIONS[way.lower()]))
    return out


def _sort_columns(df: DataFrame, keys: str | Sequence[str], options: Options) -> list[Column]:
    pairs = sort_keys(keys)
    if not pairs:
        raise ValueError("sort needs a column")
    _known(df, [n for n, _ in pairs])
    out = []
    for name, up in pairs:
        col = qcol(name)
        parts = [col]
        if options.compat and isinstance(df.schema[name].dataType, T.StringType):
            parts = [col.try_cast("double"), col]
        out += [p.asc_nulls_first() if up else p.desc_nulls_last() for p in parts]
    return out


def sort(df: DataFrame, keys: str | Sequence[str], stable: bool = False, options: Options = DEFAULT) -> DataFrame:
    """Rows by ``keys`` (``name[:asc|:desc]``), nulls lowest; ``stable`` keeps the scan order of equal rows."""
    columns = _sort_columns(df, keys, options)
    if not stable:
        return df.orderBy(*columns)
    return df.withColumn("__row_id", F.monotonically_increasing_id()).orderBy(*columns, "__row_id").drop("__row_id")


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The first ``n`` rows after ``offset``."""
    return df.offset(offset).limit(n) if offset else df.limit(n)


def top_k(df: DataFrame, keys: str | Sequence[str], k: int, options: Options = DEFAULT) -> DataFrame:
    """The first ``k`` rows in the order of ``keys``: each task keeps k rows, no full sort."""
    return df.orderBy(*_sort_columns(df, keys, options)).limit(k)


def group(
    df: DataFrame,
    keys: str | Sequence[str] = (),
    sum: str | Sequence[str] = (),  # noqa: A002
    avg: str | Sequence[str] = (),
    min: str | Sequence[str] = (),  # noqa: A002
    max: str | Sequence[str] = (),  # noqa: A002
    count: str | Sequence[str] = (),
    options: Options = DEFAULT,
) -> DataFrame:
    """Aggregates for each value of ``keys`` (none: of the whole table), named ``<column>_<function>``.

    They come in the order sum, avg, min, max, count.  sum and avg skip nulls and text that is no
    number, and are null where nothing is left (compat: 0); count counts rows, and ``1`` or ``*``
    stands for the first column.
    """
    keys = names_of(keys)
    _known(df, keys, "group column")
    wanted = [(f, c) for f, names in (("sum", sum), ("avg", avg), ("min", min), ("max", max), ("count", count)) for c in names_of(names)]
    if not wanted:
        raise ValueError("group needs an aggregate")
    wanted = [(f, df.columns[0] if f == "count" and c in ("1", "*") else c) for f, c in wanted]
    _known(df, [c for _, c in wanted], "aggregate column")

    def number(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return qcol(name).try_cast("double")
        return qcol(name).cast("double") if not isinstance(kind, T.DecimalType) else qcol(name)

    def make(f: str, name: str) -> Column:
        if f == "count":
            out = F.count(F.lit(1))
        elif f in ("sum", "avg"):
            out = getattr(F, f)(number(name))
        else:
            out = getattr(F, f)(number(name) if options.compat else qcol(name))
        if options.compat and f != "count":
            out = F.coalesce(out, F.lit(0.0))
        return out.alias(f"{name}_{f}")

    aggregates = [make(f, c) for f, c in dict.fromkeys(wanted)]
    return df.groupBy(*[qcol(k) for k in keys]).agg(*aggregates) if keys else df.agg(*aggregates)


_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", options: Options = DEFAULT) -> DataFrame:
    """Equi-join on columns of both sides: the left's columns, then the right's without the keys.

    A right column whose name the left has gets the suffix ``_right``.  Keys of two types are compared
    in the type that holds both; null keys match nothing, and the keys of unmatched right rows are
    kept.  compat: keys compare as text, null keys match each other, and right rows without a match
    have null keys.  Which join is used, and broadcasting, is left to the optimizer and its limits.
    """
    keys = names_of(on)
    if not keys:
        raise ValueError("join needs a key")
    _known(left, keys, "left key")
    _known(right, keys, "right key")
    if how not in _KINDS:
        raise ValueError(f"{how!r} is no kind of join: {', '.join(_KINDS)}")
    how = _KINDS[how]
    names = [f"_r{i}" for i in range(len(right.columns))]
    renamed = right.toDF(*names)
    cond = []
    for k in keys:
        a, b = qcol(k), F.col(names[right.columns.index(k)])
        kind = promote(left.schema[k].dataType, right.schema[k].dataType)
        if options.compat:
            cond.append(a.cast("string").eqNullSafe(b.cast("string")))
        else:
            cond.append((a if left.schema[k].dataType == kind else a.cast(kind)) == (b if right.schema[k].dataType == kind else b.cast(kind)))
    joined = left.join(renamed, reduce(lambda x, y: x & y, cond), how)
    if how in ("left_semi", "left_anti"):
        return joined
    out = []
    for c in left.columns:
        if c in keys and how in ("right", "full") and not options.compat:
            kind = promote(left.schema[c].dataType, right.schema[c].dataType)
            out.append(F.coalesce(qcol(c).cast(kind), F.col(names[right.columns.index(c)]).cast(kind)).alias(c))
        else:
            out.append(qcol(c))
    taken = set(left.columns)
    for c, n in zip(right.columns, names, strict=True):
        if c not in keys:
            new = c if c not in taken else f"{c}_right"
            if new in taken:
                raise ValueError(f"both sides have {c!r}, and {new!r} is taken too: rename one first")
            taken.add(new)
            out.append(F.col(n).alias(new))
    return joined.select(*out)


def as_of_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_at: str, right_at: str) -> DataFrame:
    """Each left row with the latest right row of equal keys that isn't after it (see operators.asof)."""
    keys = names_of(on)
    if not keys:
        raise ValueError("join needs a key")
    _known(left, [*keys, left_at])
    _known(right, [*keys, right_at])
    return asof.as_of_join(left, right, keys, left_at, right_at)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name: missing ones null, types promoted, first-seen order."""
    if not frames:
        raise ValueError("union needs a frame")
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for field in f.schema:
            kinds[field.name] = promote(kinds[field.name], field.dataType) if field.name in kinds else field.dataType

    def aligned(f: DataFrame) -> DataFrame:
        have = {x.name: x.dataType for x in f.schema}
        cols = []
        for name, kind in kinds.items():
            if name not in have:
                cols.append(F.lit(None).cast(kind).alias(name))
            elif have[name] == kind:
                cols.append(qcol(name))
            elif isinstance(kind, T.StringType) and isinstance(have[name], (T.StructType, T.ArrayType, T.MapType)):
                cols.append(F.to_json(qcol(name)).alias(name))
            else:
                cols.append(qcol(name).cast(kind).alias(name))
        return f.select(*cols)

    return reduce(lambda a, b: a.union(b), [aligned(f) for f in frames])


def pivot(
    df: DataFrame, index: str | Sequence[str], column: str, values: str, names: Sequence[object] | None = None, order_by: str | None = None
) -> DataFrame:
    """One row for each value of ``index``, one column for each value of ``column``, cells from ``values``.

    Nothing is aggregated: of several rows for a cell the last counts, by ``order_by`` (default: scan
    order); cells without rows are null.  The columns are ``names``, or found by one extra pass in
    first-seen order; their number is bounded by spark.sql.pivotMaxValues.
    """
    index = names_of(index)
    if not index:
        raise ValueError("pivot needs an index column")
    _known(df, [*index, column, values])
    row = qcol(order_by) if order_by else F.monotonically_increasing_id()
    base = df.select(*[qcol(i) for i in index], qcol(column).alias("_c"), qcol(values).alias("_v"), row.alias("_row"))
    if names is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        seen = base.groupBy("_c").agg(F.min("_row").alias("r")).orderBy("r").limit(most + 1).collect()
        if len(seen) > most:
            raise ValueError(f"{column!r} has more than {most} values (spark.sql.pivotMaxValues)")
        names = [r["_c"] for r in seen]
    texts = ["null" if n is None else str(n).lower() if isinstance(n, bool) else str(n) for n in names]
    clash = set(texts) & set(index)
    if clash or len(set(texts)) < len(texts):
        raise ValueError(f"pivoted column names clash: {', '.join(sorted(clash or texts))}")
    # the last value for each cell, as one map-side combined aggregate a column
    picks = [
        F.max_by("_v", F.when(F.col("_c").eqNullSafe(F.lit(n)), F.col("_row"))).alias(t) if n is not None else F.max_by("_v", F.when(F.col("_c").isNull(), F.col("_row"))).alias(t)
        for n, t in zip(names, texts, strict=True)
    ]
    return base.groupBy(*[qcol(i) for i in index]).agg(*picks)


def unpivot(
    df: DataFrame, ids: str | Sequence[str], values: str | Sequence[str], name: str = "variable", value: str = "value", drop_nulls: bool = False
) -> DataFrame:
    """A row for each row and value column: the ids, the column's ``name`` and its ``value`` in the type that holds all."""
    ids, values = names_of(ids), names_of(values)
    if not values:
        raise ValueError("unpivot needs a value column")
    _known(df, [*ids, *values])
    kind = reduce(promote, [df.schema[v].dataType for v in values])
    same = df.select(*[qcol(i) for i in ids], *[qcol(v).cast(kind).alias(v) for v in values])
    out = same.unpivot([qcol(i) for i in ids], [qcol(v) for v in values], name, value)
    return out.where(qcol(value).isNotNull()) if drop_nulls else out
