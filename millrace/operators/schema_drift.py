"""Feeds of delimited files whose columns drift: one consistent table, and a report of every change.

Each file's schema is a small tree.  Its columns are tied to the fields of the consistent table by
the cheapest edit script between the two trees; what a rename costs comes from names, and from what
the column's cells are like.  The script is compiled into the projection that reads the file, and
the script between a file's tree and that of the preceding file of its feed is the report.
"""

from __future__ import annotations

import csv
import json
import math
import re
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.schema_tree import FORBIDDEN, Node, edit_script
from millrace.session import cut_lineage

#: The consistent table's fields, each with the names it is known to go by beforehand (lower case): here its own alone.
FIELDS: dict[str, tuple[str, ...]] = {f: (f,) for f in ("customer", "region", "product", "amount", "date")}
#: Files of a feed are folded in blocks of so many numbers, so that no feed, however long, meets in one task.
BLOCK = 4096
#: Cost of taking a column of an unlisted name for a field whose cells are all alike; it rises to 1 (no tie) where half of them are,
#: and falls by NEAR where the name is like one of the field's.
TIE, NEAR = 0.3, 0.4

_TYPES = ("long", "double", "date")
_LONG = re.compile(r"[+-]?[0-9]+")
_DOUBLE = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_FACTS = "file_id bigint, pos int, _feed string, name string, field string, sign string, n bigint, n_long bigint, n_double bigint, n_date bigint"
_CHANGES = "file_id bigint, field_name string, change_kind string, old_name string, new_name string, old_type string, new_type string"


def split_line(line: str | None, delim: str) -> list[str]:
    """The cells of a line; a cell in double quotes may hold separators, inner quotes doubled."""
    if line is None:
        return []
    if '"' not in line:
        return line.split(delim)
    return next(csv.reader([line], delimiter=delim), [""])


def header_names(header: str | None, delim: str | None) -> list[str]:
    """Column names in lower case, without surrounding blanks and quotes."""
    if not header:
        return []
    return [x.strip().strip('"').strip().lower() for x in split_line(header.lstrip("\ufeff"), delim or ",")]


_MONEY = re.compile(r"(?:[A-Z]{3} ?)?([+-]?[0-9][0-9,]*\.?[0-9]*|[+-]?\.[0-9]+)(?: ?[A-Z]{3})?")
_DAY = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}|(?:19|20)[0-9]{2}[01][0-9][0-3][0-9]|1[0-9]{9}(?:[0-9]{3})?")
_CODE = re.compile(r"[0-9]{4,9}")


def _sign(cell: str) -> str:
    """What a cell tells of its column: that it is a date, a number's size to half a power of ten, or its text."""
    cell = cell.strip()
    if _DAY.fullmatch(cell):
        return "D"
    number = _MONEY.fullmatch(cell)
    if number is None:
        return "T" + " ".join(cell.lower().split())
    digits = number[1]
    digits = digits.replace(",", ".") if re.fullmatch(r"[+-]?[0-9]+,[0-9]{1,2}", digits) else digits.replace(",", "")
    value = float(digits)
    return f"N{'-' if value < 0 else ''}{math.floor(2 * math.log10(min(abs(value), 1e300) + 1))}"


def _facts(files: DataFrame, lines: DataFrame, known: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """What one pass over all lines tells: ``_FACTS``, written once.

    Rows with a file_id count, per file and column, the non-empty cells and those that fit each type;
    rows with a sign count how often it occurs in a feed's column of an unlisted name, or in a field.
    """
    head = files.select("file_id", _feed_key(), "delim", "header_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, tuple[int, int, int, str, str | None]] = {}
        counts: dict[tuple, int] = {}
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _FACTS.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            fits: dict[tuple[int, int], list[int]] = {}
            for file_id, feed, delim, header, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line is None:
                    continue
                owners = _owners(feed, header, delim, known)
                for pos, cell in enumerate(split_line(line, delim or ",")):
                    if not cell:
                        continue
                    told = cells.get(cell)
                    if told is None:
                        if len(cells) > 200_000:
                            cells.clear()
                        sign = _sign(cell)
                        # a number that may be a code is told by its digits too
                        code = "X" + cell if sign[0] == "N" and _CODE.fullmatch(cell) else None
                        told = cells[cell] = (_LONG.fullmatch(cell) is not None, _DOUBLE.fullmatch(cell) is not None, _DATE.fullmatch(cell) is not None, sign, code)
                    f = fits.get((file_id, pos))
                    if f is None:
                        f = fits[file_id, pos] = [0, 0, 0, 0]
                    f[0] += 1
                    f[1] += told[0]
                    f[2] += told[1]
                    f[3] += told[2]
                    if pos < len(owners):
                        for sign in told[3:]:
                            if sign is not None:
                                key = (*owners[pos], sign)
                                counts[key] = counts.get(key, 0) + 1
            yield out([(*k, None, None, None, None, *v) for k, v in fits.items()])
            if len(counts) > 200_000:
                yield out([(None, None, *k, n, 0, 0, 0) for k, n in counts.items()])
                counts = {}
        yield out([(None, None, *k, n, 0, 0, 0) for k, n in counts.items()])

    cells = lines.select("file_id", "line_text").join(head, "file_id").select("file_id", "_feed", "delim", "header_line", "line_text")
    keys = ["file_id", "pos", "_feed", "name", "field", "sign"]
    sums = [F.sum(c).alias(c) for c in ("n", "n_long", "n_double", "n_date")]
    return cut_lineage(cells.mapInArrow(run, _FACTS).groupBy(*keys).agg(*sums))


def column_types(facts: DataFrame) -> DataFrame:
    """``file_id, types``: for each file with cells, a map of column position to type (without non-empty cells: absent)."""
    kind: Column = F.lit("string")
    for t in reversed(_TYPES):
        kind = F.when(F.col(f"n_{t}") == F.col("n"), t).otherwise(kind)
    typed = facts.where(F.col("file_id").isNotNull()).withColumn("kind", kind)
    # one entry a column of a file: as small as the file's header
    return typed.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "kind"))).alias("types"))


def _feed_key() -> Column:
    return F.when(F.col("feed").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("feed").cast("string"))).alias("_feed")


def column_ties(files: DataFrame, facts: DataFrame, known: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """``_feed, ties``: for each feed, what it costs to take columns of unlisted names for fields, as JSON of [name, field, cost].

    A column is likened by its cells over all files of its feed to the columns that hold a field
    under a known name: the share of its cells that are dates, numbers (half for those of the same
    size), or texts that the field has too.  A name that is like one of the field's makes up for a
    part of what is missing, and decides alone where the column has no cells.  One that stands beside the field in a file of its feed is something
    else; standing beside it in other feeds counts against it by the share of such files.
    """
    head = files.select("file_id", _feed_key(), "delim", "header_line")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for feed, delim, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = tuple(header_names(header, delim))
                bound = _bind(names, "", known)
                rows += [(feed, n, f, int(f in bound), _likeness(n, (f, *aliases))) for n, b in zip(names, bound, strict=True) if b is None and n for f, aliases in known]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["_feed", "name", "field", "beside", "near"])

    pairs = head.select("_feed", "delim", "header_line").mapInArrow(beside, "_feed string, name string, field string, beside bigint, near double")
    pairs = cut_lineage(pairs.groupBy("_feed", "name", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("beside").alias("beside"), F.max("near").alias("near")))
    same = Window.partitionBy("name", "field")
    open_ = pairs.withColumn("against", F.sum("beside").over(same) / F.sum("n").over(same)).where("beside = 0").select("_feed", "name", "field", "against", "near")

    kind = F.substring("sign", 1, 1)
    told = facts.where(F.col("sign").isNotNull()).select("_feed", "name", "field", "sign", "n", kind.alias("kind"))
    once = F.sum(F.when(F.col("kind") != "X", F.col("n")))
    of_field = told.where("field is not null").select("field", "sign", F.col("n").alias("n_f"))
    # three rows a field: how many of its cells are of a kind, and how many there are
    of_kind = told.where("field is not null").groupBy("field", "kind").agg(F.sum("n").alias("n_kind"), F.coalesce(once, F.lit(0)).alias("_once"))
    of_kind = of_kind.withColumn("all_f", F.greatest(F.sum("_once").over(Window.partitionBy("field")), F.lit(1))).drop("_once")
    of_name = told.where("field is null").select("_feed", "name", "sign", "kind", "n")
    filled = told.where("field is null").groupBy("_feed", "name").agg(once.alias("all_n"))
    p, p_f, p_kind = (F.col(x) / F.col(y) for x, y in (("n", "all_n"), ("n_f", "all_f"), ("n_kind", "all_f")))
    shared = F.when(F.col("n_f").isNull(), 0.0).when(F.col("kind").isin("T", "X"), p).otherwise((F.least(p, p_f) + p * p_kind) / 2)
    met = open_.join(filled, ["_feed", "name"], "left").join(of_name, ["_feed", "name"], "left").join(of_field, ["field", "sign"], "left").join(F.broadcast(of_kind), ["field", "kind"], "left")
    seen = [F.first(c).alias(c) for c in ("against", "near", "all_n")]
    alike = met.groupBy("_feed", "name", "field").agg(F.least(F.sum(F.coalesce(shared, F.lit(0.0))), F.lit(1.0)).alias("alike"), *seen)
    alike = alike.withColumn("alike", F.when(F.col("all_n").isNull(), 0.5).otherwise(F.col("alike")))
    cost = F.round(F.lit(TIE) + (1.0 - TIE) * 2.0 * (1.0 - F.col("alike")) + F.col("against") - NEAR * F.col("near"), 6)
    near = alike.withColumn("cost", cost).where("cost < 1.0")
    return near.groupBy("_feed").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "field", "cost")))).alias("ties"))


@lru_cache(maxsize=50_000)
def _likeness(name: str, known: tuple[str, ...]) -> float:
    """How like a name is to one of a field's, from 0 to 1: 1 where one contains the other."""
    plain = re.sub(r"[^a-z]", "", name)
    best = 0.0
    for other in (re.sub(r"[^a-z]", "", k) for k in known):
        if min(len(plain), len(other)) >= 3 and (plain in other or other in plain):
            return 1.0
        best = max(best, 2.0 * SequenceMatcher(None, plain, other).ratio() - 1.0)
    return best


@lru_cache(maxsize=20_000)
def _owners(feed: str, header: str | None, delim: str | None, known: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[tuple, ...]:
    """For each column its feed and name, or the field that it holds under a known name."""
    names = tuple(header_names(header, delim))
    return tuple((feed, n, None) if b is None else (None, None, b) for n, b in zip(names, _bind(names, "", known), strict=True))


def _tied(files: DataFrame, facts: DataFrame, known) -> DataFrame:
    """``files`` with ``ties`` of their feeds, empty where there are none."""
    found = column_ties(files, facts, known)
    return files.withColumn("_feed", _feed_key()).join(found, "_feed", "left").drop("_feed").withColumn("ties", F.coalesce("ties", F.lit("")))


@lru_cache(maxsize=1000)
def _ties(text: str) -> dict[tuple[str, str], float]:
    return {(t["name"], t["field"]): t["cost"] for t in json.loads(text)} if text else {}


@lru_cache(maxsize=50_000)
def _bind(names: tuple[str, ...], ties: str, known: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str | None, ...]:
    """For each column, the field that it holds (None: a column of its own), by the cheapest edit script from the table's tree to the file's.

    Turning a field into a column is free under its own name, dearer under another that is known for
    it or spelled alike; for any other name it costs what ``column_ties`` says.
    """
    aliases, costs = dict(known), _ties(ties)

    def cost(field: Node, column: Node) -> float:
        if column.name == field.name:
            return 0.0
        if column.name in aliases[field.name]:
            return 0.1 + 0.01 * aliases[field.name].index(column.name)
        plain = re.sub(r"[^a-z]", "", column.name)
        if plain and any(plain == re.sub(r"[^a-z]", "", a) for a in aliases[field.name]):
            return 0.5
        return costs.get((column.name, field.name), FORBIDDEN)

    table = Node("", "struct", tuple(Node(f, "string") for f in aliases))
    script = edit_script(table, Node("", "struct", tuple(Node(n, "string") for n in names)), cost)
    field_of = {column: field for field, column in script.kept.items()}
    # of equally named columns the first counts
    return tuple(field_of.get(n) if names.index(n) == i else None for i, n in enumerate(names))


def _tree(columns: Mapping[str, tuple[str, str | None]], known: set[str]) -> Node:
    """A file's schema: field -> (column name, type), as a tree."""
    return Node("", "struct", tuple(Node(name, kind or "unknown", (), field if field in known else "=" + field) for field, (name, kind) in columns.items()))


def _columns(header: str | None, delim: str | None, types: Mapping[int, str] | None, ties: str, known) -> dict[str, tuple[str, str | None]]:
    names = tuple(header_names(header, delim))
    kinds = tuple((types or {}).get(i) for i in range(len(names)))
    out: dict[str, tuple[str, str | None]] = {}
    for name, kind, field in zip(names, kinds, _bind(names, ties, known), strict=True):
        out.setdefault(field or name, (name, kind))  # of equally named columns the first counts
    return out


def _fold(known, with_changes: bool):
    """A function that walks the files of one block of a feed in order, from the state before the block."""
    fields = {f for f, _ in known}

    def walk(pdf: pd.DataFrame, before: dict[str, tuple[str, str | None]] | None, last: dict[str, str]):
        rows, last = [], dict(last)
        for r in pdf.sort_values(["seq_no", "file_id"], kind="stable").itertuples():
            types = {int(k): v for k, v in (r.types.items() if isinstance(r.types, dict) else list(r.types) if r.types is not None else ())}
            now = {}
            for f, (name, kind) in _columns(r.header_line, r.delim, types, r.ties, known).items():
                kind = kind or last.get(f)
                if kind:
                    last[f] = kind
                now[f] = (name, kind)
            if with_changes and before is not None:
                for e in edit_script(_tree(before, fields), _tree(now, fields)).edits:
                    if e.what == "retyped" and "unknown" in (e.old_kind, e.new_kind):
                        continue
                    field = e.means[1:] if e.means and e.means[0] == "=" else e.means
                    rows.append((r.file_id, field, e.what, e.old, e.new, e.old_kind, e.new_kind))
            before = now
        return rows, before, last

    return walk


def _known(fields: Mapping[str, tuple[str, ...]]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((f, tuple(a)) for f, a in fields.items())


def drift_report(files: DataFrame, lines: DataFrame, fields: Mapping[str, tuple[str, ...]] = FIELDS, block: int = BLOCK) -> DataFrame:
    """Every change of a file's columns against the preceding file of its feed.

    ``files``: file_id, feed, seq_no, delim, header_line; ``lines``: file_id, line_text.  Returns
    ``file_id, field_name, change_kind, old_name, new_name, old_type, new_type`` with change_kind
    ``added``, ``removed``, ``renamed`` or ``retyped``.  A column's type is the first of long, double,
    date, string that fits all its non-empty cells; without such cells it keeps the last type it had
    in the feed, and while it has had none it can't be retyped.  Files without a header have no
    columns; null lines, lines of unknown files and feeds of one file give nothing; files with equal
    numbers are taken in the order of file_id; a null feed is a feed, a null number comes first.
    """
    known = _known(fields)
    facts = _facts(files, lines, known)
    meta = _tied(files, facts, known).select("file_id", "feed", F.coalesce("seq_no", F.lit(-1)).cast("long").alias("seq_no"), "delim", "header_line", "ties")
    every = meta.join(column_types(facts), "file_id", "left").withColumn("blk", F.floor(F.col("seq_no") / block))
    every = every.withColumn("types", F.map_entries("types"))
    every = every.withColumn("types", F.transform("types", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    state_type = "feed string, blk bigint, cols array<struct<f:string,n:string,k:string>>, last array<struct<f:string,k:string>>"
    summarise, report = _fold(known, False), _fold(known, True)

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(types=[None if t is None else {e["key"]: e["value"] for e in t} for t in pdf["types"]])

    def summary(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, cols, last = summarise(entries(pdf), None, {})
        return pd.DataFrame(
            {"feed": [key[0]], "blk": [key[1]], "cols": [[(f, n, k) for f, (n, k) in cols.items()]], "last": [list(last.items())]}
        )

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """From each block's own end to the state before each block."""
        out, cols, last = [], None, {}
        for r in pdf.sort_values("blk").itertuples():
            out.append((r.feed, r.blk, cols, list(last.items())))
            # a column without cells in its block has the type from before
            last = {**last, **{e["f"]: e["k"] for e in r.last}}
            cols = [(e["f"], e["n"], e["k"] or last.get(e["f"])) for e in r.cols]
        return pd.DataFrame(out, columns=["feed", "blk", "cols", "last"])

    names = [c.split()[0] for c in _CHANGES.split(", ")]

    def first_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(report(entries(pdf), None, {})[0], columns=names)

    def later_block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        before, last = None, {}
        if len(right) and right["cols"].iloc[0] is not None:
            before = {e["f"]: (e["n"], e["k"]) for e in right["cols"].iloc[0]}
            last = {e["f"]: e["k"] for e in right["last"].iloc[0]}
        return pd.DataFrame(report(entries(left), before, last)[0], columns=names)

    every = cut_lineage(every)  # a row a file: read once for the blocks' states and once for the changes
    many = every.groupBy("feed").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).where("hi > lo")
    if many.isEmpty():
        # few bytes but much work: a given number of partitions, which adaptive execution doesn't coalesce
        spread = every.repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * files.sparkSession.sparkContext.defaultParallelism), "feed", "blk")
        return spread.groupBy("feed", "blk").applyInPandas(first_block, _CHANGES)
    long = many.select(F.col("feed").alias("_feed"))
    blocked = every.join(long, F.col("feed").eqNullSafe(F.col("_feed")), "left_semi")
    states = blocked.groupBy("feed", "blk").applyInPandas(summary, state_type).groupBy("feed").applyInPandas(carry, state_type)
    return every.groupBy("feed", "blk").cogroup(states.groupBy("feed", "blk")).applyInPandas(later_block, _CHANGES)


def _project(known, extra: bool):
    fields = [f for f, _ in known]

    @lru_cache(maxsize=20_000)
    def plan(header: str | None, delim: str | None, ties: str) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
        """The compiled script of a header: where each field is found (-1: nowhere), and the other columns."""
        names = tuple(header_names(header, delim))
        bound = _bind(names, ties, known)
        return tuple(bound.index(f) if f in bound else -1 for f in fields), tuple((n, i) for i, n in enumerate(names) if bound[i] is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, delims, headers, texts, ties = (c.to_pylist() for c in batch.columns[:6])
            columns: list[list] = [[] for _ in fields]
            rest = []
            for delim, header, text, tie in zip(delims, headers, texts, ties, strict=True):
                cells = split_line(text, delim or ",")
                where, others = plan(header, delim, tie)
                for out, i in zip(columns, where, strict=True):
                    out.append((cells[i] or None) if 0 <= i < len(cells) else None)
                rest.append([(n, cells[i]) for n, i in others if i < len(cells) and cells[i]] if extra else None)
            arrays = [pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), *[pa.array(c, pa.string()) for c in columns]]
            arrays.append(pa.array(rest, pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays(arrays, names=["file_id", "line_no", *fields, "others"])

    return run


def consistent_table(files: DataFrame, lines: DataFrame, fields: Mapping[str, tuple[str, ...]] = FIELDS, date_of_path: str | None = "date") -> DataFrame:
    """All lines of all files as one table: file_id, line_no, the fields as text, ``others``.

    Each file is read through the projection its script compiles to; columns of unlisted names are
    tied to fields by ``column_ties``, over the files of a feed where ``files`` has one.  ``others`` maps the file's
    further columns to their non-empty cells.  An empty cell is null.  Where a file has no date
    column, ``date`` is filled from the path's date (None: isn't).  Every line with a file comes out
    exactly once; cells beyond the header are dropped, missing ones are null.
    """
    known = _known(fields)
    if "feed" not in files.columns:
        files = files.withColumn("feed", F.lit(None).cast("string"))
    head = _tied(files, _facts(files, lines, known), known).select("file_id", "delim", "header_line", "ties", *([F.col(date_of_path).alias("_path_date")] if date_of_path else []))
    joined = lines.select("file_id", "line_no", "line_text").join(head, "file_id")
    kind = "file_id bigint, line_no int, " + ", ".join(f"{f} string" for f in fields) + ", others map<string,string>"
    if not date_of_path or "date" not in fields:
        return joined.select("file_id", "line_no", "delim", "header_line", "line_text", "ties").mapInArrow(_project(known, True), kind)
    # the path's date rides along as one more cell of a column that is used only where no other date is
    inner = joined.select("file_id", "line_no", "delim", "header_line", "line_text", "ties", "_path_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _project(known, True)
        at = 2 + list(fields).index("date")
        for batch in batches:
            for out in project(iter([batch])):
                dates = pc.coalesce(out.column(at), batch.column(6).cast(pa.string()))
                yield out.set_column(at, "date", dates)

    return inner.mapInArrow(run, kind)


def money(text: Column) -> Column:
    """A number from a cell that may have a currency code, a decimal comma or quotes; null where there is none."""
    bare = F.regexp_replace(text, r"[^0-9,.+\-eE]", "")
    dotted = F.when(bare.rlike(r"^[+-]?[0-9]+,[0-9]{1,2}$"), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return dotted.try_cast("double")


def calendar_date(text: Column) -> Column:
    """A date (UTC) from the spellings that occur: year first with or without separators and time, day first with points or slashes, or seconds or milliseconds since 1970."""
    t = F.trim(text)
    seconds = F.when(t.rlike(r"^1[0-9]{9}$"), t.try_cast("bigint")).when(t.rlike(r"^1[0-9]{12}$"), F.floor(t.try_cast("bigint") / 1000))
    parts = [
        (r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)),
        (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", (1, 2, 3)),
        (r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", (3, 2, 1)),
    ]
    out: Column = F.lit(None).cast("date")
    for pattern, (y, m, d) in reversed(parts):
        pieces = [F.lpad(F.regexp_extract(t, pattern, i), 2 if i != y else 4, "0") for i in (y, m, d)]
        out = F.when(t.rlike(pattern), F.concat_ws("-", *pieces).try_cast("date")).otherwise(out)
    return F.when(seconds.isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))).otherwise(out)
