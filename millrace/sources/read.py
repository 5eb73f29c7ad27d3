"""Loading tables from files of any known format, one or many, with schemas that differ."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import qcol
from millrace.operators.relational import union
from millrace.options import DEFAULT, Options
from millrace.sources import paths as P
from millrace.sources.flatten import columnar_rows, flatten
from millrace.sources.xml_records import columns_of, records
from millrace.session import shared_dir

#: XML documents up to this size are read whole, larger ones need a row tag.
XML_WHOLE = 64 << 20
_CSV = {"header": "true", "multiLine": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "quote": '"', "escape": '"'}


def _simple(kind: T.DataType) -> T.DataType:
    """The few types that text is read as: text, whole numbers, fractions, booleans; dates stay text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return kind if isinstance(kind, T.BooleanType) else T.StringType()


def _cells_span_lines(spark: SparkSession, files: Sequence[str]) -> bool:
    """Whether a quoted cell holds a line break: then, and only then, some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(list(files)).where(F.col("value").contains('"') & (quotes % 2 == 1)).limit(1).isEmpty()


def read_delimited(spark: SparkSession, files: Sequence[str], sep: str = ",", schema: T.StructType | None = None, multiline: bool | None = None) -> DataFrame:
    """CSV or TSV files that share one header. Without ``schema`` one pass infers it; empty cells are null.

    Files whose quoted cells hold line breaks (``multiline``; None: found out by a scan of the quotes)
    are read whole by one task each, all others are split.
    """
    if multiline is None:
        multiline = _cells_span_lines(spark, files)
    reader = spark.read.options(**_CSV).option("sep", sep).option("multiLine", str(multiline).lower())
    if schema is None:
        seen = reader.option("inferSchema", "true").csv(list(files)).schema
        schema = T.StructType([T.StructField(f.name, _simple(f.dataType)) for f in seen])
    return reader.schema(schema).csv(list(files))


def headers(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line, which is read by the executors, a few kilobytes a file."""
    from pyarrow import fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            lines = []
            for name in names:
                system, at = pafs.FileSystem.from_uri(name if "://" in name else os.path.abspath(name))
                with system.open_input_stream(at) as f:
                    data = b""
                    while b"\n" not in data and (more := f.read(1 << 16)):
                        data += more
                lines.append(data.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["path", "header"])

    table = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 64))
    out: dict[str, list[str]] = {}
    for r in sorted(table.mapInArrow(run, "path string, header string").collect()):
        out.setdefault(r.header, []).append(r.path)
    return out


def _delimited(spark: SparkSession, files: Sequence[str], sep: str, schema, sample_files: int | None) -> DataFrame:
    if len(files) == 1 or any(os.path.isdir(f) for f in files):
        return read_delimited(spark, files, sep, schema)
    groups = headers(spark, files)
    first = {g[0]: h for h, g in groups.items()}
    frames = [read_delimited(spark, groups[first[p]], sep, schema) for p in sorted(first)]  # one scan a header
    out = union(frames)
    if sample_files is not None:
        kept = list(dict.fromkeys(c for f in list(files)[:sample_files] for c in read_delimited(spark, [f], sep).columns))
        out = out.select(*[qcol(c) for c in kept])
    return out


def _first_sign(spark: SparkSession, path: str) -> str:
    """The first sign of a file that isn't white space; of a stored table, "[" (a record a line is read as rows too)."""
    if P.is_remote(path):
        line = spark.read.text(path).where(F.trim(F.replace("value", F.lit("\ufeff"), F.lit(""))) != "").first()
        return line.value.strip("\ufeff \t\r")[:1] if line else ""
    if os.path.isdir(path):
        return "["
    with open(path, encoding="utf-8-sig") as f:
        while ch := f.read(1):
            if not ch.isspace():
                return ch
    return ""


def read_json(spark: SparkSession, files: Sequence[str], flat: bool = True) -> DataFrame:
    """JSON files that hold an array of objects, one object, or one object of equally long arrays."""
    frames = []
    objects = [f for f in files if _first_sign(spark, f) == "{"]
    arrays = [f for f in files if f not in objects]
    if arrays:
        frames.append(spark.read.option("multiLine", "true").json(arrays))
    for f in objects:
        one = spark.read.option("multiLine", "true").json(f)
        kinds = [x.dataType for x in one.schema]
        frames.append(columnar_rows(one) if kinds and all(isinstance(k, T.ArrayType) for k in kinds) else one)
    out = union([flatten(f) if flat else f for f in frames])
    return out


def read_jsonl(spark: SparkSession, files: Sequence[str], flat: bool = True) -> DataFrame:
    """JSON Lines; blank lines are skipped."""
    df = spark.read.json(list(files))
    return flatten(df) if flat else df


def read_xml(spark: SparkSession, files: Sequence[str], row_tag: str | None = None) -> DataFrame:
    """XML documents. With ``row_tag`` Spark's splittable reader; without it each document is read whole (see xml_records)."""
    if row_tag:
        return flatten(spark.read.option("rowTag", row_tag).option("attributePrefix", "").option("valueTag", "_text").xml(",".join(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [json.dumps(r) for data in batch.column(0).to_pylist() for r in records(data)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["j"])

    listed = spark.read.format("binaryFile").load(list(files))
    if big := listed.where(F.col("length") > XML_WHOLE).select("path").head():
        raise ValueError(f"{big.path} is too large to be read whole: give its row tag")
    lines = listed.select("content").mapInArrow(run, "j string")
    names = columns_of(
        [{k: "" for k in r.k} for r in lines.select(F.json_object_keys("j").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()]
    )
    texts = lines.select(F.from_json("j", T.StructType([T.StructField(n, T.StringType()) for n in names])).alias("r")).select("r.*")
    return _typed_text(texts)


def _typed_text(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, fractions or booleans where all their non-empty cells are such."""
    checks = []
    for i, c in enumerate(df.columns):
        cell = F.nullif(F.trim(qcol(c)), F.lit(""))
        for kind, pattern in (("l", r"^[+-]?[0-9]{1,18}$"), ("d", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), ("b", "^(true|false)$")):
            checks.append(F.min(F.when(cell.isNotNull(), cell.rlike(pattern))).alias(f"{kind}{i}"))
    seen = df.agg(*checks).first() if checks else None
    out = []
    for i, c in enumerate(df.columns):
        cell = F.nullif(F.trim(qcol(c)), F.lit(""))
        kind = "bigint" if seen[f"l{i}"] else "double" if seen[f"d{i}"] else "boolean" if seen[f"b{i}"] else None
        out.append((cell.cast(kind) if kind else cell).alias(c))
    return df.select(*out)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table as a frame; nulls stay nulls, unsigned 64-bit numbers become decimals."""
    fields = [pa.field(f.name, pa.decimal128(20, 0)) if f.type == pa.uint64() else f for f in table.schema]
    return spark.createDataFrame(table.cast(pa.schema(fields)))


def read_arrow(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Arrow IPC files or streams."""
    from pyarrow import fs as pafs

    frames = []
    for f in files:
        system, at = pafs.FileSystem.from_uri(f) if P.is_remote(f) else (pafs.LocalFileSystem(), os.path.abspath(f))
        parts = [at]
        if system.get_file_info(at).type == pafs.FileType.Directory:
            parts = sorted(x.path for x in system.get_file_info(pafs.FileSelector(at)) if not x.base_name.startswith(("_", ".")))
        for part in parts:
            with system.open_input_file(part) as source:
                try:
                    table = pa.ipc.open_file(source).read_all()
                except pa.ArrowInvalid:
                    source.seek(0)
                    table = pa.ipc.open_stream(source).read_all()
                frames.append(from_arrow(spark, table))
    return union(frames)


def fetch(spark: SparkSession, url: str, timeout: float = 30.0) -> str:
    """A URL's content in the shared folder, under a name with the URL's ending."""
    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    ending = os.path.splitext(url.split("?")[0])[1]
    with urllib.request.urlopen(url, timeout=timeout) as got:
        if got.status != 200:
            raise OSError(f"{url}: status {got.status}")
        with tempfile.NamedTemporaryFile(dir=folder, suffix=ending, delete=False) as out:
            while data := got.read(1 << 20):
                out.write(data)
    return out.name


def _with_partitions(df: DataFrame, files: Sequence[str]) -> DataFrame:
    keys = list(dict.fromkeys(k for f in files for k in P.partition_values(f)))
    new = [k for k in keys if k not in df.columns]
    if not new:
        return df
    path = F.col("_metadata.file_path")
    out = df
    for k in new:
        text = F.url_decode(F.regexp_extract(path, f"/{k}=([^/]*)/", 1))
        out = out.withColumn(k, F.when((text == "") | (text == "__HIVE_DEFAULT_PARTITION__"), None).otherwise(text))
    return out


def _read(spark: SparkSession, fmt: str, files: list[str], schema, options: Options, row_tag: str | None) -> DataFrame:
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        parts = [f for f in files if P.partition_values(f)] if options.partition_columns else []
        if parts and len(parts) == len(files):
            groups = headers(spark, files)
            return union([_with_partitions(read_delimited(spark, g, sep, schema), g) for _, g in sorted(groups.items(), key=lambda x: x[1][0])])
        return _delimited(spark, files, sep, schema, options.sample_files)
    if fmt == "json":
        return read_json(spark, files)
    if fmt == "jsonl":
        return read_jsonl(spark, files)
    if fmt == "xml":
        return read_xml(spark, files, row_tag)
    if fmt == "arrow":
        return read_arrow(spark, files)
    base = P.partition_base(files[0]) if options.partition_columns else None
    reader = spark.read.option("mergeSchema", "true" if len(files) > 1 else "false")
    return (reader.option("basePath", base) if base else reader).parquet(*files)


def load(
    spark: SparkSession,
    source: str | Sequence[str],
    fmt: str | None = None,
    max_files: int | None = None,
    recursive: bool = True,
    schema: T.StructType | None = None,
    row_tag: str | None = None,
    options: Options = DEFAULT,
) -> DataFrame:
    """A table from a file, URL, comma list, directory or pattern.

    The format goes by the ending (unknown: CSV), or is ``fmt``.  Files of one format and header are
    one scan; files that differ are put together by column name, with missing columns null and types
    promoted.  ``key=value`` directories become columns, last (options.partition_columns).  ``schema``
    (delimited files) saves the pass that infers types.
    """
    if isinstance(source, str) and P.is_url(source):
        source = fetch(spark, source)
    plain = isinstance(source, str) and not P.has_wildcard(source) and (bool(P.format_of(source, "")) if P.is_remote(source) else not os.path.isdir(source))
    files = P.resolve(source, None if plain else fmt, max_files, recursive)
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(fmt if fmt and plain else P.format_of(f), []).append(f)
    frames = [_read(spark, k, g, schema, options, row_tag) for k, g in groups.items()]
    return union(frames) if len(frames) > 1 else frames[0]


def preview_schema(spark: SparkSession, source: str | Sequence[str], fmt: str | None = None, options: Options = DEFAULT) -> T.StructType:
    """The merged schema of the first three files."""
    return load(spark, P.resolve(source, fmt)[: options.sample_files or 3], options=options).schema


def read_lines(spark: SparkSession, lines: Sequence[str], fmt: str = "csv") -> DataFrame:
    """A table from text lines at hand, such as standard input, in a named format."""
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    if fmt in ("csv", "tsv"):
        reader = spark.read.options(**_CSV).option("sep", "," if fmt == "csv" else "\t")
        rdd = text.rdd.map(lambda r: r.value)
        seen = reader.option("inferSchema", "true").csv(rdd).schema
        return reader.schema(T.StructType([T.StructField(f.name, _simple(f.dataType)) for f in seen])).csv(rdd)
    if fmt == "jsonl":
        return flatten(spark.read.json(text.rdd.map(lambda r: r.value)))
    if fmt == "json":
        value = json.loads("\n".join(lines))
        if isinstance(value, dict) and value and all(isinstance(v, list) for v in value.values()):
            value = [dict(zip(value, row, strict=True)) for row in zip(*value.values(), strict=True)]
        return flatten(spark.read.json(spark.sparkContext.parallelize([json.dumps(v) for v in (value if isinstance(value, list) else [value])])))
    if fmt == "xml":
        return _typed_text(spark.createDataFrame([{**r} for r in records("\n".join(lines))]))
    raise ValueError(f"{fmt!r} can't be read from lines")
