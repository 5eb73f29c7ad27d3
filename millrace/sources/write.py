"""Storing tables in any known format."""

from __future__ import annotations

import io
import json
import os
import shutil
import sys
import uuid
from typing import BinaryIO, TextIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from millrace.sources.flatten import nested_to_json
from millrace.sources.paths import format_of, is_remote

_FLAT = {"header": "true", "emptyValue": "", "nullValue": "", "quote": '"', "escape": '"'}


def _sink(path: str):
    """A binary file to write, on any file system pyarrow knows."""
    if is_remote(path):
        system, at = pafs.FileSystem.from_uri(path)
        return system.open_output_stream(at, compression=None)
    return open(path, "wb")


def _only_part(spark, folder: str, path: str) -> None:
    """Makes the one file of a written folder the file ``path``."""
    if is_remote(path):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        parts = [s.getPath() for s in system.listStatus(hadoop(folder)) if s.getPath().getName().startswith("part-")]
        system.delete(hadoop(path), True)
        if parts:
            system.rename(parts[0], hadoop(path))
        else:
            system.create(hadoop(path)).close()
        system.delete(hadoop(folder), True)
        return
    part = next((n for n in sorted(os.listdir(folder)) if n.startswith("part-")), None)
    if part is not None:
        os.replace(os.path.join(folder, part), path)
    else:
        open(path, "w").close()
    shutil.rmtree(folder)


def write_json_array(df: DataFrame, path: str, indent: int = 2) -> None:
    """One pretty array of objects. Rows pass the driver one partition at a time: for large results use jsonl."""
    with _sink(path) as raw, io.TextIOWrapper(raw, encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            pretty = json.dumps(json.loads(row), indent=indent, ensure_ascii=False)
            out.write(("," if i else "") + "\n" + "\n".join(" " * indent + x for x in pretty.split("\n")))
        out.write("\n]\n")


def write_arrow(df: DataFrame, path: str) -> None:
    """An Arrow IPC stream. Rows pass the driver: for large results use parquet."""
    table = df.toArrow()
    with _sink(path) as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)


def print_arrow(df: DataFrame, out: BinaryIO | None = None) -> None:
    """An Arrow IPC stream on standard output."""
    table = df.toArrow()
    with pa.ipc.new_stream(out or sys.stdout.buffer, table.schema) as stream:
        stream.write_table(table)


def store(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "overwrite",
    single_file: bool = False,
    codec: str = "snappy",
    row_group_bytes: int | None = None,
    partition_by: list[str] | None = None,
    root: str = "root",
    record: str = "record",
) -> None:
    """Writes ``df`` in the format of the path's ending (or ``fmt``).

    csv, tsv, jsonl, xml and parquet are written by the executors, a file a partition, into a folder
    of that name; ``single_file`` makes one file of it.  json (one array) and arrow (one stream) are
    always one file.  Nested columns are JSON text in flat files and XML; null is an empty field.
    """
    fmt = fmt or format_of(path)
    if fmt == "json":
        return write_json_array(df, path)
    if fmt == "arrow":
        return write_arrow(df, path)
    flat = nested_to_json(df) if fmt in ("csv", "tsv") else df
    out = (flat.coalesce(1) if single_file else flat).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    target = f"{path}.{uuid.uuid4().hex}.tmp" if single_file else path
    if fmt in ("csv", "tsv"):
        out.options(**_FLAT).option("sep", "," if fmt == "csv" else "\t").csv(target)
    elif fmt == "jsonl":
        out.json(target)
    elif fmt == "xml":
        out.option("rootTag", root).option("rowTag", record).option("attributePrefix", "@").xml(target)
    elif fmt == "parquet":
        if row_group_bytes:
            out = out.option("parquet.block.size", str(row_group_bytes))
        out.option("compression", codec).parquet(target)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if single_file:
        _only_part(df.sparkSession, target, path)
    return None


def print_csv(df: DataFrame, out: TextIO | None = None) -> None:
    """CSV on standard output, a partition at a time."""
    import csv

    flat = nested_to_json(df)
    writer = csv.writer(out or sys.stdout, lineterminator="\n")
    writer.writerow(flat.columns)
    for row in flat.toLocalIterator():
        writer.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
