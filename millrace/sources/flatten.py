"""Nested columns as flat ones with dotted names, and back to JSON text for flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import qcol


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become columns named by their path (``address.city``); arrays and maps stay as they are."""

    def walk(col: Column, name: str, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType) and kind.fields:
            return [c for f in kind for c in walk(col.getField(f.name), f"{name}.{f.name}", f.dataType)]
        return [col.alias(name)]

    if not any(isinstance(f.dataType, T.StructType) for f in df.schema):
        return df
    return df.select(*[c for f in df.schema for c in walk(qcol(f.name), f.name, f.dataType)])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text; binary as base64."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(qcol(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.BinaryType):
            out.append(F.base64(qcol(f.name)).alias(f.name))
        else:
            out.append(qcol(f.name))
    return df.select(*out)


def columnar_rows(df: DataFrame) -> DataFrame:
    """An object of equally long arrays as rows: each key a column, each position a row."""
    names = df.columns
    sizes = [F.size(qcol(n)) for n in names]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = F.when(same, F.arrays_zip(*[qcol(n) for n in names])).otherwise(F.raise_error(F.lit("the columns of a columnar JSON object differ in length")))
    rows = df.select(F.explode(checked).alias("_r"))
    return rows.select(*[F.col("_r").getField(n).alias(n) for n in names])
