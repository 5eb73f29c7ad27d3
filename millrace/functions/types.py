"""Which type two columns of one name become when tables are put together."""

from __future__ import annotations

from pyspark.sql import types as T

_ORDER = (T.BooleanType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType), T.StringType)


def rank(kind: T.DataType) -> int | None:
    """Place in the order bool < whole number < fraction < text; None for other types."""
    for i, group in enumerate(_ORDER):
        if isinstance(kind, group):
            return i
    return None


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider of two scalars, element by element in arrays and structs, else text."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(promote(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = [T.StructField(f.name, promote(f.dataType, b[f.name].dataType) if f.name in b.fieldNames() else f.dataType) for f in a]
        return T.StructType(fields + [f for f in b if f.name not in a.fieldNames()])
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
        return T.DecimalType(min(38, whole + scale), scale)
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    ranks = (rank(a), rank(b))
    if None in ranks:
        return T.StringType()
    top = max(ranks)
    if top == 1:
        return T.LongType()
    if top == 2:
        return T.DoubleType()
    return T.StringType() if top == 3 else T.BooleanType()
