"""The filter language: text such as ``amount > 100 AND (region = 'west' OR tags CONTAINS 'vip')``.

A filter is compiled, with the frame's schema at hand, into one native Column, so that predicates
reach the scan.  Comparisons are typed: numbers compare as numbers, dates with a quoted date as
dates, an array with a number as "any element", text with a number as number where the whole text is
one.  Paths (``a.b.c``) name a flat dotted column, a struct field or a place in JSON text, in that order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import qcol
from millrace.options import DEFAULT, Options


class FilterError(ValueError):
    """A filter that can't be read, or that names a column the frame hasn't got."""


@dataclass(frozen=True)
class Test:
    """A column, perhaps one element of it, against a literal."""

    path: str
    index: int | None
    op: str
    value: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op>!=|>=|<=|=|>|<|~)|(?P<mark>[()])"""
    r"""|(?P<name>[^\s()=!<>~'"\[\]]+)(?P<index>\[\d+\])?(?P<tail>(?:\.[^\s()=!<>~'"\[\]]+)?))"""
)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_ORDER: dict[str, Callable[[Column, object], Column]] = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _tokens(text: str) -> list[tuple[str, str, str | None, int]]:
    text = text.replace("\\!", "!").replace("\\ ", " ")
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"can't read the filter from: {text[at:].strip()!r}")
        kind = m.lastgroup if m.lastgroup in ("text", "op", "mark") else "name"
        if kind == "name":
            index = m["index"]
            name = m["name"] + (f"[{index[1:-1]}]" if index and m["tail"] else "") + (m["tail"] or "")
            out.append(("name", name, index[1:-1] if index and not m["tail"] else None, at))
        else:
            out.append((kind, m[kind], None, at))
        at = m.end()
    return out


def parse(text: str, options: Options = DEFAULT):
    """The filter's tree. AND binds tighter than OR (in compat mode the other way round)."""
    tokens = _tokens(text)
    if not tokens:
        raise FilterError("the filter is empty")
    at = 0

    def peek() -> tuple[str, str, str | None, int] | None:
        return tokens[at] if at < len(tokens) else None

    def take(expected: str) -> tuple[str, str, str | None, int]:
        nonlocal at
        if at >= len(tokens):
            raise FilterError(f"the filter ends where {expected} should follow")
        at += 1
        return tokens[at - 1]

    def chain(word: str, make, inner):
        def run():
            nonlocal at
            left = inner()
            while (t := peek()) and t[0] == "name" and t[1] == word:
                at += 1
                left = make(left, inner())
            return left

        return run

    def single():
        nonlocal at
        t = take("a condition")
        if t[0] == "mark" and t[1] == "(":
            inner = expression()
            if take("')'")[1] != ")":
                raise FilterError("a parenthesis isn't closed")
            return inner
        if t[0] != "name":
            raise FilterError(f"a column name should stand where {t[1]!r} stands")
        path, index = t[1], int(t[2]) if t[2] is not None else None
        op = take("an operator")
        if op[0] == "name" and op[1].upper() == "IS":
            word = take("NULL")
            negated = word[1].upper() == "NOT"
            if negated:
                word = take("NULL")
            if word[1].upper() != "NULL":
                raise FilterError("IS must be followed by NULL or NOT NULL")
            return Test(path, index, "notnull" if negated else "null", None)
        if op[0] == "name" and op[1] == "CONTAINS":
            return Test(path, index, "CONTAINS", literal(take("a value")))
        if op[1] == "~":
            raise FilterError("'~' has no meaning here; use CONTAINS with * and ?")
        if op[0] != "op":
            raise FilterError(f"an operator should stand where {op[1]!r} stands (AND, OR and CONTAINS are in capitals)")
        return Test(path, index, op[1], literal(take("a value")))

    def literal(t) -> object:
        if t[0] == "text":
            return re.sub(r"\\(['\"\\])", r"\1", t[1][1:-1])
        if t[0] == "name" and t[2] is None:
            if t[1] in ("true", "false"):
                return t[1] == "true"
            if _NUMBER.fullmatch(t[1]):
                return int(t[1]) if re.fullmatch(r"[+-]?\d+", t[1]) else float(t[1])
        raise FilterError(f"{t[1]!r} is no value: quote text")

    if options.compat:
        expression = chain("AND", Both, chain("OR", Either, single))
    else:
        expression = chain("OR", Either, chain("AND", Both, single))
    tree = expression()
    if at < len(tokens):
        raise FilterError(f"nothing should follow, but {tokens[at][1]!r} does")
    return tree


def wildcard_to_regex(pattern: str) -> str:
    """An anchored pattern for ``*``, ``?``, ``[...]`` and escapes; ``*`` and ``?`` stop at a slash."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif end > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] in "!^" else "") + re.sub(r"([\\\[&])", r"\\\1", body.lstrip("!^")) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def is_wildcard(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """The column a path names and its type; places in JSON text come out as text."""
    names = set(schema.fieldNames())
    if path in names:
        return qcol(path), schema[path].dataType
    parts = re.split(r"\.", path)
    for n in range(len(parts) - 1, 0, -1):
        base = ".".join(parts[:n])
        index = re.fullmatch(r"(.*)\[(\d+)\]", base)
        name = index[1] if index else base
        if name not in names:
            continue
        col, kind = qcol(name), schema[name].dataType
        if index:
            if not isinstance(kind, T.ArrayType):
                break
            col, kind = F.get(col, F.lit(int(index[2]))), kind.elementType
        return _inside(col, kind, parts[n:], path)
    raise FilterError(f"no column {path!r}; there are: {', '.join(schema.fieldNames())}")


def _inside(col: Column, kind: T.DataType, rest: list[str], path: str) -> tuple[Column, T.DataType]:
    for i, part in enumerate(rest):
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                raise FilterError(f"no field {part!r} in {path!r}")
            col, kind = col.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(part).cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.StringType):
            steps = "".join(f"['{p}']" for p in rest[i:])
            return F.get_json_object(col, "$" + steps), T.StringType()
        else:
            raise FilterError(f"{path!r} goes into a column of type {kind.simpleString()}")
    return col, kind


def _json_array(col: Column, element: str) -> Column:
    """Text that holds a JSON array, as an array; null for any other text."""
    return F.when(F.ltrim(col).startswith("["), F.from_json(col, f"array<{element}>"))


def _number(col: Column, kind: T.DataType, options: Options) -> Column:
    if isinstance(kind, T.StringType):
        if options.compat:
            col = F.nullif(F.regexp_extract(col, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit(""))
        return col.try_cast("double")
    return col


def _literal_number(value: object) -> float | int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    if isinstance(value, str) and _NUMBER.fullmatch(value.strip()):
        return float(value)
    return None


def _spelt(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _test(col: Column, kind: T.DataType, op: str, value: object, options: Options) -> Column:
    compare = _ORDER[op]
    number = _literal_number(value)
    if isinstance(kind, T.NumericType):
        if number is not None:
            return compare(col, F.lit(number))
        return compare(col.cast("string"), F.lit(_spelt(value)))
    if isinstance(kind, T.BooleanType):
        return compare(col, F.lit(value)) if isinstance(value, bool) else compare(col.cast("string"), F.lit(_spelt(value)))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        moment = F.lit(_spelt(value)).try_cast(kind)
        return compare(col, moment)
    if isinstance(kind, T.ArrayType):
        if op in ("=", "!="):
            return compare(F.to_json(col), F.lit(_spelt(value)))
        if number is None:
            return F.exists(col, lambda x: compare(x.cast("string"), F.lit(_spelt(value))))
        return F.exists(col, lambda x: compare(_number(x, kind.elementType, options), F.lit(number)))
    if isinstance(kind, T.StringType):
        as_text = compare(col, F.lit(_spelt(value)))
        if number is None:
            return as_text
        own = _number(col, kind, options)
        if op in ("=", "!="):
            return F.when(own.isNotNull(), compare(own, F.lit(float(number)))).otherwise(as_text)
        elements = _json_array(col, "double")
        found = F.exists(elements, lambda x: compare(x, F.lit(float(number))))
        not_object = ~F.ltrim(col).startswith("{")
        return F.when(own.isNotNull(), compare(own, F.lit(float(number)))).when(elements.isNotNull(), found).otherwise(as_text & not_object)
    return compare(col.cast("string"), F.lit(_spelt(value)))


def _contains(col: Column, kind: T.DataType, value: object) -> Column:
    if isinstance(value, str) and is_wildcard(value):
        pattern = wildcard_to_regex(value)
        if isinstance(kind, T.ArrayType):
            return F.exists(col, lambda x: x.cast("string").rlike(pattern))
        plain = col.cast("string").rlike(pattern)
        if isinstance(kind, T.StringType):
            elements = _json_array(col, "string")
            return F.when(elements.isNotNull(), F.exists(elements, lambda x: x.rlike(pattern))).otherwise(plain)
        return plain
    if isinstance(kind, T.ArrayType):
        return F.exists(col, lambda x: _test(x, kind.elementType, "=", value, DEFAULT))
    if isinstance(kind, T.StringType):
        elements = _json_array(col, "string")
        found = F.exists(elements, lambda x: _test(x, T.StringType(), "=", value, DEFAULT))
        return F.when(elements.isNotNull(), found).otherwise(_test(col, kind, "=", value, DEFAULT))
    return _test(col, kind, "=", value, DEFAULT)


def compile_filter(text: str, schema: T.StructType, options: Options = DEFAULT) -> Column:
    """The filter as a Column over frames of ``schema``. A comparison with null is unknown and keeps no row."""

    def build(tree) -> Column:
        if isinstance(tree, Both):
            return build(tree.left) & build(tree.right)
        if isinstance(tree, Either):
            return build(tree.left) | build(tree.right)
        col, kind = resolve(schema, tree.path)
        if tree.index is not None:
            if isinstance(kind, T.ArrayType):
                col, kind = F.get(col, F.lit(tree.index)), kind.elementType
            else:
                col, kind = F.get(_json_array(col.cast("string"), "string"), F.lit(tree.index)), T.StringType()
        if tree.op == "null":
            return col.isNull()
        if tree.op == "notnull":
            return col.isNotNull()
        if tree.op == "CONTAINS":
            return _contains(col, kind, tree.value)
        made = _test(col, kind, tree.op, tree.value, options)
        return made | col.isNull() if options.compat and tree.op == "!=" else made

    return build(parse(text, options))


def filter_rows(df: DataFrame, text: str, options: Options = DEFAULT) -> DataFrame:
    """The rows of ``df`` that the filter keeps."""
    return df.where(compile_filter(text, df.schema, options))


def describe_filter(text: str, options: Options = DEFAULT) -> str:
    """The filter's tree as JSON, for tools that show how a filter was read."""

    def plain(tree) -> object:
        if isinstance(tree, (Both, Either)):
            return {"and" if isinstance(tree, Both) else "or": [plain(tree.left), plain(tree.right)]}
        return {"column": tree.path, "index": tree.index, "op": tree.op, "value": tree.value}

    return json.dumps(plain(parse(text, options)))
