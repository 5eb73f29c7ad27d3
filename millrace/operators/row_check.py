"""Rows that fail to parse: told apart, with their reason, from rows that come out typed.

Each schema is turned into one anchored pattern for whole rows.  Rows it doesn't match go through
patterns of its first 1, 2, ... fields, which find the first broken field; a third set of patterns,
without the rules on values, tells broken form from invalid values.  All of it runs as regular
expressions inside the JVM; every quantifier is possessive, so long or hostile records can neither
backtrack nor exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value rules, without outer blanks.  No group captures, no quote or separator may match.
NUMBER = r"[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
_LOCAL = r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+"
_LABELS = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL = f"{_LOCAL}@{_LABELS}"


@dataclass(frozen=True)
class Field:
    """A field of a row; ``rule`` is a pattern for its non-empty values (None: anything), ``to`` its type."""

    name: str
    rule: str | None = None
    to: str = "string"


@dataclass(frozen=True)
class RowSchema:
    """The fields of a table's rows, in order, and the separator."""

    name: str
    fields: tuple[Field, ...]
    sep: str = ","

    def _free(self) -> str:
        quoted = '"[^"]*+(?:""[^"]*+)*+"'
        plain = f'(?!")[^{_escaped(self.sep)}]*+'
        return f"(?:{quoted}|{plain})"

    def _ruled(self, field: Field) -> str:
        if field.rule is None:
            return self._free()
        value = f" *+(?:{field.rule})?+ *+"
        return f'(?:"{value}"|{value}(?![^{_escaped(self.sep)}]))'

    def prefix(self, n: int, values: bool = True) -> str:
        """Pattern for records whose first ``n`` fields are sound and end at a separator or the record's end."""
        sep = _escaped(self.sep)
        parts = [self._ruled(f) if values else self._free() for f in self.fields[:n]]
        return r"\A" + sep.join(parts) + rf"(?={sep}|\z)"

    def whole(self, capture: bool = False) -> str:
        """Pattern for whole sound rows; with ``capture``, a group for each field."""
        parts = [self._ruled(f) for f in self.fields]
        if capture:
            parts = [f"({x})" for x in parts]
        return r"\A" + _escaped(self.sep).join(parts) + r"\z"


def _escaped(sep: str) -> str:
    return {"\t": r"\t"}.get(sep, "\\" + sep)


def _reason(text: Column, schema: RowSchema) -> tuple[Column, Column]:
    """The first broken field and what is wrong with it, for a row that isn't sound."""
    sep, n = _escaped(schema.sep), len(schema.fields)
    broken = F.lit("")
    why = F.lit("extra_fields")
    for k in range(n, 0, -1):
        formed = text.rlike(schema.prefix(k, values=False))
        # the record ends before field k when all before it is sound and nothing follows
        ended = text.rlike(schema.prefix(k - 1, values=False)[: -len(rf"(?={sep}|\z)")] + r"\z") if k > 1 else F.lit(False)
        kind = F.when(ended, "missing_field").when(~formed, "broken_quoting").otherwise("invalid_value")
        sound = text.rlike(schema.prefix(k))
        broken = F.when(sound, broken).otherwise(F.lit(schema.fields[k - 1].name))
        why = F.when(sound, why).otherwise(kind)
    return broken, why


def check_rows(df: DataFrame, text: str, table: str | None, schemas: Sequence[RowSchema]) -> DataFrame:
    """``df`` with ``row_ok``, ``broken_field`` and ``reason``.

    ``table`` names the column that says which schema a record is meant for (None: the only schema).
    reason is null for sound rows, else ``null_record``, ``unknown_table``, ``broken_quoting``,
    ``missing_field``, ``extra_fields`` or ``invalid_value``; broken_field is the first field that
    fails, ``""`` for extra fields, null where no field can be named.  A null record fails, an empty
    one has a single empty field.  Repeated records are judged one by one.  A record is judged whole
    whatever its length; line breaks within a field are text.
    """
    record = F.col(text)
    chosen = [F.lit(True) if table is None else F.coalesce(F.col(table) == s.name, F.lit(False)) for s in schemas]
    ok, field, reason = F.lit(False), F.lit(None).cast("string"), F.lit("unknown_table")
    for s, mine in zip(schemas, chosen, strict=True):
        broken, why = _reason(record, s)
        sound = record.rlike(s.whole())
        ok = F.when(mine, sound).otherwise(ok)
        field = F.when(mine, F.when(sound, F.lit(None)).otherwise(broken)).otherwise(field)
        reason = F.when(mine, F.when(sound, F.lit(None)).otherwise(why)).otherwise(reason)
    null = record.isNull()
    return df.withColumns(
        {
            "row_ok": F.when(null, F.lit(False)).otherwise(ok),
            "broken_field": F.when(null, F.lit(None)).otherwise(field),
            "reason": F.when(null, F.lit("null_record")).otherwise(reason),
        }
    )


def rejected(df: DataFrame, text: str, table: str | None, schemas: Sequence[RowSchema]) -> DataFrame:
    """The records that fail, with ``broken_field`` and ``reason`` (see check_rows)."""
    return check_rows(df, text, table, schemas).where(~F.col("row_ok")).drop("row_ok")


def typed(df: DataFrame, text: str, schema: RowSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The sound records of one schema as typed columns, after the columns ``keep``.

    Quotes around a field are removed and inner ones undoubled; an empty or blank field is null;
    fields with a rule lose their outer blanks before the cast, which gives null where the value has
    no such type.
    """
    record = F.col(text)
    pattern = schema.whole(capture=True)
    rows = df.where(record.rlike(schema.whole())).select(*[F.col(k) for k in keep], record.alias("_record"))
    out = []
    for i, f in enumerate(schema.fields, start=1):
        cell = F.regexp_extract("_record", pattern, i)
        bare = F.when(
            cell.startswith('"'), F.replace(cell.substr(F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(cell)
        value = F.when(F.trim(bare) != "", F.trim(bare) if f.rule else bare)
        out.append((value if f.to == "string" else value.try_cast(f.to)).alias(f.name))
    return rows.select(*[F.col(k) for k in keep], *out)


SALES = RowSchema("sales", (Field("customer"), Field("region"), Field("product"), Field("amount", NUMBER, "double"), Field("date")))
CUSTOMERS = RowSchema("customers", (Field("customer"), Field("email", EMAIL), Field("tier"), Field("signup_date")))
