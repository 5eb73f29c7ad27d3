"""Text normalisation as JVM expressions, with twins for code that runs in Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of a clean key: blank, tab, no-break space and its figure and narrow forms.
BLANKS = " \\t\\u00a0\\u2007\\u202f"
_PY_BLANKS = re.compile("[ \\t\\u00a0\\u2007\\u202f]+")


def clean_key(value: Column | str) -> Column:
    """Lower case, outer white space removed, inner runs made one blank; an empty result is null."""
    col = F.col(value) if isinstance(value, str) else value
    spaced = F.regexp_replace(col, f"[{BLANKS}]+", " ")
    return F.nullif(F.lower(F.trim(spaced)), F.lit(""))


def clean_key_py(value: str | None) -> str | None:
    """``clean_key`` for one Python string."""
    if value is None:
        return None
    return _PY_BLANKS.sub(" ", value).strip(" ").lower() or None


def qcol(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
