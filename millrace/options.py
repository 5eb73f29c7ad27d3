"""Settings shared by the pipeline operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """How loosely values are read.

    compat: treat text the way a schemaless text pipeline does (numeric prefixes, nulls
        that equal nulls in joins, OR binding tighter than AND); off by default.
    case_sensitive: whether column names are matched exactly.
    partition_columns: whether ``key=value`` directories become columns.
    sample_files: how many files the merged schema is taken from (None: all of them).
    """

    compat: bool = False
    case_sensitive: bool = True
    partition_columns: bool = True
    sample_files: int | None = None


DEFAULT = Options()
