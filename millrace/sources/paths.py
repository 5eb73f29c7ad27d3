"""From a source text (file, comma list, directory, pattern) to the files it stands for."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

#: Formats by file ending.
ENDINGS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xml": "xml", ".parquet": "parquet", ".arrow": "arrow", ".ipc": "arrow"}
#: Endings that a directory is searched for.
_SEARCHED = (".csv", ".tsv", ".json", ".jsonl", ".xml", ".parquet")


def has_wildcard(source: str) -> bool:
    return any(c in source for c in "*?[")


def is_url(source: str) -> bool:
    return source.startswith(("http://", "https://"))


def format_of(path: str, default: str = "csv") -> str:
    """The format a file's ending names, in any case; unknown endings mean CSV."""
    return ENDINGS.get(os.path.splitext(path.rstrip("/"))[1].lower(), default)


def is_dataset(path: str) -> bool:
    """Whether a directory is one stored table (Spark's output) rather than a folder of files."""
    return os.path.isdir(path) and os.path.splitext(path.rstrip("/"))[1].lower() in ENDINGS


def _hidden(path: str) -> bool:
    return os.path.basename(path).startswith(("_", "."))


def _walk(folder: str, recursive: bool) -> list[str]:
    out = []
    for at, dirs, names in os.walk(folder):
        dirs[:] = [d for d in dirs if not d.startswith(("_", "."))] if recursive else []
        out += [os.path.join(at, n) for n in names if os.path.splitext(n)[1].lower() in _SEARCHED and not _hidden(n)]
    return out


def is_remote(source: str) -> bool:
    """Whether a source lies on a file system that is named by a scheme, and isn't a URL."""
    return "://" in source and not is_url(source)


def pattern_of(source: str) -> re.Pattern[str]:
    """The shell's rules for a path as a pattern: ``**`` for any depth, ``*`` and ``?`` within a name, ``[...]`` for one sign."""
    out, i = "", 0
    while i < len(source):
        if source.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif source.startswith("**", i):
            out, i = out + ".*", i + 2
        elif source[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif source[i] == "?":
            out, i = out + "[^/]", i + 1
        elif source[i] == "[" and "]" in source[i + 2 :]:
            end = source.index("]", i + 2)
            some = source[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^" + some[1:] if some[0] == "!" else "[" + some) + "]", end + 1
        else:
            out, i = out + re.escape(source[i]), i + 1
    return re.compile(out)


def _plain(path: str) -> str:
    """A path in one spelling, whatever number of slashes follows the scheme."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def remote_files(source: str, recursive: bool) -> list[str]:
    """The files of a remote file, folder or pattern, listed by Spark (in parallel where there are many); stored tables count as one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{source} needs a session")
    wild = has_wildcard(source)
    base = source.rstrip("/")
    if wild:
        base = source[: re.search(r"[*?\[]", source).start()].rsplit("/", 1)[0]
    elif format_of(base, ""):
        return [base]  # a file or a stored table
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).inputFiles()
    found = set()
    root = _plain(base)
    for path in listed:
        parts = _plain(path)[len(root) :].strip("/").split("/")
        at = next((i for i, part in enumerate(parts[:-1]) if format_of(part, "")), len(parts) - 1)
        inner = "/".join(parts[: at + 1])
        if wild:
            if pattern_of(_plain(source)).fullmatch(f"{root}/{inner}"):
                found.add(f"{base}/{inner}")
        elif (recursive or at == 0) and os.path.splitext(inner)[1].lower() in _SEARCHED:
            found.add(f"{base}/{inner}")
    return sorted(found)


def resolve(source: str | Sequence[str], fmt: str | None = None, max_files: int | None = None, recursive: bool = True) -> list[str]:
    """The files of a source, sorted, each once.

    Paths with a scheme go to the file system that Spark knows by it, all others to local disks.  A
    comma list is resolved part by part; a directory is searched (below it too, if ``recursive``)
    for known endings; a pattern follows the shell's rules, with ``**`` for any depth; a directory
    with a format's ending is one stored table.  ``fmt`` keeps that format's files only.  More files
    than ``max_files``, and none at all, are errors.
    """
    if not isinstance(source, str):
        found = [p for part in source for p in resolve(part, None, None, recursive)]
    elif "," in source and not os.path.exists(source) and not is_url(source):
        found = [p for part in source.split(",") if part.strip() for p in resolve(part.strip(), None, None, recursive)]
    elif is_remote(source):
        found = remote_files(source, recursive)
    elif is_dataset(source):
        found = [source]
    elif os.path.isdir(source):
        found = _walk(source, recursive)
    elif has_wildcard(source):
        found = [p for p in glob.glob(source, recursive=True) if os.path.isfile(p) or is_dataset(p)]
    elif os.path.exists(source) or "://" in source:
        found = [source]
    else:
        raise FileNotFoundError(f"no such file: {source}")
    files = sorted(set(found))
    if fmt:
        files = [f for f in files if format_of(f, "") == fmt]
    if not files:
        raise FileNotFoundError(f"no files match {source!r}" + (f" with format {fmt!r}" if fmt else ""))
    if max_files is not None and len(files) > max_files:
        raise ValueError(f"{len(files)} files match {source!r}; at most {max_files} are allowed")
    return files


def partition_base(source: str) -> str | None:
    """For a source with ``key=value`` directories, the directory above the first of them."""
    parts = source.split("/")
    for i, p in enumerate(parts[:-1]):
        if "=" in p and not p.startswith("="):
            return "/".join(parts[:i]) or "/"
    return None


def partition_values(path: str) -> dict[str, str | None]:
    """The ``key=value`` pairs in a path's directories."""
    from urllib.parse import unquote

    out: dict[str, str | None] = {}
    for p in path.split("/")[:-1]:
        key, eq, value = p.partition("=")
        if eq and key:
            out[key] = None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)
    return out
