"""Records from XML documents without a known row tag.

A document is read into plain values: attributes and child elements are fields, repeated children
arrays, an element with nothing but text its text, and text beside other content the field
``_text``.  Every array element becomes a row of its own, with the scalar fields around it copied;
columns are named by the path below the root, with dots.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def plain(element: ET.Element) -> object:
    """An element as text, or as a dict of fields."""
    text = (element.text or "").strip()
    tails = " ".join(t for c in element if (t := (c.tail or "").strip()))
    text = f"{text} {tails}".strip() if tails else text
    fields: dict[str, object] = {_local(k): v for k, v in element.attrib.items()}
    for child in element:
        name, value = _local(child.tag), plain(child)
        if name not in fields:
            fields[name] = value
        elif isinstance(fields[name], list):
            fields[name].append(value)
        else:
            fields[name] = [fields[name], value]
    if not fields:
        return text
    if text:
        fields["_text"] = text
    return fields


def _rows(value: object, path: str) -> list[dict[str, str]]:
    """The rows of a value: one for each element of each array in it, with the scalars around copied to all."""
    if not isinstance(value, dict):
        return [{path or "value": value}]
    scalars: dict[str, str] = {}
    repeated: list[dict[str, str]] = []
    for key, inner in value.items():
        below = [row for item in (inner if isinstance(inner, list) else [inner]) for row in _rows(item, f"{path}.{key}" if path else key)]
        if isinstance(inner, list) or len(below) > 1:
            repeated += below
        elif below:
            scalars |= below[0]
    return [scalars | row for row in repeated] or ([scalars] if scalars else [])


def records(document: str | bytes) -> list[dict[str, str]]:
    """The flat records of one document, in columns named by the path below the root; values are text."""
    return _rows(plain(ET.fromstring(document)), "")


def columns_of(rows: Iterable[dict[str, str]]) -> list[str]:
    """All keys in the order in which they are first seen."""
    return list(dict.fromkeys(k for r in rows for k in r))


def row_tag(document: str) -> str | None:
    """The tag that repeats below the root, if there is one: what the splittable reader needs."""
    root = ET.fromstring(document)
    while len(root) == 1 and len(root[0]):
        root = root[0]
    tags = [_local(c.tag) for c in root]
    return max(set(tags), key=tags.count) if tags else None
