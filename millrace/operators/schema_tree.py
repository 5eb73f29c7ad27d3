"""Edit scripts between nested schemas.

A schema is a tree of named, typed nodes whose children have no order.  The cheapest way from one
tree to another is found level by level: the children of two matched nodes are paired by a
minimum-cost assignment, in which a child may also be deleted or added with its whole subtree; a
deleted and an added subtree that are alike become one move.  A script compiles into a projection
that reads data of the one schema as the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RENAME, RETYPE, MOVE, FORBIDDEN = 0.5, 0.3, 0.6, 1e6


@dataclass(frozen=True)
class Node:
    """A named part of a schema. ``means`` says which known field it holds, if that is known."""

    name: str
    kind: str = "struct"
    children: tuple[Node, ...] = ()
    means: str | None = None

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)


@dataclass(frozen=True)
class Edit:
    """One step: added, removed, renamed, retyped or moved; paths are dotted names, None where there is none."""

    what: str
    old: str | None
    new: str | None
    old_kind: str | None = None
    new_kind: str | None = None
    means: str | None = None


@dataclass
class Script:
    """The steps, their cost, and which new path each kept old path became."""

    edits: list[Edit] = field(default_factory=list)
    cost: float = 0.0
    kept: dict[str, str] = field(default_factory=dict)


def assign(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column for each row of a square matrix that makes the total least (shortest augmenting paths)."""
    n = len(cost)
    row_price, col_price, owner = [0.0] * n, [0.0] * n, [-1] * n
    for start in range(n):
        dist, via, done = [float("inf")] * n, [-1] * n, [False] * n
        row, base, col = start, 0.0, -1
        while True:
            nearest = -1
            for j in range(n):
                if not done[j]:
                    d = base + cost[row][j] - row_price[row] - col_price[j]
                    if d < dist[j]:
                        dist[j], via[j] = d, col
                    if nearest < 0 or dist[j] < dist[nearest]:
                        nearest = j
            col, base = nearest, dist[nearest]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        for j in range(n):
            if done[j] and j != col:
                row_price[owner[j]] += base - dist[j]
                col_price[j] -= base - dist[j]
        row_price[start] += base
        while col >= 0:
            before = via[col]
            owner[col] = owner[before] if before >= 0 else start
            col = before
    out = [0] * n
    for j, i in enumerate(owner):
        out[i] = j
    return out


def _label_cost(a: Node, b: Node) -> float:
    if a.means != b.means:
        return FORBIDDEN
    if bool(a.children) != bool(b.children):
        return FORBIDDEN
    cost = 0.0 if a.kind == b.kind or a.children else RETYPE
    if a.name != b.name:
        if a.means is not None:
            cost += RENAME
        else:
            alike = SequenceMatcher(None, a.name.lower(), b.name.lower()).ratio()
            inner = {c.name for c in a.children} & {c.name for c in b.children}
            cost += RENAME + (0.0 if inner else 2.0 * (1.0 - alike))
    return cost


@lru_cache(maxsize=100_000)
def _pair(a: Node, b: Node) -> tuple[float, tuple[tuple[int, int], ...]]:
    """Cost of turning a into b, and how their children pair up."""
    cost = _label_cost(a, b)
    if cost >= FORBIDDEN or not (a.children or b.children):
        return cost, ()
    more, pairs = _children(a.children, b.children)
    return cost + more, pairs


def _children(old: tuple[Node, ...], new: tuple[Node, ...], pair: Callable[[Node, Node], tuple] = _pair) -> tuple[float, tuple[tuple[int, int], ...]]:
    n, m = len(old), len(new)
    matrix = []
    for i in range(n + m):
        if i < n:
            removal = [float(old[i].size) if k == i else FORBIDDEN for k in range(n)]
            matrix.append([pair(old[i], b)[0] for b in new] + removal)
        else:
            matrix.append([float(new[j].size) if j == i - n else FORBIDDEN for j in range(m)] + [0.0] * n)
    chosen = assign(matrix)
    total = sum(matrix[i][j] for i, j in enumerate(chosen))
    return total, tuple((i, chosen[i]) for i in range(n) if chosen[i] < m)


def edit_script(old: Node, new: Node, leaf_cost: Callable[[Node, Node], float] | None = None) -> Script:
    """The cheapest script from ``old`` to ``new``; their roots are taken as the same.

    ``leaf_cost`` says what it costs to turn one leaf into another, where more is known than names and
    kinds; adding and deleting a leaf costs 1 each.  Empty schemas are fine: everything is then added or removed.  Names are compared exactly; give
    normalised ones where spelling must not matter.  Of equally named siblings each is its own node.
    """
    script = Script()
    pair = _pair if leaf_cost is None else lambda a, b: (leaf_cost(a, b), ()) if not (a.children or b.children) else _pair(a, b)
    gone: list[tuple[str, Node]] = []
    came: list[tuple[str, Node]] = []

    def keep(a: Node, b: Node, at_a: str, at_b: str, moved: bool) -> None:
        script.kept[at_a] = at_b
        if moved:
            script.edits.append(Edit("moved", at_a, at_b, means=b.means))
        if a.name != b.name:
            script.edits.append(Edit("renamed", at_a, at_b, means=b.means))
        if a.kind != b.kind and not a.children:
            script.edits.append(Edit("retyped", at_a, at_b, a.kind, b.kind, b.means))
        below(a.children, b.children, pair(a, b)[1], at_a + ".", at_b + ".")

    def below(olds, news, pairs, at_a: str, at_b: str) -> None:
        left, right = {i for i, _ in pairs}, {j for _, j in pairs}
        for i, j in pairs:
            keep(olds[i], news[j], at_a + olds[i].name, at_b + news[j].name, False)
        gone.extend((at_a + a.name, a) for i, a in enumerate(olds) if i not in left)
        came.extend((at_b + b.name, b) for j, b in enumerate(news) if j not in right)

    script.cost, pairs = _children(old.children, new.children, pair)
    below(old.children, new.children, pairs, "", "")
    options = sorted(
        (cost, i, j)
        for i, (_, a) in enumerate(gone)
        for j, (_, b) in enumerate(came)
        if (cost := MOVE + pair(a, b)[0]) < 0.6 * (a.size + b.size)
    )
    used_a: set[int] = set()
    used_b: set[int] = set()
    moves = []
    for cost, i, j in options:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            moves.append((i, j))
            script.cost += cost - gone[i][1].size - came[j][1].size
    lost = [x for i, x in enumerate(gone) if i not in used_a]
    found = [x for j, x in enumerate(came) if j not in used_b]
    pending = [(gone[i], came[j]) for i, j in moves]
    gone, came = [], []
    for (at_a, a), (at_b, b) in pending:
        keep(a, b, at_a, at_b, True)
    for at, a in lost + gone:
        script.edits.append(Edit("removed", at, None, a.kind, None, a.means))
    for at, b in found + came:
        script.edits.append(Edit("added", None, at, None, b.kind, b.means))
    return script


def tree_of(schema: T.StructType) -> Node:
    """The tree of a Spark schema; arrays of structs count as their element, marked in the kind."""

    def node(name: str, kind: T.DataType) -> Node:
        if isinstance(kind, T.StructType):
            return Node(name, "struct", tuple(node(f.name, f.dataType) for f in kind))
        return Node(name, kind.simpleString())

    return Node("", "struct", tuple(node(f.name, f.dataType) for f in schema))


def compile_projection(source: T.StructType, target: T.StructType) -> list[Column]:
    """Columns that read data of ``source`` as ``target``, along the script between them.

    Values whose type changed are cast where that is possible, else null; added fields are null.
    """
    kept = {new: old for old, new in edit_script(tree_of(source), tree_of(target)).kept.items()}

    def at(path: str) -> Column:
        return F.col(".".join(f"`{p}`" for p in path.split(".")))

    def build(name: str, kind: T.DataType, path: str) -> Column:
        origin = kept.get(path)
        if isinstance(kind, T.StructType) and kind.fields:
            inner = F.struct(*[build(f.name, f.dataType, f"{path}.{f.name}") for f in kind])
            made = F.when(at(origin).isNotNull(), inner) if origin is not None else inner
            return made.cast(kind).alias(name)
        if origin is None:
            return F.lit(None).cast(kind).alias(name)
        return (at(origin).try_cast(kind) if not isinstance(kind, (T.ArrayType, T.MapType)) else at(origin).cast(kind)).alias(name)

    return [build(f.name, f.dataType, f.name) for f in target]


_WIDER = {"boolean": 0, "tinyint": 1, "smallint": 1, "int": 1, "bigint": 1, "float": 2, "double": 2, "string": 9}


def _joint(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_schemas([a, b])
    ranks = [_WIDER.get(x.simpleString()) for x in (a, b)]
    if None in ranks or max(ranks) == 9:
        return T.StringType()
    return {0: T.BooleanType(), 1: T.LongType(), 2: T.DoubleType()}[max(ranks)]


def merge_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    """One schema for all: later names win for renamed fields, types widen, no field is lost."""
    merged = schemas[0]
    for nxt in schemas[1:]:
        script = edit_script(tree_of(merged), tree_of(nxt))
        renamed = {old: new for old, new in script.kept.items() if "." not in old and "." not in new}
        out = [T.StructField(renamed.get(f.name, f.name), _joint(f.dataType, nxt[renamed[f.name]].dataType) if f.name in renamed else f.dataType) for f in merged]
        names = {f.name for f in out}
        out += [T.StructField(f.name, f.dataType) for f in nxt if f.name not in names]
        merged = T.StructType(out)
    return merged


def unify(frames: Sequence[DataFrame]) -> tuple[DataFrame, list[list[Edit]]]:
    """All rows of frames with drifting schemas as one table, and the edits from each frame to the next."""
    if not frames:
        raise ValueError("unify needs at least one frame")
    target = merge_schemas([f.schema for f in frames])
    out = frames[0].select(*compile_projection(frames[0].schema, target))
    for f in frames[1:]:
        out = out.unionByName(f.select(*compile_projection(f.schema, target)))
    steps = [edit_script(tree_of(a.schema), tree_of(b.schema)).edits for a, b in zip(frames, frames[1:], strict=False)]
    return out, steps
