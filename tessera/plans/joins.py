"""Join paths over the key graph: enumeration, ranking, join kinds, and the fan-out that they cause."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from itertools import product

from .catalog import Catalog, ForeignKey
from .spec import Refusal

#: How far an edge is trusted, by its origin.
EDGE_RANK = {"declared": 0, "same_name": 1, "suffix": 2, "prefix": 3, "composite": 4, "step_key": 5, "overlap": 11}
MOST_CANDIDATES, MOST_TIES = 16, 64


@dataclass(frozen=True)
class Edge:
    """An equi-join of two tables; ``multiplies`` tells whether a left row can meet several right ones."""

    left: str
    right: str
    on: tuple  # of (left column, right column)
    kind: str  # inner or left
    multiplies: bool
    origin: str = "declared"

    @property
    def signature(self) -> str:
        return f"{self.left}.{','.join(a for a, _ in self.on)}->{self.right}.{','.join(b for _, b in self.on)}"


def edge(catalog: Catalog, key: ForeignKey, left: str) -> Edge:
    """The edge of a key as seen from ``left``; a nullable key keeps its rows by a left join."""
    child = left == key.table
    right = key.parent if child else key.table
    on = tuple(zip(key.columns, key.parent_columns, strict=True)) if child else tuple(zip(key.parent_columns, key.columns, strict=True))
    optional = child and any(catalog.tables[key.table].columns[c].nullable for c in key.columns)
    multiplies = not catalog.unique(right, tuple(b for _, b in on)) if not child else not catalog.unique(key.parent, key.parent_columns)
    return Edge(left, right, on, "left" if optional else "inner", multiplies, key.origin)


def neighbours(catalog: Catalog, table: str) -> list[Edge]:
    own = [k for k in catalog.foreign_keys if table in (k.table, k.parent) and k.table != k.parent]
    return sorted((edge(catalog, k, table) for k in own), key=lambda e: (EDGE_RANK.get(e.origin, 9), e.signature))


def shortest_paths(catalog: Catalog, start: str, goal: str, through: set[str] | None = None) -> list[tuple[Edge, ...]]:
    """All paths of the least length from ``start`` to ``goal``; with ``through``, over these tables only."""
    found, best, queue = [], None, deque([(start, ())])
    while queue:
        at, path = queue.popleft()
        if best is not None and len(path) >= best:
            break
        for e in neighbours(catalog, at):
            if e.right == start or any(e.right == p.right for p in path) or (through is not None and e.right not in through):
                continue
            longer = (*path, e)
            if e.right == goal:
                best = len(longer)
                found.append(longer)
                if len(found) > MOST_TIES:
                    raise Refusal(f"more than {MOST_TIES} join paths tie between {start} and {goal}")
            elif best is None:
                queue.append((e.right, longer))
    return found


def candidates(catalog: Catalog, anchor: str, tables: list[str]) -> list[tuple[Edge, ...]]:
    """Join trees from ``anchor`` that reach all ``tables``, best first: one shortest path for each, in every combination.

    Tables that the query does not name are crossed only where those it names are not connected by themselves.
    """
    choices = []
    for goal in tables:
        if goal != anchor:
            paths = shortest_paths(catalog, anchor, goal, set(tables)) or shortest_paths(catalog, anchor, goal)
            if not paths:
                raise Refusal(f"no join path between {anchor} and {goal}: a cross product of unrelated tables")
            choices.append(paths)
    trees: dict[tuple, tuple[Edge, ...]] = {}
    total = 1
    for c in choices:
        total *= len(c)
        if total > MOST_TIES * MOST_CANDIDATES:
            raise Refusal("too many combinations of join paths")
    for pick in product(*choices):
        edges: dict[str, Edge] = {}
        clash = False
        for path in pick:
            for e in path:
                if edges.setdefault(e.right, e) != e:
                    clash = True
        if not clash:
            tree = tuple(edges.values())
            trees[tuple(sorted(e.signature for e in tree))] = tree
    ordered = sorted(trees.values(), key=rank)
    if not ordered and choices:
        raise Refusal("the join paths contradict each other")
    if len(ordered) > MOST_CANDIDATES:
        raise Refusal(f"more than {MOST_CANDIDATES} join candidates: name the path")
    return ordered


def rank(tree: tuple[Edge, ...]) -> tuple:
    """Fan-out first, then guessed edges, then the trust in the edges, then length; the signature breaks ties."""
    return (sum(e.multiplies for e in tree), any(e.origin == "overlap" for e in tree), sum(EDGE_RANK.get(e.origin, 9) for e in tree), len(tree), tuple(sorted(e.kind for e in tree)), tuple(sorted(e.signature for e in tree)))


def choose(catalog: Catalog, anchor: str, tables: list[str], path: tuple | None = None) -> tuple[Edge, ...]:
    """The best tree, or the one with the given signatures."""
    if len(set(tables) | {anchor}) == 1:
        return ()
    found = candidates(catalog, anchor, tables)
    if path is None:
        return found[0]
    for tree in found:
        if {e.signature for e in tree} == set(path):
            return tree
    raise Refusal(f"no join path {path}")


def preserve(tree: tuple[Edge, ...], kept: set[str], anchor: str) -> tuple[Edge, ...]:
    """Left joins down the chain from every table whose rows must stay; it must lie at or before what it keeps."""
    if not kept:
        return tree
    reached = {anchor} if anchor in kept else set()
    out = []
    for e in tree:
        left = e.left in reached or e.left in kept
        out.append(Edge(e.left, e.right, e.on, "left" if left else e.kind, e.multiplies, e.origin))
        if left:
            reached.add(e.right)
    return tuple(out)


def after_left(tree: tuple[Edge, ...]) -> tuple[Edge, ...]:
    """An inner join below a left join would drop the rows that the left join keeps: it becomes a left join too."""
    optional: set[str] = set()
    out = []
    for e in tree:
        kind = "left" if e.left in optional else e.kind
        if kind == "left":
            optional.add(e.right)
        out.append(Edge(e.left, e.right, e.on, kind, e.multiplies, e.origin))
    return tuple(out)


def multiplied(tree: tuple[Edge, ...], anchor: str) -> set[str]:
    """Tables whose rows can appear more than once in the joined result."""
    tables = {anchor, *(e.right for e in tree)}
    out = set()
    for t in tables:
        # walk outwards from t: every edge away from it must lead to at most one row
        seen, frontier = {t}, [t]
        while frontier:
            at = frontier.pop()
            for e in tree:
                if e.left == at and e.right not in seen:
                    seen.add(e.right)
                    frontier.append(e.right)
                    if e.multiplies:
                        out.add(t)
                elif e.right == at and e.left not in seen:
                    seen.add(e.left)
                    frontier.append(e.left)
                    if not _one_left(e):
                        out.add(t)
    return out


def _one_left(e: Edge) -> bool:
    """Whether a right row meets at most one left row: only where the edge runs from a parent down to its child."""
    return e.multiplies
