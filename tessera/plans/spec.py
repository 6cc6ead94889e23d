"""The query specification: a closed set of typed nodes, all of them JSON-able, from which lazy DataFrames are built."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, ClassVar, Union

_KINDS: dict[str, type] = {}


def node(cls: type) -> type:
    """Registers a frozen node class under its name, for JSON."""
    cls = dataclass(frozen=True)(cls)
    _KINDS[cls.__name__] = cls
    return cls


# --- expressions ------------------------------------------------------------------------------------------------------


@node
class Col:
    """A column of a table or of an earlier step: ``Col("orders", "o_totalprice")``."""

    table: str
    name: str


@node
class Lit:
    """A literal; ``kind`` names a Spark type for dates, timestamps and decimals, which are given as text."""

    value: Any
    kind: str = ""


@node
class Param:
    """A value bound when the specification is compiled."""

    name: str


@node
class Now:
    """The anchor date or timestamp of the compilation; never the wall clock."""

    kind: str = "date"


@node
class Interval:
    amount: int
    unit: str


@node
class Arith:
    """``+ - * /`` over two or more operands; division is always true division."""

    op: str
    args: tuple


@node
class Call:
    """A scalar function of the whitelist; ``unit`` belongs to the calendar functions."""

    func: str
    args: tuple
    unit: str = ""


@node
class Cast:
    arg: Any
    kind: str


@node
class Agg:
    """An aggregate; ``separator`` and ``order`` belong to string_agg. ``arg`` None is COUNT(*)."""

    func: str
    arg: Any = None
    distinct: bool = False
    separator: str | None = None
    order: tuple = ()


@node
class Order:
    expr: Any
    descending: bool = False
    nulls: str = ""  # "first" or "last"; by default last when ascending, first when descending


@node
class Frame:
    """ROWS or RANGE; bounds are None (unbounded), 0 (current row), or signed offsets."""

    kind: str
    start: int | None = None
    end: int | None = 0


@node
class Window:
    func: str
    arg: Any = None
    n: int | None = None
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


@node
class Case:
    branches: tuple  # of (predicate, expression)
    otherwise: Any = None


@node
class Unnest:
    """One row for each element of an array column; only in the select list of a step."""

    arg: Any


# --- predicates -------------------------------------------------------------------------------------------------------


@node
class Pred:
    """``left op right``: right is an expression, a tuple of literals (in, not in, between), or None (is null).

    ``escape`` is the escape character of a pattern; "" is none.
    """

    left: Any
    op: str
    right: Any = None
    escape: str = "/"


@node
class Within:
    """Relative date window: the last ``amount`` units up to the anchor; 0 means since the unit began."""

    left: Any
    amount: int
    unit: str


@node
class Between:
    """Absolute date window, ISO dates, both ends included."""

    left: Any
    start: str
    end: str


@node
class DateDiff:
    """``date_diff(unit, start, end) op value``, in calendar boundaries crossed."""

    unit: str
    start: Any
    end: Any
    op: str
    value: int


@node
class And:
    args: tuple


@node
class Or:
    args: tuple


# --- queries ----------------------------------------------------------------------------------------------------------


@node
class Item:
    expr: Any
    alias: str = ""


@node
class Step:
    """A named intermediate query. ``emit`` says how later blocks use it: table, scalar, semi or anti.

    ``keys`` pairs the step's output columns with columns of the block that uses it: (own, other), ...
    """

    name: str
    query: Query
    emit: str = "table"
    keys: tuple = ()


@node
class Query:
    select: tuple
    tables: tuple = ()
    where: Any = None
    group_by: tuple = ()
    having: Any = None
    order_by: tuple = ()
    limit: Any = None
    distinct: bool = False
    distinct_on: tuple = ()
    steps: tuple = ()
    preserve: tuple = ()  # tables whose rows all stay
    join_path: tuple | None = None  # a chosen signature, where several paths tie
    expand_keys: bool = False  # add the descriptive column beside a key in the output
    aliases: tuple = ()  # (alias, table): further readings of a table, for self-joins
    GRAINS: ClassVar = ("scalar", "grouped", "row_level")


Expr = Union[Col, Lit, Param, Now, Interval, Arith, Call, Cast, Agg, Window, Case, Unnest]
Predicate = Union[Pred, Within, Between, DateDiff, And, Or]


# --- shorthand --------------------------------------------------------------------------------------------------------


def col(path: str) -> Col:
    table, _, name = path.partition(".")
    return Col(table, name)


def lift(x: Any) -> Any:
    """A node as it is; anything else as a literal."""
    return x if type(x).__name__ in _KINDS else Lit(x)


def arith(op: str, *args: Any) -> Arith:
    return Arith(op, tuple(lift(a) for a in args))


def call(func: str, *args: Any, unit: str = "") -> Call:
    return Call(func, tuple(lift(a) for a in args), unit)


def where(left: Any, op: str, right: Any = None) -> Pred:
    return Pred(lift(left), op, tuple(map(lift, right)) if isinstance(right, (list, tuple)) else None if right is None and "null" in op else lift(right))


def item(expr: Any, alias: str = "") -> Item:
    return Item(lift(expr), alias)


# --- walking and JSON -------------------------------------------------------------------------------------------------


def children(x: Any):
    """The nodes directly below ``x``; those of a step's query are not below the query that holds it."""
    if isinstance(x, tuple):
        yield from (y for y in x if isinstance(y, tuple) or type(y).__name__ in _KINDS)
    elif is_dataclass(x):
        for f in fields(x):
            value = getattr(x, f.name)
            if not isinstance(value, Query) and f.name != "steps":
                yield from children((value,)) if not isinstance(value, tuple) else children(value)


def walk(x: Any):
    if type(x).__name__ in _KINDS:
        yield x
    for y in children(x):
        yield from walk(y)


def rebuild(x: Any, change) -> Any:
    """``x`` with ``change`` applied to every node, from below; steps are left alone."""
    if isinstance(x, tuple):
        return tuple(rebuild(y, change) for y in x)
    if type(x).__name__ not in _KINDS:
        return x
    made = {f.name: getattr(x, f.name) if f.name == "steps" else rebuild(getattr(x, f.name), change) for f in fields(x)}
    return change(type(x)(**made))


def to_dict(x: Any) -> Any:
    if isinstance(x, tuple):
        return [to_dict(y) for y in x]
    if type(x).__name__ in _KINDS:
        return {"kind": type(x).__name__} | {("kind_of" if f.name == "kind" else f.name): to_dict(getattr(x, f.name)) for f in fields(x)}
    return x


def from_dict(x: Any) -> Any:
    if isinstance(x, list):
        return tuple(from_dict(y) for y in x)
    if isinstance(x, dict):
        made = {("kind" if k == "kind_of" else k): from_dict(v) for k, v in x.items() if k != "kind"}
        return _KINDS[x["kind"]](**made)
    return x


def dumps(x: Any) -> str:
    return json.dumps(to_dict(x), sort_keys=True, default=str)


def loads(text: str) -> Any:
    return from_dict(json.loads(text))


def tables_of(x: Any) -> set[str]:
    return {c.table for c in walk(x) if isinstance(c, Col)}


def grain(q: Query) -> str:
    """scalar: exactly one row; grouped: a row for each key; row_level: neither."""
    if q.group_by:
        return "grouped"
    return "scalar" if has_aggregate(q.select) else "row_level"


def has_aggregate(x: Any) -> bool:
    return any(isinstance(y, Agg) for y in walk(x))


def has_window(x: Any) -> bool:
    return any(isinstance(y, Window) for y in walk(x))


@dataclass
class Diagnostics:
    """What a compilation has to say besides its result."""

    warnings: list[str] = field(default_factory=list)


class Refusal(ValueError):
    """A construct that cannot be answered safely."""
