"""Predicates where plain SQL surprises: negation includes the unknown, text compares without case, nulls sort where told."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """What a comparison must know of its left side."""

    text: bool = False
    fixed_width: bool = False
    case_insensitive: bool = False  # by its collation: no folding needed
    nullable: bool = True
    array: bool = False
    escape: str = "/"  # of patterns; "" is none


def placed(c: Column, descending: bool, nulls: str = "") -> Column:
    """A sort key with its nulls placed: last when ascending, first when descending, unless told otherwise."""
    nulls = nulls or ("first" if descending else "last")
    return getattr(c, f"{'desc' if descending else 'asc'}_nulls_{nulls}")()


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)


def escape_like(text: str) -> str:
    """A literal inside a LIKE pattern; the escape character is a slash."""
    return text.replace("/", "//").replace("%", "/%").replace("_", "/_")


def _folded(x, style: Style, fold: bool):
    c = x if isinstance(x, Column) else F.lit(x)
    c = F.rtrim(c) if style.fixed_width else c
    return F.lower(c) if fold else c


def apply(left: Column, op: str, right, style: Style = Style()) -> Column:
    """``right``: a value, a list of values, or a Column. Negations on nullable columns keep the rows whose value is unknown."""
    if op == "is null":
        return left.isNull()
    if op == "is not null":
        return left.isNotNull()
    if op == "contains":
        return _contains(left, right, style)
    many = isinstance(right, list)
    fold = style.text and not style.case_insensitive and all(isinstance(v, (str, type(None))) for v in (right if many else [right]))
    if op in ("=", "!=", "in", "not in"):
        values = [_folded(v, style, fold) for v in (right if many else [right])]
        own = _folded(left, style, fold)
        core = own.isin(*values) if many else own == values[0]
    elif op in ("like", "not like", "ilike", "not ilike"):
        # without an escape character: one that no text holds
        escape = style.escape.lower() or "\uffff"
        core = F.like(F.lower(left), F.lower(right if isinstance(right, Column) else F.lit(right)), F.lit(escape))
    else:
        return compare(left, op, right if isinstance(right, Column) else F.lit(right))
    if op == "!=" or op.startswith("not "):
        core = ~core
        return core | left.isNull() if style.nullable else core
    return core


def _contains(left: Column, value, style: Style) -> Column:
    """Membership in an array, or in a JSON text that holds one; elements are compared without case, quotes and spaces."""
    items = left if style.array else F.from_json(left, "array<string>")
    clean = lambda x: F.lower(F.trim(x.cast("string"), F.lit(" \"'")))
    return F.array_contains(F.transform(items, clean), clean(value if isinstance(value, Column) else F.lit(value)))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
