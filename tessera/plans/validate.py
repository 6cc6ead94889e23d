"""What is refused: constructs out of scope, illegal types and roles, and joins that would falsify an aggregate."""

from __future__ import annotations

import re

from ..functions import aggregates, scalars, windows
from . import joins
from .catalog import Catalog
from .spec import Agg, And, Arith, Between, Call, Cast, Col, Lit, Or, Pred, Query, Refusal, Unnest, Window, Within, children, has_aggregate, has_window, walk

MOST_STEPS, MOST_DEPTH, MOST_NESTING = 16, 8, 3
WHERE_OPS = frozenset({"=", "!=", "<", "<=", ">", ">=", "like", "not like", "ilike", "not ilike", "in", "not in", "is null", "is not null", "contains"})
HAVING_OPS = frozenset("= != < <= > >=".split())
#: Aggregates that each logical type allows, beyond count.
TYPE_AGGREGATES = {
    "integer": {"sum", "avg", "min", "max", "stddev", "variance", "median", "string_agg"},
    "number": {"sum", "avg", "min", "max", "stddev", "variance", "median", "string_agg"},
    "string": {"min", "max", "string_agg"},
    "date": {"min", "max", "string_agg"},
    "boolean": {"min", "max"},
    "binary": set(),
    "array": set(),
    "unknown": set(),
}
FORBIDDEN_SQL = {
    "data or schema change": r"\b(insert|update|delete|merge|create|alter|drop|truncate|grant|revoke|replace\s+table|call|copy|load|refresh|cache|uncache|set|use)\b(?!\s*\()",
    "set operation": r"\b(union|intersect|except|minus)\b",
    "lateral join": r"\blateral\b",
    "recursive step": r"\bwith\s+recursive\b",
    "OFFSET or FETCH": r"\b(offset|fetch\s+(first|next))\b",
    "JSON path": r"(->>?|#>>?|\bget_json_object\s*\(|\bjson_tuple\s*\(|\bjson_extract\w*\s*\(|::\s*json)",
    "PIVOT": r"\b(un)?pivot\b",
    "grouping sets": r"\b(grouping\s+sets|rollup|cube)\b",
    "cross join": r"\bcross\s+join\b",
    "several statements": r";\s*\S",
}


def check_sql(text: str, allow_union: bool = False) -> None:
    """Refuses SQL text outside the supported subset; comments and strings are not looked at."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " '' ", text, flags=re.DOTALL).strip().lower()
    if not re.match(r"(with|select)\b", bare):
        raise Refusal("only SELECT statements")
    for what, pattern in FORBIDDEN_SQL.items():
        if not (what == "set operation" and allow_union) and re.search(pattern, bare):
            raise Refusal(f"{what} is not supported")


class Types:
    """Logical types of expressions, over the catalog and the outputs of steps."""

    def __init__(self, catalog: Catalog, steps: dict[str, dict[str, str]], aliases: dict[str, str]):
        self.catalog, self.steps, self.aliases = catalog, steps, aliases

    def of_column(self, c: Col) -> str:
        table = self.aliases.get(c.table, c.table)
        if table in self.steps:
            if c.name not in self.steps[table]:
                raise Refusal(f"step {table} has no column {c.name}")
            return self.steps[table][c.name]
        return self.catalog.column(table, c.name).value_type

    def of(self, x) -> str:
        if isinstance(x, Col):
            return self.of_column(x)
        if isinstance(x, Lit):
            v = x.value
            return "date" if x.kind in ("date", "timestamp") else "number" if x.kind.startswith("decimal") else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "null"
        if isinstance(x, Arith):
            kinds = [self.of(a) for a in x.args]
            if "date" in kinds:
                return "integer" if kinds.count("date") == 2 else "date"
            return "number" if x.op == "/" or "number" in kinds else "integer"
        if isinstance(x, Call):
            if x.func in ("upper", "lower", "trim", "ltrim", "rtrim", "concat"):
                return "string"
            return "date" if x.func == "date_trunc" else "number" if x.func in ("floor", "ceil") else self.of(x.args[0]) if x.func in ("abs", "round", "coalesce") else "integer"
        if isinstance(x, Agg):
            return "integer" if x.func == "count" else "string" if x.func == "string_agg" else "number" if x.func in ("avg", "stddev", "variance", "median") else self.of(x.arg)
        if isinstance(x, Window):
            return self.of(x.arg) if x.arg is not None and x.func != "avg" else "number" if x.func in ("avg", "percent_rank", "cume_dist") else "integer"
        if isinstance(x, Cast):
            t = x.kind.lower().split("(")[0]
            return "integer" if "int" in t else "number" if t in ("double", "float", "decimal") else "date" if t in ("date", "timestamp", "timestamp_ntz") else t
        name = type(x).__name__
        return {"Now": "date", "Interval": "interval", "Param": "null", "Unnest": "string"}.get(name) or (self.of(x.branches[0][1]) if name == "Case" else "unknown")


def nesting(p) -> int:
    return 1 + max(map(nesting, p.args), default=0) if isinstance(p, (And, Or)) else 0


def check(q: Query, catalog: Catalog, steps: dict[str, dict[str, str]] | None = None, depth: int = 1) -> Types:
    """Refuses what cannot be answered; returns the types that the compiler needs."""
    steps = dict(steps or {})
    if depth > MOST_DEPTH:
        raise Refusal(f"steps nest deeper than {MOST_DEPTH}")
    if len(q.steps) > MOST_STEPS:
        raise Refusal(f"more than {MOST_STEPS} steps")
    for s in q.steps:
        if s.emit not in ("table", "scalar", "semi", "anti"):
            raise Refusal(f"unknown emission {s.emit}")
        inner = check(s.query, catalog, steps, depth + 1)
        outputs = {i.alias or getattr(i.expr, "name", f"c{k}"): inner.of(i.expr) for k, i in enumerate(s.query.select)}
        steps[s.name] = outputs
        if s.emit == "scalar" and (s.query.group_by or not has_aggregate(s.query.select)):
            raise Refusal(f"step {s.name} is joined as a scalar but may have several rows")
        if s.emit in ("semi", "anti"):
            if not s.keys:
                raise Refusal(f"probe {s.name} names no keys")
            if any(own not in outputs for own, _ in s.keys):
                raise Refusal(f"probe {s.name} does not put out its keys")
            if s.name in q.tables:
                raise Refusal(f"probe {s.name} cannot be joined as a table")
    types = Types(catalog, steps, dict(q.aliases))
    known = {*q.tables, *(a for a, _ in q.aliases), *steps}
    for c in (x for x in walk(q) if isinstance(x, Col)):
        if c.table not in known:
            raise Refusal(f"table {c.table} is not part of the query")
        if types.of_column(c) == "unknown":
            raise Refusal(f"column {c.table}.{c.name} has a type that cannot be queried")
    if not q.select:
        raise Refusal("nothing is selected")
    _expressions(q, types)
    _predicates(q, types)
    _aggregation(q, types)
    _sensitivity(q, catalog, dict(q.aliases))
    for t in q.tables:
        needed = catalog.tables[t].required_filters if t in catalog.tables else ()
        filtered = {c.name for c in walk(q.where) if isinstance(c, Col) and c.table == t} if q.where is not None else set()
        if needed and not filtered & set(needed):
            raise Refusal(f"{t} must be filtered by one of {', '.join(needed)}")
    return types


def _expressions(q: Query, types: Types) -> None:
    for x in walk(q):
        if isinstance(x, Call):
            if x.func not in scalars.WHITELIST:
                raise Refusal(f"function {x.func} is not in the whitelist")
            if x.func in ("date_trunc", "extract", "date_part") and not x.unit:
                raise Refusal(f"{x.func} needs a unit of the calendar")
            kind = types.of(x.args[0])
            if x.func in scalars.TEMPORAL and kind not in ("date", "null"):
                raise Refusal(f"{x.func} of a {kind}")
            if x.func in ("abs", "round", "floor", "ceil") and kind not in ("integer", "number", "null"):
                raise Refusal(f"{x.func} of a {kind}")
        elif isinstance(x, Arith):
            kinds = [types.of(a) for a in x.args]
            if any(k in ("string", "boolean", "binary", "array") for k in kinds):
                raise Refusal(f"arithmetic on {', '.join(kinds)}")
            if x.op not in ("+", "-", "*", "/"):
                raise Refusal(f"operator {x.op}")
        elif isinstance(x, Window):
            try:
                windows.check(x.func, x.arg is not None, x.n, bool(x.order))
            except ValueError as error:
                raise Refusal(str(error)) from None
            if x.func in windows.AGGREGATE and types.of(x.arg) not in ("integer", "number"):
                raise Refusal(f"{x.func} over a {types.of(x.arg)}")
            if x.frame and x.frame.kind == "range" and any(b not in (None, 0) for b in (x.frame.start, x.frame.end)) and len(x.order) != 1:
                raise Refusal("a RANGE frame with an offset needs one sort key")
    if any(isinstance(x, Unnest) for x in walk((q.where, q.group_by, q.having, q.order_by))):
        raise Refusal("arrays are unnested in the select list only")


def _predicates(q: Query, types: Types) -> None:
    for p in (q.where, q.having):
        if p is not None and nesting(p) > MOST_NESTING:
            raise Refusal(f"predicates nest deeper than {MOST_NESTING}")
    for x in walk((q.where, q.having)):
        if isinstance(x, Pred):
            if x.op not in WHERE_OPS:
                raise Refusal(f"operator {x.op}")
            if x.op == "not in" and any(isinstance(v, Lit) and v.value is None for v in x.right):
                raise Refusal("NOT IN a list that holds NULL")
            kind = types.of(x.left)
            if "like" in x.op and kind not in ("string", "null"):
                raise Refusal(f"{x.op} on a {kind}")
            if x.op == "contains" and kind not in ("array", "string"):
                raise Refusal(f"contains on a {kind}")
            if isinstance(x.right, Lit) and x.right.value is not None and x.op in ("=", "<", ">", "<=", ">=", "!="):
                right = types.of(x.right)
                clash = {kind, right} & {"string"} and {kind, right} & {"integer", "number", "boolean"}
                if clash:
                    raise Refusal(f"compares a {kind} with a {right}")
        elif isinstance(x, (Within, Between)) and types.of(x.left) != "date":
            raise Refusal(f"a date window on a {types.of(x.left)}")
    if q.where is not None and has_aggregate(q.where):
        raise Refusal("an aggregate in WHERE: it belongs into HAVING")
    if q.having is not None:
        # what is always true or never may have lost its aggregates
        if not has_aggregate(q.having) and any(isinstance(x, Col) for x in walk(q.having)):
            raise Refusal("HAVING without an aggregate")
        for x in walk(q.having):
            if isinstance(x, Pred) and x != Pred(Lit(1), "=", Lit(1)) and x.op not in HAVING_OPS:
                raise Refusal(f"HAVING takes comparisons of numbers, not {x.op}")


def _aggregation(q: Query, types: Types) -> None:
    for x in walk((q.select, q.having, q.order_by)):
        if isinstance(x, Agg):
            if x.func not in aggregates.WHITELIST:
                raise Refusal(f"aggregate {x.func} is not in the whitelist")
            if any(isinstance(y, Agg) for y in walk(x.arg)):
                raise Refusal("nested aggregates")
            if x.func != "count" and x.func not in TYPE_AGGREGATES.get(types.of(x.arg), aggregates.WHITELIST):
                raise Refusal(f"{x.func} of a {types.of(x.arg)}")
            if x.func == "string_agg" and x.separator is None:
                raise Refusal("string_agg needs a separator")
    if q.group_by and not (has_aggregate(q.select) or q.having is not None):
        raise Refusal("grouped without an aggregate")
    if has_aggregate(q.select) or q.group_by:
        keys = set(q.group_by)

        def bare(x) -> bool:
            if x in keys or isinstance(x, (Agg, Lit)):
                return False
            if isinstance(x, Col):
                return x.table not in types.steps or x.table in q.tables
            return any(map(bare, children(x)))

        for i in q.select:
            if bare(i.expr):
                raise Refusal(f"{i.alias or i.expr} is neither a key nor an aggregate")
        for o in q.order_by:
            if bare(o.expr):
                raise Refusal("the order is neither a key nor an aggregate")
    if q.distinct_on:
        if not q.order_by or [o.expr for o in q.order_by[: len(q.distinct_on)]] != list(q.distinct_on):
            raise Refusal("DISTINCT ON needs an order that starts with its keys")


def _sensitivity(q: Query, catalog: Catalog, aliases: dict[str, str]) -> None:
    for place, x in (("grouping", q.group_by), ("sorting", q.order_by), ("filtering", q.where)):
        for c in walk(x):
            table = aliases.get(c.table, c.table) if isinstance(c, Col) else None
            if table in catalog.tables and catalog.column(table, c.name).sensitivity == "restricted":
                raise Refusal(f"{place} by {c.table}.{c.name} is restricted")


def check_fan_out(q: Query, tree: tuple, anchor: str) -> list[str]:
    """Refuses aggregates and windows over rows that a join repeats; returns warnings about widened row sets."""
    repeated = joins.multiplied(tree, anchor)
    for x in walk((q.select, q.having, q.order_by)):
        if isinstance(x, Agg) and not x.distinct and x.func not in ("min", "max"):
            read = {c.table for c in walk(x.arg) if isinstance(c, Col)} if x.arg is not None else set()
            if read & repeated:
                raise Refusal(f"{x.func} over {', '.join(sorted(read & repeated))}: a join repeats its rows; aggregate it in a step first")
        elif isinstance(x, Window) and x.arg is not None and x.func in windows.AGGREGATE:
            read = {c.table for c in walk(x.arg) if isinstance(c, Col)}
            if read & repeated:
                raise Refusal(f"window {x.func} over {', '.join(sorted(read & repeated))}: a join repeats its rows")
    selected = {c.table for c in walk(q.select) if isinstance(c, Col)}
    warnings = []
    if repeated & selected and not has_aggregate(q.select) and not has_window(q.select):
        widened = {e.right for e in tree if e.multiplies} - selected
        if widened and q.limit is not None and not q.distinct:
            raise Refusal(f"LIMIT over rows that {', '.join(sorted(widened))} repeats")
        if widened:
            warnings.append(f"{', '.join(sorted(widened))} may repeat rows")
    return warnings
