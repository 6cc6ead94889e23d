"""Passes over the specification that Catalyst cannot make, because they need the catalog or change what a query means."""

from __future__ import annotations

from dataclasses import replace

from ..functions import dates, scalars
from .catalog import Catalog
from .spec import Agg, And, Arith, Between, Call, Col, DateDiff, Item, Lit, Or, Pred, Query, Step, Within, has_aggregate, rebuild, walk

FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}
FALSE = Pred(Lit(1), "=", Lit(0))
TRUE_WORDS, FALSE_WORDS = frozenset("true t yes y 1 on".split()), frozenset("false f no n 0 off".split())


def normalize(q: Query, catalog: Catalog) -> Query:
    """All passes, in order; steps first."""
    q = replace(q, steps=tuple(replace(s, query=normalize(s.query, catalog)) for s in q.steps))
    q = order_steps(q)
    q = rebuild(q, canonical)
    q = replace(q, where=predicates(q.where, catalog), having=predicates(strip_impossible(q.having), catalog))
    q = drop_unused_steps(q)
    q = infer_group_by(q)
    q = strip_spurious_group_by(q)
    if q.expand_keys:
        q = expand_keys(q, catalog)
    q = count_distinct_key(q, catalog)
    return q


def canonical(x):
    """Spelling: units, function names, columns to the left, defaults, BETWEEN as two comparisons, = NULL as IS NULL."""
    if isinstance(x, Call):
        args = x.args
        if x.func in scalars.DEFAULTS and len(args) == 1:
            args = (*args, Lit(scalars.DEFAULTS[x.func]))
        return Call(x.func.lower(), args, dates.unit(x.unit) if x.unit else "")
    if isinstance(x, Agg):
        arg = None if isinstance(x.arg, Lit) and x.func.lower() == "count" and not x.distinct else x.arg
        return replace(x, func=x.func.lower(), arg=arg)
    if isinstance(x, (Within, DateDiff)):
        return replace(x, unit=dates.unit(x.unit))
    if isinstance(x, Pred):
        op = x.op.lower()
        if op in ("=", "!=") and isinstance(x.right, Lit) and x.right.value is None:
            return Pred(x.left, "is null" if op == "=" else "is not null")
        if op == "between":
            return And((Pred(x.left, ">=", x.right[0]), Pred(x.left, "<=", x.right[1])))
        if isinstance(x.left, Lit) and isinstance(x.right, Col) and op in FLIP:
            return Pred(x.right, FLIP[op], x.left)
        if op == "in" and isinstance(x.right, tuple) and len(x.right) == 1:
            return Pred(x.left, "=", x.right[0])
        # a - b > 5 on dates counts days
        if isinstance(x.left, Arith) and x.left.op == "-" and len(x.left.args) == 2 and isinstance(x.right, Lit) and isinstance(x.right.value, int) and x.left.args[0] != x.left.args[1] and all(isinstance(a, Col) and a.name.lower().endswith(("date", "_at", "_on")) for a in x.left.args):
            return DateDiff("day", x.left.args[1], x.left.args[0], op, x.right.value)
        return replace(x, op=op)
    return x


# --- predicates -------------------------------------------------------------------------------------------------------


def predicates(p, catalog: Catalog):
    if p is None:
        return None
    p = rebuild(p, lambda x: resolve_values(x, catalog))
    p = flatten(p)
    return p


def resolve_values(x, catalog: Catalog):
    """Literals as the column stores them: the casing of a known value, the truth values of a flag."""
    if not (isinstance(x, Pred) and isinstance(x.left, Col) and x.left.table in catalog.tables):
        return x
    column = catalog.tables[x.left.table].columns.get(x.left.name)
    if column is None:
        return x

    def stored(v):
        if not isinstance(v, Lit):
            return v
        text = str(v.value).strip().lower()
        if column.value_type == "boolean" and not isinstance(v.value, bool):
            return Lit(True) if text in TRUE_WORDS else Lit(False) if text in FALSE_WORDS else v
        known = {str(k).lower(): k for k in column.stats.get("frequent", {})}
        if column.value_type == "string" and x.op in ("=", "!=", "in", "not in") and isinstance(v.value, str) and text in known:
            return Lit(known[text])
        if column.role == "flag" and column.value_type in ("integer", "string") and isinstance(v.value, bool):
            truths = [k for k in column.stats.get("frequent", {}) if str(k).lower() in (TRUE_WORDS if v.value else FALSE_WORDS)]
            return Lit(int(truths[0]) if column.value_type == "integer" else truths[0]) if truths else v
        return v

    right = tuple(map(stored, x.right)) if isinstance(x.right, tuple) else stored(x.right)
    return replace(x, right=right)


def flatten(p):
    """Nested groups of one kind become one, repeated members one; contradictions under AND become FALSE."""
    if not isinstance(p, (And, Or)):
        return p
    kind = type(p)
    args = []
    for a in map(flatten, p.args):
        args += a.args if isinstance(a, kind) else [a]
    args = list(dict.fromkeys(args))
    if kind is Or:
        args = [a for a in _equalities_to_in(args) if a != FALSE] or [FALSE]
    else:
        args = [FALSE] if FALSE in args or _contradicts(args) else _drop_year_extracts(_tighten(args))
    return args[0] if len(args) == 1 else kind(tuple(args))


def _plain(v) -> bool:
    return isinstance(v, Lit) and v.value is not None and not v.kind


def _contradicts(args) -> bool:
    equal: dict = {}
    for a in args:
        if isinstance(a, Pred) and a.op == "=" and _plain(a.right):
            value = a.right.value.lower() if isinstance(a.right.value, str) else a.right.value
            if equal.setdefault(a.left, value) != value:
                return True
    nulls = {a.left for a in args if isinstance(a, Pred) and a.op == "is null"}
    needed = {a.left for a in args if isinstance(a, Pred) and a.op in ("=", "<", "<=", ">", ">=", "in", "like", "ilike", "is not null")}
    return bool(nulls & needed)


def _tighten(args):
    """Of several bounds on one side only the tightest stays; an empty range is FALSE."""
    bounds: dict = {}
    rest = []
    for a in args:
        if isinstance(a, Pred) and a.op in ("<", "<=", ">", ">=") and _plain(a.right) and not isinstance(a.right.value, (str, bool)):
            side = a.op[0]
            now = bounds.get((a.left, side))
            better = (lambda x, y: x < y) if side == "<" else (lambda x, y: x > y)
            if now is None or better(a.right.value, now.right.value) or (a.right.value == now.right.value and len(a.op) == 1):
                bounds[a.left, side] = a
        else:
            rest.append(a)
    for (left, side), low in bounds.items():
        high = bounds.get((left, "<"))
        if side == ">" and high is not None:
            a, b = low.right.value, high.right.value
            if a > b or (a == b and (low.op, high.op) != (">=", "<=")):
                return [FALSE]
    return rest + list(bounds.values())


def _equalities_to_in(args):
    values: dict = {}
    for a in args:
        if isinstance(a, Pred) and a.op == "=" and _plain(a.right):
            values.setdefault(a.left, []).append(a.right)
    out, done = [], set()
    for a in args:
        if isinstance(a, Pred) and a.op == "=" and _plain(a.right) and len(values[a.left]) > 1:
            if a.left not in done:
                done.add(a.left)
                out.append(Pred(a.left, "in", tuple(dict.fromkeys(values[a.left]))))
        else:
            out.append(a)
    return out


def _drop_year_extracts(args):
    """``year(d) = 2020`` beside a range of ``d`` inside that year says nothing and would block pruning."""
    ranges = {}
    for a in args:
        if isinstance(a, Between):
            ranges[a.left] = (a.start[:4], a.end[:4])
    out = []
    for a in args:
        year = isinstance(a, Pred) and a.op == "=" and isinstance(a.left, Call) and (a.left.func == "year" or a.left.unit == "year") and _plain(a.right)
        if not (year and ranges.get(a.left.args[0]) == (str(a.right.value),) * 2):
            out.append(a)
    return out


def strip_impossible(p):
    """A count is never negative: ``count < 0`` is FALSE, ``count >= 0`` says nothing."""

    def change(x):
        if isinstance(x, Pred) and isinstance(x.left, Agg) and x.left.func == "count" and _plain(x.right) and isinstance(x.right.value, (int, float)):
            if (x.op, x.right.value) == ("<", 0) or (x.op in ("<", "<=", "=") and x.right.value < 0):
                return FALSE
            if x.op in (">=", ">", "!=") and x.right.value < (1 if x.op == ">=" else 0) and (x.op != ">=" or x.right.value <= 0):
                return Pred(Lit(1), "=", Lit(1))
        return x

    return p if p is None else rebuild(p, change)


# --- shape ------------------------------------------------------------------------------------------------------------


def order_steps(q: Query) -> Query:
    """Steps in order of what they read."""
    by_name, done, out = {s.name: s for s in q.steps}, set(), []

    def visit(s: Step, path: tuple) -> None:
        if s.name in path:
            raise ValueError(f"steps refer to each other in a circle: {' -> '.join((*path, s.name))}")
        if s.name not in done:
            for other in sorted(step_reads(s) & by_name.keys()):
                visit(by_name[other], (*path, s.name))
            done.add(s.name)
            out.append(s)

    for s in q.steps:
        visit(s, ())
    return replace(q, steps=tuple(out))


def step_reads(s: Step) -> set[str]:
    return {*s.query.tables, *(c.table for c in walk(s.query) if isinstance(c, Col)), *(t for _, t in s.query.aliases)}


def drop_unused_steps(q: Query) -> Query:
    """Probes always count; tables and scalars only where something reads them."""
    used = {*q.tables, *(c.table for c in walk(q) if isinstance(c, Col)), *(t for _, t in q.aliases)}
    kept: list[Step] = []
    for s in reversed(q.steps):
        if s.emit in ("semi", "anti") or s.name in used:
            kept.insert(0, s)
            used |= step_reads(s)
    return replace(q, steps=tuple(kept))


def infer_group_by(q: Query) -> Query:
    """Plain columns beside aggregates are keys."""
    if q.group_by or not has_aggregate(q.select):
        return q
    plain = [i.expr for i in q.select if not has_aggregate(i.expr) and any(isinstance(x, Col) for x in walk(i.expr)) and not any(type(x).__name__ == "Window" for x in walk(i.expr))]
    return replace(q, group_by=tuple(dict.fromkeys(plain)))


def strip_spurious_group_by(q: Query) -> Query:
    """Keys without any aggregate: the distinct rows are meant."""
    if q.group_by and not has_aggregate(q.select) and q.having is None and not has_aggregate(q.order_by) and {i.expr for i in q.select} == set(q.group_by):
        return replace(q, group_by=(), distinct=True)
    return q


def count_distinct_key(q: Query, catalog: Catalog) -> Query:
    """COUNT(DISTINCT key) is COUNT(key) where no join can repeat the key: in blocks with one table."""
    if len(q.tables) != 1 or q.aliases or any(s.emit == "table" for s in q.steps if s.name in q.tables):
        return q
    key = catalog.tables[q.tables[0]].primary_key if q.tables[0] in catalog.tables else ()

    def change(x):
        return replace(x, distinct=False) if isinstance(x, Agg) and x.func == "count" and x.distinct and isinstance(x.arg, Col) and key == (x.arg.name,) else x

    return rebuild(q, change)


def expand_keys(q: Query, catalog: Catalog) -> Query:
    """A selected foreign key is followed by the columns that name its parent; they join the keys of a grouping."""
    select, group, tables = [], list(q.group_by), list(q.tables)
    for i in q.select:
        select.append(i)
        if isinstance(i.expr, Col):
            for k in catalog.foreign_keys:
                if k.table == i.expr.table and k.columns == (i.expr.name,):
                    for name in catalog.descriptive_columns(k.parent):
                        c = Col(k.parent, name)
                        if all(s.expr != c for s in (*select, *q.select)):
                            select.append(Item(c))
                            group += [c] if group else []
                            tables += [k.parent] if k.parent not in tables else []
    return replace(q, select=tuple(select), group_by=tuple(group), tables=tuple(tables))


def drop_redundant_key_joins(q: Query, catalog: Catalog) -> Query:
    """A parent that is read only by its key needs no join: the child's key says the same (off unless asked for)."""
    for k in catalog.foreign_keys:
        if k.parent in q.tables and k.table in q.tables and len(q.tables) > 1 and k.parent_columns == catalog.tables[k.parent].primary_key and not any(catalog.tables[k.table].columns[c].nullable for c in k.columns):
            read = {c.name for c in walk(q) if isinstance(c, Col) and c.table == k.parent}
            others = [f for f in catalog.foreign_keys if f != k and k.parent in (f.table, f.parent) and {f.table, f.parent} - {k.parent} & set(q.tables)]
            if read <= set(k.parent_columns) and not others:
                to = dict(zip(k.parent_columns, k.columns, strict=True))
                q = rebuild(q, lambda x, k=k, to=to: Col(k.table, to[x.name]) if isinstance(x, Col) and x.table == k.parent else x)
                q = replace(q, tables=tuple(t for t in q.tables if t != k.parent))
    return q


