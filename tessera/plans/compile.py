"""From a specification to a lazy DataFrame. Nothing runs here: Catalyst sees one logical plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates, dates, scalars, windows
from ..operators import predicates as ops
from . import joins, validate
from .catalog import Catalog
from .normalize import drop_redundant_key_joins, normalize
from .spec import Agg, And, Arith, Between, Call, Case, Cast, Col, DateDiff, Diagnostics, Interval, Item, Lit, Now, Or, Order, Param, Pred, Query, Refusal, Unnest, Window, Within, children, grain, has_aggregate, has_window, walk


@dataclass
class Compiler:
    """Builds DataFrames for specifications over named DataFrames and their catalog."""

    frames: dict[str, DataFrame]
    catalog: Catalog
    now: date | datetime = date(2000, 1, 1)
    params: dict = field(default_factory=dict)
    drop_key_joins: bool = False
    diagnostics: Diagnostics = field(default_factory=Diagnostics)

    def compile(self, q: Query) -> DataFrame:
        q = normalize(q, self.catalog)
        if self.drop_key_joins:
            q = drop_redundant_key_joins(q, self.catalog)
        validate.check(q, self.catalog)
        return self._block(q, {})

    # --- blocks

    def _block(self, q: Query, steps: dict[str, DataFrame]) -> DataFrame:
        steps = dict(steps)
        emitted: dict[str, str] = {}
        for s in q.steps:
            steps[s.name] = self._block(s.query, steps)
            emitted[s.name] = s.emit
        block = _Scope(self, q, steps, emitted)
        return block.build()

    def value(self, name: str):
        if name not in self.params:
            raise Refusal(f"no value for parameter {name}")
        return self.params[name]


class _Scope:
    """One SELECT block: its sources, joined, and the clauses over them."""

    def __init__(self, compiler: Compiler, q: Query, steps: dict[str, DataFrame], emitted: dict[str, str]):
        self.c, self.q, self.steps, self.emitted = compiler, q, steps, emitted
        self.aliases = dict(q.aliases)
        self.computed: dict = {}  # nodes that are columns by now (aggregates, keys, windows)

    # sources

    def _read(self, table: str) -> DataFrame:
        real = self.aliases.get(table, table)
        df = self.steps[real] if real in self.steps else self.c.frames[real]
        wanted = {x.name for x in walk(self.q) if isinstance(x, Col) and x.table == table}
        wanted |= {b for s in self.q.steps for _, other in s.keys if other.startswith(f"{table}.") for b in (other.split(".", 1)[1],)}
        wanted |= {c for k in self.c.catalog.foreign_keys for t, cs in ((k.table, k.columns), (k.parent, k.parent_columns)) if t == real for c in cs}
        wanted |= {own for s in self.q.steps if s.name == real for own, _ in s.keys}
        return df.select(*[F.col(c).alias(f"{table}.{c}") for c in df.columns if c in wanted])

    def _anchor(self, tables: list[str]) -> str:
        """Grouped: the first key's table; sorted: the first sort key's; else the smallest known table."""
        for x in (*self.q.group_by, *(o.expr for o in self.q.order_by)):
            for c in walk(x):
                if isinstance(c, Col) and c.table in tables:
                    return c.table
        counts = {t: self.c.catalog.tables[t].row_count for t in tables if t in self.c.catalog.tables}
        return min(tables, key=lambda t: (counts.get(t) is None, counts.get(t) or 0, tables.index(t)))

    def _joined(self) -> DataFrame:
        q, catalog = self.q, self.c.catalog
        read = {c.table for c in walk(q) if isinstance(c, Col)}
        scalars_ = [n for n, e in self.emitted.items() if e == "scalar" and n in read]
        tables = [t for t in dict.fromkeys((*q.tables, *(a for a, _ in q.aliases), *sorted(read))) if t not in scalars_ and self.emitted.get(t) not in ("semi", "anti")]
        if not tables:
            raise Refusal("no table to read")
        own = [t for t in tables if t in catalog.tables]
        keyed = {s.name: s for s in q.steps if s.emit == "table" and s.keys}
        attached = [t for t in tables if t in keyed and (own or t != tables[0])]
        extra = [a for a, _ in q.aliases]
        rest = [t for t in tables if t not in own and t not in attached and t not in extra]
        if own:
            kept = [t for t in own if t in q.preserve]
            anchor = kept[0] if kept else self._anchor(own)
            tree = joins.choose(catalog, anchor, own, q.join_path)
            tree = joins.after_left(joins.preserve(tree, set(q.preserve), anchor))
            self.c.diagnostics.warnings += validate.check_fan_out(q, tree, anchor)
            df = self._read(anchor)
            for e in tree:
                df = _equi(df, self._read(e.right), [(f"{e.left}.{a}", f"{e.right}.{b}") for a, b in e.on], e.kind)
        else:
            anchor = rest.pop(0) if rest else attached.pop(0)
            df = self._read(anchor)
        present = {anchor, *own}
        where = list(q.where.args) if isinstance(q.where, And) else [q.where]
        for t in (*attached, *rest, *extra):
            if t in present:
                continue
            if t in keyed:
                on = [(other, f"{t}.{mine}") for mine, other in keyed[t].keys]
                df = _equi(df, self._read(t), on, "left" if anchor in q.preserve else "inner")
            else:  # related by an equality of the WHERE clause
                on = []
                for p in where:
                    if isinstance(p, Pred) and p.op == "=" and isinstance(p.left, Col) and isinstance(p.right, Col):
                        a, b = (p.left, p.right) if p.right.table == t else (p.right, p.left)
                        if b.table == t and a.table in present:
                            on.append((f"{a.table}.{a.name}", f"{t}.{b.name}"))
                if not on:
                    raise Refusal(f"nothing relates {t} to the other tables: a cross product")
                df = _equi(df, self._read(t), on, "inner")
            present.add(t)
        for name in scalars_:
            df = df.crossJoin(F.broadcast(self._read(name)))  # one row
        for s in q.steps:
            if s.emit in ("semi", "anti"):
                probe = self.steps[s.name].select(*[F.col(mine).alias(f"__{s.name}.{mine}") for mine, _ in s.keys])
                on = reduce(lambda x, y: x & y, [F.col(f"`{other}`") == F.col(f"`__{s.name}.{mine}`") for mine, other in s.keys])
                df = df.join(probe, on, f"left_{s.emit}")
        return df

    # clauses

    def build(self) -> DataFrame:
        q = self.q
        df = self._joined()
        late = []  # predicates on window outputs
        if q.where is not None:
            parts = q.where.args if isinstance(q.where, And) else (q.where,)
            early = [p for p in parts if not has_window(p)]
            late = [p for p in parts if has_window(p)]
            if early:
                df = df.filter(reduce(lambda a, b: a & b, map(self.predicate, early)))
        if q.group_by or has_aggregate(q.select) or has_aggregate(q.order_by):
            df = self._aggregate(df)
            if q.having is not None:
                df = df.filter(self.predicate(q.having))
        for x in walk((q.select, q.order_by, q.where)):
            if isinstance(x, Window) and x not in self.computed:
                name = f"__w{len(self.computed)}"
                df = df.withColumn(name, self.expr(x))
                self.computed[x] = name
        if late:
            df = df.filter(reduce(lambda a, b: a & b, map(self.predicate, late)))
        if q.distinct_on:
            w = W.partitionBy(*[self.expr(x) for x in q.distinct_on]).orderBy(*map(self.order, q.order_by))
            df = df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
        names = self._names()
        unnested = any(isinstance(i.expr, Unnest) for i in q.select)
        # sort keys that are not selected have to survive the projection
        hidden = [] if q.distinct else [(f"__o{k}", self.expr(o.expr)) for k, o in enumerate(q.order_by)]
        out = df.select(*[self._item(i).alias(n) for i, n in zip(q.select, names, strict=True)], *[c.alias(n) for n, c in hidden])
        if q.distinct:
            out = out.distinct()
        if q.order_by and not unnested:
            if q.distinct:
                by = {i.expr: n for i, n in zip(q.select, names, strict=True)}
                if any(o.expr not in by for o in q.order_by):
                    raise Refusal("a distinct result is sorted by what it selects")
                keys = [ops.placed(F.col(f"`{by[o.expr]}`"), o.descending, o.nulls) for o in q.order_by]
            else:
                keys = [ops.placed(F.col(n), o.descending, o.nulls) for (n, _), o in zip(hidden, q.order_by, strict=True)]
            out = out.orderBy(*keys)
        limit = self.c.value(q.limit.name) if isinstance(q.limit, Param) else q.limit
        if limit is not None:
            out = out.limit(int(limit))
        return out.drop(*[n for n, _ in hidden])

    def _names(self) -> list[str]:
        names, seen = [], set()
        for k, i in enumerate(self.q.select):
            name = i.alias or alias(i.expr) or f"c{k}"
            while name in seen:
                name += "_2"
            seen.add(name)
            names.append(name)
        return names

    def _item(self, i: Item) -> Column:
        return F.explode(self.expr(i.expr.arg)) if isinstance(i.expr, Unnest) else self.expr(i.expr)

    def _aggregate(self, df: DataFrame) -> DataFrame:
        q = self.q
        found = list(dict.fromkeys(x for x in walk((q.select, q.having, q.order_by)) if isinstance(x, Agg)))
        keys = [(f"__k{n}", x) for n, x in enumerate(q.group_by)]
        scalars_ = {f"{c.table}.{c.name}" for c in walk((q.select, q.having, q.order_by)) if isinstance(c, Col) and self.emitted.get(c.table) == "scalar"}
        aggs = [self._agg(x).alias(f"__a{n}") for n, x in enumerate(found)] + [F.first(F.col(f"`{s}`")).alias(s) for s in sorted(scalars_)]
        grouped = df.groupBy(*[self.expr(x).alias(n) for n, x in keys])
        df = grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("__n"))
        self.computed |= {x: n for n, x in keys} | {x: f"__a{n}" for n, x in enumerate(found)}
        return df

    def _agg(self, x: Agg) -> Column:
        arg = None if x.arg is None else self.expr(x.arg)
        made = aggregates.apply(x.func, arg, x.distinct, x.separator, [self.expr(o.expr) for o in x.order])
        if x.func == "count" and x.arg is None and self.q.preserve:
            # kept rows without a partner are not counted: count a key of the table that was joined to them
            others = [t for t in self.q.tables if t not in self.q.preserve and t in self.c.catalog.tables and self.c.catalog.tables[t].primary_key]
            if others:
                made = F.count(F.col(f"`{others[0]}.{self.c.catalog.tables[others[0]].primary_key[0]}`"))
        return F.coalesce(made, F.lit(0)) if x.func == "count" else made

    # expressions

    def order(self, o: Order) -> Column:
        return ops.placed(self.expr(o.expr), o.descending, o.nulls)

    def expr(self, x) -> Column:
        if x in self.computed:
            return F.col(f"`{self.computed[x]}`")
        if isinstance(x, Col):
            return F.col(f"`{x.table}.{x.name}`")
        if isinstance(x, Lit):
            return F.lit(x.value).cast(x.kind) if x.kind else F.lit(x.value)
        if isinstance(x, Param):
            return F.lit(self.c.value(x.name))
        if isinstance(x, Now):
            return dates.literal(self.c.now).cast(x.kind)
        if isinstance(x, Arith):
            return self._arith(x)
        if isinstance(x, Call):
            if x.func == "round":
                return scalars.apply("round", [self.expr(x.args[0]), int(x.args[1].value)])
            return scalars.apply(x.func, [self.expr(a) for a in x.args], x.unit)
        if isinstance(x, Cast):
            return self.expr(x.arg).cast(x.kind)
        if isinstance(x, Agg):
            return self._agg(x)
        if isinstance(x, Window):
            frame = (x.frame.kind, x.frame.start, x.frame.end) if x.frame else None
            return windows.apply(x.func, None if x.arg is None else self.expr(x.arg), x.n, [self.expr(p) for p in x.partition], [self.order(o) for o in x.order], frame)
        if isinstance(x, Case):
            made = F
            for p, value in x.branches:
                made = made.when(self.predicate(p), self.expr(value))
            return made if x.otherwise is None else made.otherwise(self.expr(x.otherwise))
        raise Refusal(f"{type(x).__name__} cannot stand here")

    def _arith(self, x: Arith) -> Column:
        first, *rest = x.args
        made = self.expr(first)
        for a in rest:
            if isinstance(a, Interval):
                made = dates.shift(made, a.amount if x.op == "+" else -a.amount, a.unit)
            elif isinstance(a, Lit) and isinstance(a.value, int) and x.op in "+-" and self._is_date(first):
                made = dates.shift(made, a.value if x.op == "+" else -a.value, "day")
            elif x.op == "/":
                made = made / F.nullif(self.expr(a), F.lit(0))  # true division; by zero it is NULL
            else:
                made = {"+": made.__add__, "-": made.__sub__, "*": made.__mul__}[x.op](self.expr(a))
        return made

    def _column(self, x):
        table = self.aliases.get(x.table, x.table) if isinstance(x, Col) else None
        return self.c.catalog.tables[table].columns.get(x.name) if table in self.c.catalog.tables else None

    def _is_date(self, x) -> bool:
        column = self._column(x)
        return bool(column and column.value_type == "date")

    # predicates

    def predicate(self, p) -> Column:
        if isinstance(p, (And, Or)):
            made = list(map(self.predicate, p.args))
            return reduce((lambda a, b: a & b) if isinstance(p, And) else (lambda a, b: a | b), made)
        if isinstance(p, Within):
            column = self._column(p.left)
            return dates.window(self.expr(p.left), bool(column and column.type == "date"), p.amount, p.unit, self.c.now)
        if isinstance(p, Between):
            return self.expr(p.left).between(dates.literal(dates.parse_iso(p.start)), dates.literal(dates.parse_iso(p.end)))
        if isinstance(p, DateDiff):
            return ops.compare(dates.difference(p.unit, self.expr(p.start), self.expr(p.end)), p.op, F.lit(p.value))
        column = self._column(p.left)
        left = self.expr(p.left)
        nullable = column is None or column.nullable
        text = column.value_type == "string" if column else any(isinstance(v, Lit) and isinstance(v.value, str) and not v.kind for v in (p.right if isinstance(p.right, tuple) else (p.right,)))
        style = ops.Style(text=text, fixed_width=bool(column and column.fixed_width), case_insensitive=bool(column and column.case_insensitive), nullable=nullable, array=bool(column and column.value_type == "array"), escape=p.escape)
        if isinstance(p.right, tuple):
            return ops.apply(left, p.op, [v.value if isinstance(v, Lit) and not v.kind else self.expr(v) for v in p.right], style)
        if isinstance(p.right, Lit) and not p.right.kind:
            return ops.apply(left, p.op, p.right.value, style)
        if p.right is None:
            return ops.apply(left, p.op, None, style)
        if isinstance(p.right, Param):
            return ops.apply(left, p.op, self.c.value(p.right.name), style)
        if isinstance(p.right, Lit) or not any(isinstance(x, Col) for x in walk(p.right)):
            return ops.apply(left, p.op, self.expr(p.right), replace(style, text=False))
        return ops.apply(left, p.op, self.expr(p.right), replace(style, text=False))


def _equi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], kind: str) -> DataFrame:
    return left.join(right, reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in on]), kind)


def alias(x) -> str:
    """A name for an unnamed expression."""
    if isinstance(x, Col):
        return x.name
    if isinstance(x, Agg):
        return f"{x.func}_{'distinct_' * x.distinct}{alias(x.arg) if x.arg is not None else 'all'}"
    if isinstance(x, Call):
        return "_".join([x.func, *([x.unit] if x.unit else []), *filter(None, map(alias, x.args[:1]))])
    if isinstance(x, Window):
        return f"{x.func}_{alias(x.arg)}" if x.arg is not None else x.func
    inner = [alias(y) for y in children(x)]
    return "_".join(filter(None, inner))[:60]


def check_grain(q: Query, df: DataFrame) -> None:
    """Asserts the cardinality that the query promises: one row, or no repeated keys (runs the query)."""
    if grain(q) == "scalar" and len(df.take(2)) != 1 and q.limit != 0:
        raise Refusal("a scalar result must have exactly one row")
    if grain(q) == "grouped":
        names = [i.alias or alias(i.expr) for i in q.select if i.expr in q.group_by]
        if len(names) == len(set(q.group_by)) and df.groupBy(*names).count().filter("count > 1").take(1):
            raise Refusal("a grouped result repeats a key")
