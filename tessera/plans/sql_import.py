"""SELECT text to specifications: a small recursive-descent parser over the supported subset; the rest is refused."""

from __future__ import annotations

import re
from dataclasses import replace

from ..functions import aggregates, dates, scalars, windows
from .catalog import Catalog
from .spec import Agg, And, Arith, Call, Case, Cast, Col, Frame, Interval, Item, Lit, Now, Or, Order, Pred, Query, Refusal, Step, Window, has_aggregate, rebuild
from .validate import check_sql

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<string>'(?:[^']|'')*')|(?P<name>[A-Za-z_]\w*|\"[^\"]+\"|`[^`]+`)|(?P<op><>|!=|<=|>=|\|\||[-+*/=<>(),.;]))")
_CLAUSES = frozenset("from where group having order limit join inner left right full outer cross natural on and or not in is between like ilike as asc desc nulls then else end when union with by over partition rows range using escape exists".split())


class _Parser:
    def __init__(self, text: str, catalog: Catalog):
        self.catalog = catalog
        self.tokens, at = [], 0
        text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL).strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Refusal(f"cannot read {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0
        self.steps: dict[str, Query] = {}
        self.lifted: list[Step] = []  # subqueries of the block that is read
        self.probes: list[tuple] = []  # (left columns, inner query, semi or anti) of the block that is read
        self.outer: list[dict[str, str]] = []  # names of the blocks around it

    # tokens

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1].lower() if self.at + k < len(self.tokens) else ""

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def need(self, *wanted: str) -> str:
        found = self.take(*wanted)
        if found is None:
            raise Refusal(f"expected {' or '.join(wanted)}, found {self.peek() or 'the end'}")
        return found

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise Refusal(f"expected a name, found {text or 'the end'}")
        self.at += 1
        return text.strip('"`')

    # statements

    def statement(self) -> Query:
        steps = []
        if self.take("with"):
            while True:
                name = self.name()
                self.need("as")
                self.need("(")
                inner = self.select()
                self.need(")")
                steps.append(Step(name, inner))
                self.steps[name] = inner
                if not self.take(","):
                    break
        q = self.select()
        if self.at < len(self.tokens):
            raise Refusal(f"unexpected {self.peek()}")
        return replace(q, steps=(*(replace(s, **_emission(s, q)) for s in steps), *q.steps))

    def select(self, probe: bool = False) -> Query:
        """A block. Of a ``probe``, what is selected does not matter; its keys are the columns compared with those around it."""
        kept, self.lifted, self.probes = (self.lifted, self.probes), [], []
        try:
            return self._select(probe)
        finally:
            self.lifted, self.probes = kept

    def _select(self, probe: bool) -> Query:
        self.need("select")
        distinct = bool(self.take("distinct"))
        distinct_on: tuple = ()
        if distinct and self.take("on"):
            self.need("(")
            distinct, distinct_on = False, tuple(self._list(self.expression))
            self.need(")")
        first = self.at
        depth = 0
        while self.at < len(self.tokens) and not (depth == 0 and self.peek() == "from"):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1
        self.need("from")
        names: dict[str, str] = {}
        joined: list = []
        self.scope = names
        self._source(names)
        while True:
            if self.take(","):
                self._source(names)
                continue
            kind = self.take("inner", "left", "join", "right", "full")
            if kind is None:
                break
            if kind in ("right", "full"):
                raise Refusal(f"{kind} join")
            if kind != "join":
                self.take("outer")
                self.need("join")
            self._source(names)
            self.need("on")
            joined.append((kind, self.predicate()))
        after = self.at
        select = []
        if not probe:
            self.at = first
            select = self._items()
            self.need("from")
            self.at = after
        self.outer.append(names)
        where = self.predicate(probes=True) if self.take("where") else None
        self.outer.pop()
        group = having = None
        if self.take("group"):
            self.need("by")
            group = self._list(self.expression)
        if self.take("having"):
            having = self.predicate()
        order: list = []
        if self.take("order"):
            self.need("by")
            order = self._list(self.order)
        limit = int(self.tokens[self.at][1]) if self.take("limit") else None
        if limit is not None:
            self.at += 1
        by_alias = {i.alias: i.expr for i in select if i.alias}
        places = [i.expr for i in select]
        resolve = lambda x: places[x.value - 1] if isinstance(x, Lit) and isinstance(x.value, int) and not x.kind else by_alias.get(x.name, x) if isinstance(x, Col) and not x.table else x
        group = tuple(map(resolve, group)) if group else ()
        order = [replace(o, expr=resolve(o.expr)) for o in order]
        distinct_on = tuple(map(resolve, distinct_on))
        if distinct_on and [o.expr for o in order[: len(distinct_on)]] != list(distinct_on):
            raise Refusal("DISTINCT ON needs its columns first in ORDER BY")
        q = Query(select=tuple(select), tables=tuple(dict.fromkeys(names.values())), where=where, group_by=group, having=having, order_by=tuple(order), limit=limit, distinct=distinct, distinct_on=distinct_on)
        return _first_only(self._place(q, names, joined, probe))

    def _source(self, names: dict[str, str]) -> None:
        if self.peek() == "(":
            self.need("(")
            inner = self.select()
            self.need(")")
            self.take("as")
            alias = self.name()
            if alias in self.steps or alias in self.catalog.tables:
                raise Refusal(f"{alias} names two things")
            self.steps[alias] = inner
            names[alias] = alias
            self.lifted.append(Step(alias, inner))
            return
        table = self.name()
        alias = table
        if self.take("as") or (self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.peek() not in _CLAUSES):
            alias = self.name()
        if alias in names:
            raise Refusal(f"{alias} stands twice in FROM")
        names[alias] = table

    def _place(self, q: Query, names: dict[str, str], joined: list, probe: bool = False) -> Query:
        """Qualifies columns, and reconciles joins with the key graph; a table that is read twice becomes an alias.

        Of a probe, equalities with a column of the block around it become its keys: the inner column is put out.
        """
        keys = []
        if probe:
            inside = lambda c: c.table in names if c.table else any(c.name in self._outputs(t) for t in names.values())
            rest = []
            for p in q.where.args if isinstance(q.where, And) else [q.where] if q.where is not None else []:
                if isinstance(p, Pred) and p.op == "=" and isinstance(p.left, Col) and isinstance(p.right, Col) and inside(p.left) != inside(p.right):
                    keys.append((p.left, p.right) if inside(p.left) else (p.right, p.left))
                else:
                    rest.append(p)
            if not keys:
                raise Refusal("EXISTS needs an equality with a column outside")
            q = replace(q, where=None if not rest else rest[0] if len(rest) == 1 else And(tuple(rest)), select=tuple(Item(c, f"key_{i}") for i, (c, _) in enumerate(keys)))
        seen: set = set()
        aliases = {}
        for alias, table in names.items():
            if table in seen:
                aliases[alias] = table
            seen.add(table)
        columns = {t: self._outputs(t) for t in names.values()}

        def change(x):
            if isinstance(x, Col):
                if x.table:
                    if x.table not in names and x.table not in names.values():
                        raise Refusal(f"unknown table {x.table}")
                    return x if x.table in aliases else Col(names.get(x.table, x.table), x.name)
                own = [a for a, t in names.items() if x.name in columns[t]]
                if len(own) != 1:
                    raise Refusal(f"column {x.name} is {'ambiguous' if own else 'unknown'}")
                return Col(own[0] if own[0] in aliases else names[own[0]], x.name)
            return x

        q = rebuild(q, change)
        tables = tuple(t for t in dict.fromkeys(names.values()) if t in self.catalog.tables)
        extra = []
        preserve: list[str] = []
        for kind, on in joined:
            on = rebuild(on, change)
            pairs = on.args if isinstance(on, And) else (on,)
            for p in pairs:
                if not (isinstance(p, Pred) and p.op == "=" and isinstance(p.left, Col) and isinstance(p.right, Col)):
                    raise Refusal("joins compare columns for equality")
            ends = {c.table for p in pairs for c in (p.left, p.right)}
            known = [k for k in self.catalog.foreign_keys if {k.table, k.parent} == ends and {frozenset(((k.table, a), (k.parent, b))) for a, b in zip(k.columns, k.parent_columns, strict=True)} == {frozenset(((p.left.table, p.left.name), (p.right.table, p.right.name))) for p in pairs}]
            if known:
                if kind == "left":
                    preserve.append(next(t for t in names.values() if t in ends))
            elif kind == "left":
                raise Refusal("a left join needs a declared key")
            else:
                extra += pairs
        where = [w for w in (q.where, *extra) if w is not None]
        if probe:
            self.found_keys = [c for _, c in keys]
        lifted = [replace(s, **_emission(s, q)) for s in self.lifted]
        for left, inner, emit in self.probes:
            own = [i.alias or getattr(i.expr, "name", "") for i in inner.select]
            at = [change(c) for c in left]
            lifted.append(Step(f"probe_{len(lifted)}_{emit}", inner, emit, tuple((o, f"{c.table}.{c.name}") for o, c in zip(own, at, strict=True))))
        return replace(q, tables=tuple(dict.fromkeys((*tables, *(t for t in names.values() if t in self.steps)))), where=None if not where else where[0] if len(where) == 1 else And(tuple(where)), aliases=tuple(aliases.items()), preserve=tuple(dict.fromkeys(preserve)), steps=(*q.steps, *lifted))

    def _outputs(self, table: str) -> set[str]:
        if table in self.steps:
            return {i.alias or getattr(i.expr, "name", "") for i in self.steps[table].select}
        return set(self.catalog.table(table).columns)

    def _list(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def _items(self) -> list[Item]:
        if self.peek() == "*":
            raise Refusal("SELECT *: name the columns")

        def one() -> Item:
            x = self.expression()
            alias = ""
            if self.take("as") or (self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.peek() not in _CLAUSES):
                alias = self.name()
            return Item(x, alias)

        return self._list(one)

    def order(self) -> Order:
        x = self.expression()
        descending = self.take("asc", "desc") == "desc"
        nulls = self.need("first", "last") if self.take("nulls") else ""
        return Order(x, descending, nulls)

    # predicates

    def predicate(self, probes: bool = False):
        """None where all of it became probes, which only a WHERE clause may hold, and no OR."""
        before = len(self.probes)
        parts = [self._and(probes)]
        while self.take("or"):
            parts.append(self._and(probes))
        if len(parts) > 1 and len(self.probes) > before:
            raise Refusal("a subquery beside OR")
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def _and(self, probes: bool = False):
        parts = [self._leaf(probes)]
        while self.take("and"):
            parts.append(self._leaf(probes))
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))

    def _probe(self, left: list | None, negated: bool, allowed: bool) -> None:
        """IN or EXISTS a subquery, read behind its opening bracket."""
        if not allowed:
            raise Refusal("a subquery outside of WHERE")
        inner = self.select(probe=left is None)
        self.need(")")
        if left is None:
            left = self.found_keys
        if len(inner.select) != len(left) or not all(isinstance(c, Col) for c in left):
            raise Refusal("a subquery is compared with a column")
        self.probes.append((left, inner, "anti" if negated else "semi"))

    def _leaf(self, probes: bool = False):
        if self.peek() == "exists" or self.peek() == "not" and self.peek(1) == "exists":
            negated = bool(self.take("not"))
            self.need("exists")
            self.need("(")
            return self._probe(None, negated, probes)
        if self.take("not"):
            before = len(self.probes)
            inner = self._leaf(probes)
            if len(self.probes) > before:
                raise Refusal("NOT before a subquery in brackets")
            return negate(inner)
        if self.peek() == "(":
            saved, held = self.at, len(self.probes)
            self.at += 1
            try:
                inner = self.predicate(probes)
                self.need(")")
                return inner
            except Refusal:
                self.at = saved
                del self.probes[held:]
        left = self.expression()
        if self.take("is"):
            op = "is not null" if self.take("not") else "is null"
            self.need("null")
            return Pred(left, op)
        negated = bool(self.take("not"))
        word = self.take("in", "like", "ilike", "between")
        if word == "in":
            self.need("(")
            if self.peek() == "select":
                return self._probe([left], negated, probes)
            values = self._list(self.expression)
            self.need(")")
            return Pred(left, "not in" if negated else "in", tuple(values))
        if word == "between":
            low = self.expression()
            self.need("and")
            high = self.expression()
            return Or((Pred(left, "<", low), Pred(left, ">", high))) if negated else And((Pred(left, ">=", low), Pred(left, "<=", high)))
        if word:
            right, escape = self.expression(), ""
            if self.take("escape"):
                given = self.expression()
                if not (isinstance(given, Lit) and isinstance(given.value, str) and len(given.value) <= 1):
                    raise Refusal("ESCAPE takes one character")
                escape = given.value
            return Pred(left, f"not {word}" if negated else word, right, escape)
        op = self.need("=", "<>", "!=", "<", "<=", ">", ">=")
        return Pred(left, "!=" if op == "<>" else op, self.expression())

    # expressions

    def expression(self):
        x = self._term()
        while op := self.take("+", "-", "||"):
            y = self._term()
            x = Call("concat", (x, y)) if op == "||" else Arith(op, (x, y))
        return x

    def _term(self):
        x = self._factor()
        while op := self.take("*", "/"):
            x = Arith(op, (x, self._factor()))
        return x

    def _factor(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        low = text.lower()
        if kind == "number":
            self.at += 1
            return Lit(float(text) if "." in text else int(text))
        if kind == "string":
            self.at += 1
            return Lit(text[1:-1].replace("''", "'"))
        if self.take("-"):
            x = self._factor()
            return Lit(-x.value) if isinstance(x, Lit) else Arith("-", (Lit(0), x))
        if self.take("("):
            x = self.expression()
            self.need(")")
            return x
        if low in ("date", "timestamp") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "string":
            self.at += 2
            return Lit(self.tokens[self.at - 1][1][1:-1], "date" if low == "date" else "timestamp_ntz")
        if self.take("interval"):
            amount = self._factor()
            unit = self.name() if isinstance(amount, Lit) and str(amount.value).lstrip("-").isdigit() else ""
            if not unit:
                number, _, unit = str(amount.value).partition(" ")
                amount = Lit(int(number))
            return Interval(int(amount.value), dates.unit(unit))
        if low in ("current_date", "current_timestamp"):
            self.at += 1
            return Now("date" if low == "current_date" else "timestamp_ntz")
        if low in ("null", "true", "false"):
            self.at += 1
            return Lit({"null": None, "true": True, "false": False}[low])
        if self.take("case"):
            return self._case()
        if self.take("cast"):
            self.need("(")
            x = self.expression()
            self.need("as")
            kind = self.name()
            if self.take("("):
                kind += "(" + ",".join(str(v.value) for v in self._list(self.expression)) + ")"
                self.need(")")
            if kind.lower() in ("json", "jsonb"):
                raise Refusal("JSON path is not supported")
            self.need(")")
            return Cast(x, kind.lower())
        if kind != "name" or low in _CLAUSES:
            raise Refusal(f"unexpected {text or 'end'}")
        name = self.name()
        if self.take("."):
            return Col(name, self.name())
        if self.take("("):
            return self._call(name.lower())
        return Col("", name)

    def _case(self):
        branches, otherwise = [], None
        while self.take("when"):
            p = self.predicate()
            self.need("then")
            branches.append((p, self.expression()))
        if self.take("else"):
            otherwise = self.expression()
        self.need("end")
        return Case(tuple(branches), otherwise)

    def _call(self, name: str):
        distinct = bool(self.take("distinct"))
        args: list = []
        unit = ""
        if name == "extract":
            unit = self.name()
            self.need("from")
            args = [self.expression()]
        elif self.take("*"):
            args = []
        elif self.peek() != ")":
            args = self._list(self.expression)
        order: tuple = ()
        if self.take("order"):
            self.need("by")
            order = tuple(self._list(self.order))
        self.need(")")
        if name in ("date_trunc", "date_part"):
            unit, args = str(args[0].value), args[1:]
        name = {"stddev_samp": "stddev", "stddev_pop": "stddev", "var_samp": "variance", "var_pop": "variance", "listagg": "string_agg", "mean": "avg", "char_length": "length", "ceiling": "ceil"}.get(name, name)
        if self.take("over"):
            return self._window(name, args)
        if name in aggregates.WHITELIST:
            separator = str(args[1].value) if name == "string_agg" and len(args) > 1 else None
            return Agg(name, args[0] if args else None, distinct, separator, order)
        if name not in scalars.WHITELIST:
            raise Refusal(f"function {name} is not in the whitelist")
        return Call(name, tuple(args), dates.unit(unit) if unit else "")

    def _window(self, name: str, args: list):
        if name not in windows.WHITELIST:
            raise Refusal(f"window function {name} is not in the whitelist")
        self.need("(")
        partition: list = []
        order: list = []
        frame = None
        if self.take("partition"):
            self.need("by")
            partition = self._list(self.expression)
        if self.take("order"):
            self.need("by")
            order = self._list(self.order)
        if kind := self.take("rows", "range"):
            if self.take("between"):
                start = self._bound()
                self.need("and")
                end = self._bound()
            else:
                start, end = self._bound(), 0
            frame = Frame(kind, start, end)
        self.need(")")
        n = int(args[-1].value) if name in windows.COUNTED and args else None
        arg = args[0] if args and name != "ntile" else None
        return Window(name, arg, n, tuple(partition), tuple(order), frame)

    def _bound(self) -> int | None:
        if self.take("unbounded"):
            self.need("preceding", "following")
            return None
        if self.take("current"):
            self.need("row")
            return 0
        n = int(self._factor().value)
        return -n if self.need("preceding", "following") == "preceding" else n


_OPPOSITE = {"=": "!=", "<": ">=", "<=": ">", "in": "not in", "like": "not like", "ilike": "not ilike", "is null": "is not null"}
_OPPOSITE |= {b: a for a, b in _OPPOSITE.items()}


def negate(p):
    """The opposite of a condition: NOT moves down to the comparisons."""
    if isinstance(p, (And, Or)):
        return (Or if isinstance(p, And) else And)(tuple(map(negate, p.args)))
    if not isinstance(p, Pred) or p.op not in _OPPOSITE:
        raise Refusal("this condition cannot be negated")
    return replace(p, op=_OPPOSITE[p.op])


def _first_only(q: Query) -> Query:
    """The wrapper that keeps row number 1 of each partition becomes DISTINCT ON over the query inside."""
    numbered = [s for s in q.steps if s.emit == "table" and q.tables == (s.name,)]
    if len(numbered) != 1 or not isinstance(q.where, Pred) or q.where.op != "=" or q.where.right != Lit(1) or q.group_by or q.having or q.distinct or q.aliases:
        return q
    s = numbered[0]
    own = {i.alias or getattr(i.expr, "name", ""): i.expr for i in s.query.select}
    window = own.get(q.where.left.name) if isinstance(q.where.left, Col) else None
    rest = {n: x for n, x in own.items() if x is not window}
    wanted = [i for i in q.select if isinstance(i.expr, Col) and i.expr.name in rest]
    if not isinstance(window, Window) or window.func != "row_number" or not window.partition or len(wanted) != len(q.select) or q.order_by or q.limit is not None or s.query.limit is not None or s.query.order_by or s.query.group_by or any(isinstance(x, Window) for x in rest.values()):
        return q
    order = (*(Order(x) for x in window.partition), *window.order)
    return replace(s.query, select=tuple(Item(rest[i.expr.name], i.alias or i.expr.name) for i in wanted), distinct_on=tuple(window.partition), order_by=order, steps=(*(x for x in q.steps if x is not s), *s.query.steps))


def _emission(s: Step, q: Query) -> dict:
    """A step that aggregates everything to one row, and is no joined source, is a scalar."""
    return {"emit": "scalar"} if not s.query.group_by and has_aggregate(s.query.select) else {}


def parse(text: str, catalog: Catalog) -> Query:
    """The specification of a SELECT statement; anything outside the subset is refused."""
    check_sql(text)
    return _Parser(text, catalog).statement()
