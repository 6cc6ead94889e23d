"""Several sources as one: logical tables (unions and replicas), joins across sources, and the checks around them.

Sources are DataFrames; nothing is moved to a coordinator. Spark sees one plan and pushes filters and columns to each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sets
from .catalog import Catalog, Column, ForeignKey, Table
from .spec import Agg, And, Col, Item, Query, Refusal, Step, walk


@dataclass(frozen=True)
class Member:
    """A source's part of a logical table; ``columns`` maps logical names to the source's own."""

    source: str
    table: str
    columns: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Logical:
    name: str
    kind: str  # union or replica
    members: tuple[Member, ...]
    authoritative: str = ""  # the replica to read
    union_key: tuple[str, ...] = ()


@dataclass(frozen=True)
class CrossJoin:
    """A declared join of tables in different sources; kinds other than inner and left are refused."""

    left: str
    left_columns: tuple[str, ...]
    right: str
    right_columns: tuple[str, ...]
    kind: str = "inner"


@dataclass
class Federation:
    """Composes the sources' frames and catalogs into one; ``sources`` maps a name to (frames, catalog)."""

    sources: dict[str, tuple[dict[str, DataFrame], Catalog]]
    logical: tuple[Logical, ...] = ()
    joins: tuple[CrossJoin, ...] = ()
    most_members: int = 8

    def compose(self) -> tuple[dict[str, DataFrame], Catalog]:
        if len(self.sources) > self.most_members:
            raise Refusal(f"more than {self.most_members} sources")
        frames: dict[str, DataFrame] = {}
        catalog = Catalog()
        hidden = {(m.source, m.table) for l in self.logical for m in l.members}
        for source, (own, known) in self.sources.items():
            for name, df in own.items():
                if (source, name) in hidden:
                    continue
                if name in frames:
                    raise Refusal(f"table {name} is in two sources and not declared as a union or a replica")
                frames[name] = utc(df)
                catalog.tables[name] = replace(known.tables[name], source=source)
            catalog.foreign_keys += [k for k in known.foreign_keys if (source, k.table) not in hidden and (source, k.parent) not in hidden]
        for l in self.logical:
            frames[l.name], catalog.tables[l.name] = self._collapse(l)
        for l in self.logical:
            for m in l.members:
                to = {own: name for name, own in m.columns}
                for k in self.sources[m.source][1].foreign_keys:
                    if k.table == m.table:
                        catalog.foreign_keys.append(replace(k, table=l.name, columns=tuple(to.get(c, c) for c in k.columns)))
                    elif k.parent == m.table:
                        catalog.foreign_keys.append(replace(k, parent=l.name, parent_columns=tuple(to.get(c, c) for c in k.parent_columns)))
        catalog.foreign_keys = [k for k in dict.fromkeys(catalog.foreign_keys) if k.table in frames and k.parent in frames]
        for j in self.joins:
            if j.kind not in ("inner", "left"):
                raise Refusal(f"{j.kind} join across sources")
            catalog.foreign_keys.append(ForeignKey(j.left, j.left_columns, j.right, j.right_columns))
            frames[j.left], frames[j.right] = harmonise(frames[j.left], j.left_columns, frames[j.right], j.right_columns)
            for c in j.left_columns:
                catalog.tables[j.left].columns[c].nullable = j.kind == "left"
        return frames, catalog

    def _collapse(self, l: Logical) -> tuple[DataFrame, Table]:
        parts, tables = [], []
        for m in l.members:
            frames, catalog = self.sources[m.source]
            table = catalog.tables[m.table]
            to = {own: name for name, own in m.columns}
            parts.append(utc(frames[m.table]).withColumnsRenamed(to))
            tables.append(replace(table, name=l.name, columns={to.get(c, c): replace(v, name=to.get(c, c)) for c, v in table.columns.items()}, primary_key=tuple(to.get(c, c) for c in table.primary_key), source=m.source))
        if l.kind == "replica":
            k = next((i for i, m in enumerate(l.members) if m.source == l.authoritative), None)
            if k is None:
                raise Refusal(f"replica {l.name} names no authoritative member")
            return parts[k], tables[k]
        shared = reduce(lambda a, b: a & b, (t.columns.keys() for t in tables))
        if not shared:
            raise Refusal(f"the members of {l.name} share no columns")
        order = [c for c in tables[0].columns if c in shared]
        columns = {c: _merged([t.columns[c] for t in tables]) for c in order}
        return sets.union_all([p.select(*order) for p in parts], columns={c: v.type for c, v in columns.items()}), replace(tables[0], columns=columns, source="", row_count=sum(t.row_count or 0 for t in tables) or None)

    def check_disjoint(self, name: str) -> None:
        """Refuses a union whose members share keys: their rows would count twice (runs a semi join for each pair)."""
        l = next(x for x in self.logical if x.name == name)
        if not l.union_key:
            raise Refusal(f"union {name} names no key: an overlap cannot be ruled out")
        keys = [self.sources[m.source][0][m.table].withColumnsRenamed({own: n for n, own in m.columns}).select(*l.union_key) for m in l.members]
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if a.join(b, list(l.union_key), "left_semi").take(1):
                    raise Refusal(f"members of union {name} overlap")

    def replica_differences(self, name: str) -> dict[str, tuple[int, int]]:
        """Rows that each replica lacks of the authoritative one, and rows that it has beyond it."""
        l = next(x for x in self.logical if x.name == name)
        read = {m.source: self.sources[m.source][0][m.table].withColumnsRenamed({own: n for n, own in m.columns}) for m in l.members}
        head = read.pop(l.authoritative)
        return {s: (sets.except_all(head, df.select(*head.columns)).count(), sets.except_all(df.select(*head.columns), head).count()) for s, df in read.items()}


def _merged(columns: list[Column]) -> Column:
    types = {c.type for c in columns}
    return replace(columns[0], type=types.pop() if len(types) == 1 else _wider([c.type for c in columns]), nullable=any(c.nullable for c in columns))


def _wider(types: list[str]) -> str:
    order = ["tinyint", "smallint", "int", "bigint", "decimal(38,9)", "double", "string"]
    place = [next((i for i, t in enumerate(order) if x.split("(")[0] == t.split("(")[0]), len(order) - 1) for x in types]
    return order[max(place)]


def utc(df: DataFrame) -> DataFrame:
    """Timestamps with a time zone become UTC wall clock: sources compare alike."""
    return df.withColumns({c: F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")) for c, t in df.dtypes if t == "timestamp"})


def harmonise(left: DataFrame, left_columns: tuple, right: DataFrame, right_columns: tuple) -> tuple[DataFrame, DataFrame]:
    """Casts both sides of a key to their common type."""
    for a, b in zip(left_columns, right_columns, strict=True):
        ta, tb = left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()
        if ta != tb:
            to = _wider([ta, tb])
            left, right = left.withColumn(a, F.col(a).cast(to)), right.withColumn(b, F.col(b).cast(to))
    return left, right


def semi_instead_of_fan_out(q: Query, catalog: Catalog) -> Query:
    """Tables that only filter, and would repeat the rows of an aggregate, become probes on their distinct keys."""
    read = {c.table for c in walk((q.select, q.group_by, q.having, q.order_by)) if isinstance(c, Col)}
    if not any(isinstance(x, Agg) for x in walk(q.select)):
        return q
    parts = list(q.where.args) if isinstance(q.where, And) else [q.where] if q.where is not None else []
    steps, tables = list(q.steps), list(q.tables)
    for t in q.tables:
        if t in read or t not in catalog.tables:
            continue
        key = next((k for k in catalog.foreign_keys if k.table == t and k.parent in tables and k.parent != t), None)
        if key is None:
            continue
        own = [p for p in parts if {c.table for c in walk(p) if isinstance(c, Col)} == {t}]
        inner = Query(select=tuple(Item(Col(t, c)) for c in key.columns), tables=(t,), where=None if not own else own[0] if len(own) == 1 else And(tuple(own)))
        steps.append(Step(f"only_{t}", inner, "semi", tuple((c, f"{key.parent}.{p}") for c, p in zip(key.columns, key.parent_columns, strict=True))))
        parts = [p for p in parts if p not in own]
        tables.remove(t)
    return replace(q, steps=tuple(steps), tables=tuple(tables), where=None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts)))


def cross_source_average(total: str, count: str, scale: int | None = None):
    """AVG over partial sums and counts of several sources; exact when a decimal scale is given."""
    ratio = F.sum(total) / F.nullif(F.sum(count), F.lit(0))
    return ratio if scale is None else ratio.cast(f"decimal(38,{scale + 6})")


def semijoin_keys(driver: DataFrame, column: str, most: int = 10_000) -> list | None:
    """Distinct keys to send to a database as an IN list; None beyond ``most`` (Spark's own runtime filters serve there)."""
    keys = [r[0] for r in driver.select(column).dropna().distinct().limit(most + 1).collect()]
    return None if len(keys) > most else sorted(keys)


def check_combined(result: DataFrame, left: DataFrame, right: DataFrame | None = None) -> None:
    """Strict mode: refuses a combined result with more rows than a side that it must not repeat (runs counts)."""
    n = result.count()
    for side in (left, *([right] if right is not None else [])):
        if n > side.count():
            raise Refusal("the combined result repeats rows of a member")

