"""The catalog: tables, columns, keys and profiles, kept beside the DataFrames and saved as JSON."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from itertools import combinations
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .spec import Refusal

ROLES = ("key", "measure", "category", "flag", "date", "text", "unknown")
TEXT_LIKE = (T.StringType, T.CharType, T.VarcharType)


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    role: str = "unknown"
    sensitivity: str = "none"  # none, restricted (no grouping, sorting or filtering), hidden
    fixed_width: bool = False
    case_insensitive: bool = False
    description: str = ""
    stats: dict = field(default_factory=dict)

    @property
    def value_type(self) -> str:
        """The logical type: integer, number, string, date, boolean, binary, array or unknown."""
        t = self.type.split("(")[0].split("<")[0]
        for kind, names in VALUE_TYPES.items():
            if t in names:
                return kind
        return "unknown"

    @property
    def exact(self) -> bool:
        return self.type.startswith("decimal")


#: Spark's types by logical type.
VALUE_TYPES = {
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "number": ("float", "double", "decimal"),
    "string": ("string", "char", "varchar"),
    "date": ("date", "timestamp", "timestamp_ntz", "time"),
    "boolean": ("boolean",),
    "binary": ("binary",),
    "array": ("array",),
}


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    origin: str = "declared"  # declared, same_name, suffix, prefix, composite, overlap


@dataclass
class Table:
    name: str
    columns: dict[str, Column]
    primary_key: tuple[str, ...] = ()
    kind: str = "table"  # table, view, materialized_view
    row_count: int | None = None
    source: str = ""
    required_filters: tuple[str, ...] = ()  # a query must filter one of these (partition columns)
    role: str = ""
    base_tables: tuple[str, ...] = ()


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    denied_tables: frozenset = frozenset()
    denied_columns: frozenset = frozenset()  # of "table.column"

    def table(self, name: str) -> Table:
        if name in self.denied_tables or name not in self.tables:
            raise Refusal(f"no table {name} in scope")
        return self.tables[name]

    def column(self, table: str, name: str) -> Column:
        found = self.table(table).columns.get(name)
        if found is None or f"{table}.{name}" in self.denied_columns or found.sensitivity == "hidden":
            raise Refusal(f"no column {table}.{name} in scope")
        return found

    def unique(self, table: str, columns: tuple[str, ...]) -> bool:
        key = self.tables[table].primary_key if table in self.tables else ()
        return bool(key) and set(key) <= set(columns)

    def scoped(self, allow: set[str] | None = None, deny: set[str] = frozenset(), deny_columns: set[str] = frozenset()) -> Catalog:
        """The catalog that a consumer with these permissions sees; edges to what is out of scope go too."""
        names = {n for n in self.tables if (allow is None or n in allow) and n not in deny}
        tables = {n: replace(t, columns={c: v for c, v in t.columns.items() if f"{n}.{c}" not in deny_columns}) for n, t in self.tables.items() if n in names}
        keys = [k for k in self.foreign_keys if k.table in names and k.parent in names and all(c in tables[k.table].columns for c in k.columns) and all(c in tables[k.parent].columns for c in k.parent_columns)]
        return Catalog(tables, keys, self.denied_tables, self.denied_columns)

    # --- building and persistence

    @staticmethod
    def reflect(frames: dict[str, DataFrame], primary_keys: dict[str, tuple] | None = None, foreign_keys: list[ForeignKey] = (), source: str = "") -> Catalog:
        """From the schemas of DataFrames; keys come from the caller (Parquet declares none). Types that cannot be queried are refused on use."""
        tables = {}
        for name, df in frames.items():
            columns = {}
            for f in df.schema.fields:
                text = f.dataType.simpleString()
                meta = f.metadata or {}
                raw = str(meta.get("__CHAR_VARCHAR_TYPE_STRING", ""))
                columns[f.name] = Column(f.name, text, f.nullable, fixed_width=raw.startswith("char"), case_insensitive=isinstance(f.dataType, T.StringType) and "LCASE" in text.upper() or "_CI" in text.upper())
            key = tuple((primary_keys or {}).get(name, ()))
            for c in key:
                columns[c].nullable = False
                columns[c].role = "key"
            tables[name] = Table(name, columns, key, source=source)
        catalog = Catalog(tables, list(foreign_keys))
        for k in catalog.foreign_keys:
            for c in k.columns:
                tables[k.table].columns[c].role = "key"
        return catalog

    @staticmethod
    def of_session(spark, names: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables and views that the session's catalog lists."""
        return {t.name: spark.table(t.name) for t in spark.catalog.listTables() if names is None or t.name in names}

    def to_json(self) -> str:
        return json.dumps({"tables": {n: asdict(t) for n, t in self.tables.items()}, "foreign_keys": [asdict(k) for k in self.foreign_keys], "denied_tables": sorted(self.denied_tables), "denied_columns": sorted(self.denied_columns)}, sort_keys=True, default=str)

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw = json.loads(text)
        tables = {n: Table(**(t | {"columns": {c: Column(**v) for c, v in t["columns"].items()}, "primary_key": tuple(t["primary_key"]), "required_filters": tuple(t["required_filters"]), "base_tables": tuple(t["base_tables"])})) for n, t in raw["tables"].items()}
        keys = [ForeignKey(**(k | {"columns": tuple(k["columns"]), "parent_columns": tuple(k["parent_columns"])})) for k in raw["foreign_keys"]]
        return Catalog(tables, keys, frozenset(raw["denied_tables"]), frozenset(raw["denied_columns"]))

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @staticmethod
    def load(path: str) -> Catalog:
        return Catalog.from_json(Path(path).read_text())

    # --- identity and change

    def hashes(self) -> dict[str, str]:
        """Fingerprints of the structure, of the profiles, and of the scope."""
        structure = {n: (sorted((c.name, c.type, c.nullable) for c in t.columns.values()), t.primary_key, t.kind) for n, t in self.tables.items()}
        edges = sorted((k.table, k.columns, k.parent, k.parent_columns) for k in self.foreign_keys)
        profile = {n: (t.row_count, sorted((c.name, sorted(c.stats.items(), key=str)) for c in t.columns.values())) for n, t in self.tables.items()}
        scope = (sorted(self.tables), sorted(self.denied_tables), sorted(self.denied_columns))
        of = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()
        return {"structural": of([structure, edges]), "profiling": of(profile), "scope": of(scope)}

    def diff(self, newer: Catalog, likeness: float = 0.6) -> dict:
        """What changed: tables and columns added, removed, retyped, or renamed (by overlap of frequent values and type)."""
        out: dict = {"added_tables": sorted(newer.tables.keys() - self.tables.keys()), "removed_tables": sorted(self.tables.keys() - newer.tables.keys()), "added_columns": [], "removed_columns": [], "retyped": [], "renamed_columns": [], "renamed_tables": []}
        for name in sorted(self.tables.keys() & newer.tables.keys()):
            a, b = self.tables[name].columns, newer.tables[name].columns
            gone, new = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
            for x in list(gone):
                best = max(((_likeness(a[x], b[y]), y) for y in new), default=(0, ""))
                if best[0] >= likeness:
                    out["renamed_columns"].append((name, x, best[1]))
                    gone.remove(x)
                    new.remove(best[1])
            out["added_columns"] += [(name, c) for c in new]
            out["removed_columns"] += [(name, c) for c in gone]
            out["retyped"] += [(name, c, a[c].type, b[c].type) for c in sorted(a.keys() & b.keys()) if a[c].type != b[c].type]
        for x in list(out["removed_tables"]):
            signature = lambda t: {(c.name, c.type) for c in t.columns.values()}
            best = max(((_jaccard(signature(self.tables[x]), signature(newer.tables[y])), y) for y in out["added_tables"]), default=(0, ""))
            if best[0] >= likeness:
                out["renamed_tables"].append((x, best[1]))
                out["removed_tables"].remove(x)
                out["added_tables"].remove(best[1])
        breaking = out["removed_tables"] or out["removed_columns"] or out["retyped"]
        out["tier"] = "breaking" if breaking else "renaming" if out["renamed_columns"] or out["renamed_tables"] else "additive" if out["added_tables"] or out["added_columns"] else "none"
        return out

    # --- views

    def reduce_covers(self) -> Catalog:
        """Drops base tables whose columns a view in scope shows in full, and points their edges at the view."""
        covers = {}
        for name, t in self.tables.items():
            if t.kind != "table" and len(t.base_tables) == 1 and (base := self.tables.get(t.base_tables[0])) and base.columns.keys() <= t.columns.keys():
                covers[base.name] = name
        keys = [replace(k, table=covers.get(k.table, k.table), parent=covers.get(k.parent, k.parent)) for k in self.foreign_keys]
        return replace(self, tables={n: t for n, t in self.tables.items() if n not in covers}, foreign_keys=list(dict.fromkeys(keys)))

    def project_view_keys(self) -> Catalog:
        """Gives views the keys of their base tables whose columns they show under the same names."""
        tables, keys = dict(self.tables), list(self.foreign_keys)
        for name, t in self.tables.items():
            for base in (self.tables[b] for b in t.base_tables if b in self.tables):
                if len(t.base_tables) == 1 and base.primary_key and set(base.primary_key) <= t.columns.keys():
                    tables[name] = replace(tables[name], primary_key=base.primary_key)
                keys += [replace(k, table=name) for k in self.foreign_keys if k.table == base.name and set(k.columns) <= t.columns.keys()]
        return replace(self, tables=tables, foreign_keys=list(dict.fromkeys(keys)))

    # --- names for people

    def descriptive_columns(self, table: str) -> list[str]:
        """The columns that name a row best: a name or title, or a pair of first and last names."""
        t = self.tables[table]
        texts = [c for c in t.columns.values() if c.value_type == "string" and c.sensitivity == "none"]
        stem = lambda c: c.name.split("_")[-1].lower()
        pair = [next((c.name for c in texts if c.name.lower().endswith(e)), None) for e in ("first_name", "last_name")]
        if all(pair):
            return pair
        weight = {"name": 3, "title": 3, "label": 2, "description": 1}
        scored = sorted(texts, key=lambda c: (-weight.get(stem(c), 0), -float(c.stats.get("distinct_ratio", 0)), c.name))
        return [scored[0].name] if scored and weight.get(stem(scored[0])) else []

    def usable(self, table: str, column: str) -> bool:
        """False for columns that say nothing: one value, hardly any value, or nearly always the same one."""
        s = self.column(table, column).stats
        return not s or not (s.get("distinct", 2) <= 1 or s.get("null_ratio", 0) >= 0.99 or s.get("mode_ratio", 0) >= 0.99)

    def pairs(self):
        return combinations(sorted(self.tables), 2)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def _likeness(a: Column, b: Column) -> float:
    if a.value_type != b.value_type:
        return 0.0
    values = [set(map(str, x.stats.get("frequent", {}))) for x in (a, b)]
    if all(values):
        return _jaccard(*values)
    words = [set(x.name.lower().split("_")) for x in (a, b)]
    return _jaccard(*words)
