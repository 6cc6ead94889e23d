"""Profiles of tables, and what they let one infer: keys, foreign keys, roles, overlaps.

All columns of a table are measured in one aggregation; frequent values come from one more over all columns at once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Column, ForeignKey

FREQUENT, OVERLAP_SAMPLE = 20, 100
SAMPLE_ABOVE, SAMPLE_ROWS = 100_000, 10_000


def _profiled(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t != "binary" and not t.startswith(("array", "map", "struct"))]


def column_stats(df: DataFrame) -> DataFrame:
    """A row for each column: rows, distinct values, nulls, least and greatest value as text."""
    names = _profiled(df)
    bounded = {c for c, t in df.dtypes if t.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"))}
    measured = df.agg(F.count(F.lit(1)).alias("n"), *[a for c in names for a in (F.count_distinct(c).alias(f"d_{c}"), F.count(c).alias(f"c_{c}"), *((F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}")) if c in bounded else ()))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"d_{c}").alias("n_distinct"), (F.col("n") - F.col(f"c_{c}")).alias("n_null"), (F.col(f"l_{c}").cast("string") if c in bounded else F.lit(None).cast("string")).alias("least"), (F.col(f"h_{c}").cast("string") if c in bounded else F.lit(None).cast("string")).alias("greatest")) for c in names]
    return measured.select(F.inline(F.array(*rows)))


def frequent_values(df: DataFrame, k: int = FREQUENT, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values of each column as text; ties go to the smaller text."""
    names = columns or _profiled(df)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names])).alias("p")).select("p.*").dropna()
    counted = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place.cast("bigint")).filter(F.col("place") <= k)


def overlap_sample(df: DataFrame, column: str, k: int = OVERLAP_SAMPLE) -> DataFrame:
    """The first ``k`` distinct values in ascending order, as text."""
    return df.select(F.col(column).cast("string").alias("value")).dropna().distinct().orderBy("value").limit(k)


def composite_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count_distinct(F.concat_ws(" ", *columns)).alias("n_distinct"))


def array_elements(df: DataFrame, column: str) -> DataFrame:
    """Distinct elements of an array column."""
    return df.select(F.explode(column).alias("element")).distinct()


def profile(frames: dict[str, DataFrame], catalog: Catalog, seed: int = 0) -> Catalog:
    """Fills the catalog's statistics and roles. Tables of over 100,000 rows are sampled with a seed, as declared."""
    for name, df in frames.items():
        table = catalog.tables[name]
        table.row_count = df.count()
        sampled = table.row_count > SAMPLE_ABOVE
        seen = df.sample(SAMPLE_ROWS / table.row_count, seed) if sampled else df
        frequent: dict[str, dict] = {}
        for r in frequent_values(seen).collect():
            frequent.setdefault(r["column_name"], {})[r["value"]] = r["n"]
        for r in column_stats(seen).collect():
            c = table.columns[r["column_name"]]
            filled = r["n_rows"] - r["n_null"]
            own = frequent.get(c.name, {})
            c.stats = {"rows": r["n_rows"], "distinct": r["n_distinct"], "distinct_ratio": r["n_distinct"] / filled if filled else 0.0, "null_ratio": r["n_null"] / r["n_rows"] if r["n_rows"] else 0.0, "min": r["least"], "max": r["greatest"], "mode_ratio": max(own.values(), default=0) / filled if filled else 0.0, "frequent": own, "sampled": sampled}
            c.role = infer_role(c)
    return catalog


def infer_role(c: Column) -> str:
    s = c.stats
    values = {str(v).lower() for v in s.get("frequent", {})}
    if c.value_type == "boolean":
        return "flag"
    if c.role == "key" or c.name.lower().endswith(("_id", "_key", "key")):
        return "key"
    if s.get("distinct", 0) and s["distinct"] <= 2 and values <= {"0", "1", "y", "n", "yes", "no", "t", "f", "true", "false"}:
        return "flag"
    if c.value_type == "date":
        return "date"
    if c.value_type == "string":
        return "text" if s.get("distinct", 0) > 1000 or s.get("distinct_ratio", 0) > 0.9 else "category"
    if c.value_type in ("integer", "number"):
        return "category" if c.value_type == "integer" and 0 < s.get("distinct", 0) <= 20 else "measure"
    return "unknown"


def infer_primary_keys(frames: dict[str, DataFrame], catalog: Catalog) -> dict[str, tuple[str, ...]]:
    """Keys of tables without one: a column, else a pair, without nulls and repeats; checked on the whole table."""
    found = {}
    for name, t in catalog.tables.items():
        if t.primary_key:
            continue
        whole = [c.name for c in t.columns.values() if c.stats and c.stats["null_ratio"] == 0]
        one = [c for c in whole if t.columns[c].stats["distinct_ratio"] == 1 and t.columns[c].value_type in ("integer", "string")]
        one.sort(key=lambda c: (t.columns[c].role != "key", list(t.columns).index(c)))
        keys = [c for c in whole if t.columns[c].role == "key"]
        for key in (*((c,) for c in one), *combinations(keys, 2)):
            if not frames[name].groupBy(*key).count().filter("count > 1").take(1):
                found[name] = t.primary_key = tuple(key)
                break
    return found


def containment(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> float:
    """Share of the distinct values of a column that the other column holds."""
    own = child.select(F.col(column).alias("v")).dropna().distinct()
    held = own.join(parent.select(F.col(parent_column).alias("v")).distinct().withColumn("hit", F.lit(1)), "v", "left")
    r = held.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return r["hits"] / r["n"] if r["n"] else 0.0


def infer_foreign_keys(frames: dict[str, DataFrame], catalog: Catalog, least_containment: float = 0.6) -> list[ForeignKey]:
    """Edges that names suggest (the same name, a table's name before _id or _key, the same name after a short prefix) and values bear out."""
    known = {(k.table, k.columns) for k in catalog.foreign_keys}
    found = []
    for parent in catalog.tables.values():
        if len(parent.primary_key) != 1:
            continue
        key = parent.columns[parent.primary_key[0]]
        stems = {parent.name.lower(), parent.name.lower().rstrip("s")}
        for t in catalog.tables.values():
            for c in t.columns.values():
                if t.name == parent.name or (t.name, (c.name,)) in known or c.value_type != key.value_type or c.name in t.primary_key and len(t.primary_key) == 1:
                    continue
                low = c.name.lower()
                bare = lambda n: n.lower().split("_", 1)[1] if "_" in n and len(n.split("_", 1)[0]) <= 2 else n.lower()
                origin = "same_name" if low == key.name.lower() else "suffix" if any(low in (f"{s}_id", f"{s}_key", f"{s}id", f"{s}key") for s in stems) else "prefix" if bare(c.name) == bare(key.name) else ""
                if origin and containment(frames[t.name], c.name, frames[parent.name], key.name) >= least_containment:
                    known.add((t.name, (c.name,)))
                    found.append(ForeignKey(t.name, (c.name,), parent.name, (key.name,), origin))
    catalog.foreign_keys += found
    return found


def semantic_neighbours(frames: dict[str, DataFrame], catalog: Catalog, least: float = 0.15, least_common: int = 3) -> list[ForeignKey]:
    """Pairs of columns of unconnected tables that share values, one of them without repeats; for graphs that fall apart."""
    linked = {frozenset((k.table, k.parent)) for k in catalog.foreign_keys}
    out = []
    for a, b in catalog.pairs():
        if frozenset((a, b)) in linked:
            continue
        for x in catalog.tables[a].columns.values():
            for y in catalog.tables[b].columns.values():
                if x.value_type != y.value_type or x.value_type not in ("string", "integer") or min(x.stats.get("distinct", 0), y.stats.get("distinct", 0)) < 4 or 1.0 not in (x.stats.get("distinct_ratio"), y.stats.get("distinct_ratio")):
                    continue
                left, right = ({r["value"] for r in overlap_sample(frames[t], c.name).collect()} for t, c in ((a, x), (b, y)))
                common = left & right
                if len(common) >= least_common and len(common) / len(left | right) >= least:
                    child, parent = ((a, x), (b, y)) if y.stats.get("distinct_ratio") == 1.0 else ((b, y), (a, x))
                    out.append(ForeignKey(child[0], (child[1].name,), parent[0], (parent[1].name,), "overlap"))
    return out


def orphan_rate(frames: dict[str, DataFrame], key: ForeignKey) -> float:
    """Share of the child's rows with a key that the parent lacks."""
    child = frames[key.table].dropna(subset=list(key.columns))
    parent = frames[key.parent].select(*[F.col(p).alias(f"__{i}") for i, p in enumerate(key.parent_columns)])
    lost = child.join(parent, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(key.columns)], "left_anti").count()
    return lost / max(1, child.count())


def suggest_value(wanted: str, known: DataFrame, column: str, most: int = 5) -> DataFrame:
    """Values of a column within ``most`` edits of one that matched nothing, nearest first."""
    near = F.levenshtein(F.lower(column), F.lit(wanted.lower()))
    return known.select(F.col(column).alias("value"), near.alias("distance")).distinct().filter(F.col("distance") <= most).orderBy("distance", "value")
