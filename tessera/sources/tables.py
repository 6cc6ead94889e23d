"""Tables from a folder of Parquet, with the keys of the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.catalog import Catalog, ForeignKey

#: The supplied tables: primary keys and foreign keys (Parquet declares none).
PRIMARY_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "embeddings": ("vec_id",)}
FOREIGN_KEYS = [
    ForeignKey(a, (b,), c, (d,))
    for a, b, c, d in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("events", "user_id", "customer", "c_custkey"),
    )
]


#: Schemas by application and path: reading one takes a job.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def _open(spark: SparkSession, path: str) -> DataFrame:
    """A table whose schema is read once in an application; clear ``_SCHEMAS`` after a table has been replaced."""
    key = spark.sparkContext.applicationId, path
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def open_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> tuple[dict[str, DataFrame], Catalog]:
    """DataFrames by name, and their catalog; declared keys are not null, and so are the keys that point at them."""
    names = list(names or PRIMARY_KEYS)
    frames = {n: _open(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names}
    keys = [k for k in FOREIGN_KEYS if k.table in frames and k.parent in frames]
    catalog = Catalog.reflect(frames, {n: k for n, k in PRIMARY_KEYS.items() if n in frames}, keys)
    for k in keys:
        for c in k.columns:
            catalog.tables[k.table].columns[c].nullable = False
    return frames, catalog
