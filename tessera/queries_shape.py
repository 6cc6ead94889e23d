"""Queries over what the engine does to a specification before it compiles it, and around its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans import mutate
from .plans.catalog import Catalog
from .plans.compile import Compiler
from .plans.federate import semijoin_keys
from .plans.spec import Agg, And, Between, DateDiff, Lit, Or, Order, Param, Query, Step, call, col, item, where
from .plans.templates import Store
from .queries import NOW, query, spec
from .sources import results
from .sources.tables import open_tables

O, C, P = "orders", "customer", "part"
KEY, PRICE, STATUS, DAY, BUYER = (col(f"orders.{c}") for c in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_custkey"))
KEYS = (item(KEY, "o_orderkey"),)

# --- shape ---------------------------------------------------------------------------------------------------------------

spec("shape_inferred_group_by", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus", Query(select=(item(STATUS, "o_orderstatus"), item(Agg("count"), "n")), tables=(O,)))
spec("shape_spurious_group_by", "SELECT DISTINCT o_orderstatus FROM orders", Query(select=(item(STATUS, "o_orderstatus"),), tables=(O,), group_by=(STATUS,)))
spec("shape_distinct_key", "SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS m FROM orders", Query(select=(item(Agg("count", KEY, True), "n"), item(Agg("count", BUYER, True), "m")), tables=(O,)))
spec("shape_having_always_true", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus", Query(select=(item(STATUS, "o_orderstatus"), item(Agg("count"), "n")), tables=(O,), group_by=(STATUS,), having=where(Agg("count"), ">=", 0)))
spec("shape_unused_step", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000", Query(select=KEYS, tables=(O,), where=where(PRICE, ">", 200000), steps=(Step("idle", Query(select=(item(Agg("count"), "n"),), tables=(C,)), "scalar"),)))
spec("shape_steps_out_of_order", "SELECT o_custkey AS k FROM orders GROUP BY o_custkey HAVING count(*) > 10", Query(select=(item(col("b.k"), "k"),), tables=("b",), steps=(Step("b", Query(select=(item(col("a.k"), "k"),), tables=("a",), where=where(col("a.n"), ">", 10))), Step("a", Query(select=(item(BUYER, "k"), item(Agg("count"), "n")), tables=(O,), group_by=(BUYER,))))))
spec("shape_tightened_ranges", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 200000", Query(select=KEYS, tables=(O,), where=And((where(PRICE, ">", 50000), And((where(PRICE, ">", 100000), where(PRICE, "<", 300000))), where(PRICE, "<", 200000)))))
spec("shape_equalities_to_list", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('f', 'p')", Query(select=KEYS, tables=(O,), where=Or((where(STATUS, "=", "F"), where(STATUS, "=", "P")))))
spec("shape_sides_swapped", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000", Query(select=KEYS, tables=(O,), where=where(Lit(250000), "<", PRICE)))
spec("shape_limit_parameter", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", Query(select=KEYS, tables=(O,), order_by=(Order(KEY),), limit=Param("n")), params={"n": 7})
spec("shape_value_parameter", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'", Query(select=KEYS, tables=(O,), where=where(STATUS, "=", Param("s"))), params={"s": "F"})


def _padded(frames, catalog):
    frames = dict(frames, customer=frames[C].withColumn("c_mktsegment", F.rpad("c_mktsegment", 14, " ")))
    catalog.tables[C].columns["c_mktsegment"].fixed_width = True
    return frames, catalog


spec("fixed_width_text", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')", Query(select=(item(col("customer.c_custkey"), "c_custkey"),), tables=(C,), where=where(col("customer.c_mktsegment"), "in", ("Building", "MACHINERY"))), _padded)


def _flagged(frames, catalog):
    frames = dict(frames, flags=frames[O].select("o_orderkey", (F.col("o_totalprice") > 150000).alias("big")))
    catalog.tables |= Catalog.reflect({"flags": frames["flags"]}, {"flags": ("o_orderkey",)}).tables
    return frames, catalog


spec("boolean_words", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000", Query(select=(item(col("flags.o_orderkey"), "o_orderkey"),), tables=("flags",), where=where(col("flags.big"), "=", "yes")), _flagged)

# --- calendar spellings --------------------------------------------------------------------------------------------------

for _spelling, _unit in (("monthly", "month"), ("quarterly", "quarter"), ("annual", "year"), ("mos", "month")):
    spec(f"unit_{_spelling}", f"SELECT o_orderkey, date_trunc('{_unit}', CAST(o_orderdate AS TIMESTAMP)) AS start FROM orders", Query(select=(*KEYS, item(call("date_trunc", DAY, unit=_spelling), "start")), tables=(O,)))
spec("unit_semiannual", "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS half FROM orders", Query(select=(*KEYS, item(call("extract", DAY, unit="semi-annual"), "half")), tables=(O,)))
spec("unit_yearly_difference", "SELECT o_orderkey FROM orders WHERE date_diff('year', CAST(o_orderdate AS DATE), DATE '1998-09-02') >= 3", Query(select=KEYS, tables=(O,), where=DateDiff("yearly", DAY, Lit("1998-09-02", "date"), ">=", 3)))

# --- templates, variants, answers ----------------------------------------------------------------------------------------


@query("template_list_and_dates", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('f', 'o') AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def template_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    store = Store()
    kept = store.insert("orders by status and year", Query(select=KEYS, tables=(O,), where=And((where(STATUS, "in", ("P",)), Between(DAY, "1996-01-01", "1996-12-31")))))
    store.promote(kept.handle)
    return Compiler(frames, catalog, NOW).compile(store.replay(kept.handle, p0=["F", "O"], p1="1995-01-01", p2="1995-12-31"))


_SEED = Query(select=(*KEYS, item(PRICE, "o_totalprice")), tables=(O,), where=where(PRICE, ">", 100000))
_VARIANTS = {"where_remove": "FROM orders", "where_not_null_add": "FROM orders WHERE o_totalprice > 100000 AND o_totalprice IS NOT NULL", "where_add": "FROM orders WHERE o_totalprice > 100000", "where_or_group": "FROM orders WHERE o_totalprice > 100000", "distinct_add": "FROM orders WHERE o_totalprice > 100000", "join_dimension_add": "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", "scalar_threshold": "FROM orders WHERE o_totalprice > 100000 AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)", "window_running_sum": "FROM orders WHERE o_totalprice > 100000"}


@query("variants_of_a_query", " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(count(*) AS BIGINT) AS n {text}" for name, text in _VARIANTS.items()))
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    made = dict(mutate.mutants(_SEED, catalog))
    out = None
    for name in _VARIANTS:
        one = Compiler(frames, catalog, NOW).compile(made[name]).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("warm_up_statements", "SELECT 'SELECT r_name FROM region' AS statement, TRUE AS kept UNION ALL SELECT 'SELECT * FROM region', FALSE UNION ALL SELECT 'SELECT o_orderkey FROM orders WHERE o_totalprice > 5', TRUE")
def warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, *open_tables(spark, sf_dir))
    log = results.select_statements("SELECT r_name FROM region; DROP TABLE x; SELECT * FROM region; SELECT o_orderkey FROM orders WHERE o_totalprice > 5; SELECT r_name FROM region")
    return spark.createDataFrame([(s, not made.startswith("refused")) for s, made in engine.warm_up(log).items()], "statement string, kept boolean")


@query("semi_join_keys", "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS key FROM nation")
def transferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = semijoin_keys(open_tables(spark, sf_dir, ["nation"])[0]["nation"], "n_regionkey")
    return spark.createDataFrame([(int(k),) for k in keys], "key long")


@query("capped_rows", "SELECT n_nationkey, n_name FROM nation")
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = open_tables(spark, sf_dir, ["nation"])[0]["nation"].select("n_nationkey", "n_name")
    return spark.createDataFrame(results.capped(frame, most_rows=25), frame.schema)


@query("batched_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey < 500")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = open_tables(spark, sf_dir, ["orders"])[0]["orders"].filter("o_orderkey < 500").select("o_orderkey")
    return spark.createDataFrame([r for chunk in results.batches(frame, 10) for r in chunk], frame.schema)


@query("arrow_rows", "SELECT s_suppkey, s_name FROM supplier")
def arrow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(results.arrow(open_tables(spark, sf_dir, ["supplier"])[0]["supplier"].select("s_suppkey", "s_name")))


@query("sql_with_parameters", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_tables(spark, sf_dir, ["customer"])[0]["customer"].createOrReplaceTempView("customer")
    return results.run_sql(spark, "SELECT c_custkey FROM customer WHERE c_acctbal > :least", {"least": 5000})
