"""What the engine refuses, and the forms that it takes instead."""

import pytest

from tessera.plans import sql_import, validate
from tessera.plans.compile import Compiler
from tessera.plans.spec import Agg, And, Call, Case, Frame, Lit, Or, Order, Pred, Query, Refusal, Step, Window, Within, call, col, item, where
from tessera.sources.tables import open_tables

KEY, PRICE, NAME, SEGMENT = col("orders.o_orderkey"), col("orders.o_totalprice"), col("customer.c_name"), col("customer.c_mktsegment")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return open_tables(spark, sf_dir)


def one(**k):
    return Query(**({"select": (item(KEY, "k"),), "tables": ("orders",)} | k))


REFUSED = {
    "unknown table": Query(select=(item(col("nowhere.x"), "x"),), tables=("nowhere",)),
    "unknown column": Query(select=(item(col("orders.nothing"), "x"),), tables=("orders",)),
    "cross product": Query(select=(item(KEY, "k"), item(col("embeddings.vec_id"), "v")), tables=("orders", "embeddings")),
    "not in with null": one(where=Pred(PRICE, "not in", (Lit(1), Lit(None)))),
    "aggregate in where": one(where=where(Agg("sum", PRICE), ">", 1)),
    "having without aggregate": one(group_by=(KEY,), having=where(KEY, ">", 1)),
    "nested aggregate": one(select=(item(Agg("sum", Agg("max", PRICE)), "s"),)),
    "unknown aggregate": one(select=(item(Agg("first", PRICE), "s"),)),
    "sum of text": Query(select=(item(Agg("sum", NAME), "s"),), tables=("customer",)),
    "string_agg without separator": Query(select=(item(Agg("string_agg", NAME), "s"),), tables=("customer",)),
    "unknown function": one(select=(item(Call("sqrt", (PRICE,)), "s"),)),
    "calendar function of text": Query(select=(item(call("year", NAME), "y"),), tables=("customer",)),
    "arithmetic on text": Query(select=(item(call("abs", NAME), "y"),), tables=("customer",)),
    "ranking without order": one(select=(item(Window("rank"), "r"),)),
    "ntile without n": one(select=(item(Window("ntile", order=(Order(KEY),)), "r"),)),
    "window outside the whitelist": one(select=(item(Window("max", PRICE), "r"),)),
    "range offset over two keys": one(select=(item(Window("sum", PRICE, order=(Order(KEY), Order(PRICE)), frame=Frame("range", -1, 0)), "r"),)),
    "deep nesting": one(where=And((Or((And((Or((where(KEY, "=", 1), where(KEY, "=", 2), where(PRICE, ">", 3))), where(PRICE, ">", 1))), where(KEY, "=", 3))), where(PRICE, "<", 9)))),
    "distinct on without order": one(distinct_on=(KEY,)),
    "text against number": Query(select=(item(NAME, "n"),), tables=("customer",), where=where(SEGMENT, "=", 5)),
    "like on a number": one(where=where(PRICE, "like", "1%")),
    "probe without keys": one(steps=(Step("p", Query(select=(item(NAME, "n"),), tables=("customer",)), "semi"),)),
    "scalar step with rows": one(where=where(PRICE, ">", col("p.n")), steps=(Step("p", Query(select=(item(col("customer.c_acctbal"), "n"),), tables=("customer",)), "scalar"),)),
    "aggregate over repeated rows": Query(select=(item(Agg("sum", PRICE), "s"),), tables=("orders", "lineitem"), where=where(col("lineitem.l_quantity"), ">", 1)),
    "window over repeated rows": Query(select=(item(col("lineitem.l_linenumber"), "l"), item(Window("sum", PRICE), "s")), tables=("orders", "lineitem")),
    "limit over repeated rows": Query(select=(item(KEY, "k"),), tables=("orders", "lineitem"), where=where(col("lineitem.l_quantity"), ">", 1), limit=5),
    "neither key nor aggregate": Query(select=(item(SEGMENT, "s"), item(Agg("count"), "n")), tables=("customer",), group_by=(NAME,)),
    "steps too deep": None,
}
_q = one()
for _k in range(9):
    _q = Query(select=(item(col(f"s{_k}.k"), "k"),), tables=(f"s{_k}",), steps=(Step(f"s{_k}", _q),))
REFUSED["steps too deep"] = _q


@pytest.mark.parametrize("name", sorted(REFUSED))
def test_refused(tables, name):
    with pytest.raises((Refusal, ValueError)):
        Compiler(*tables).compile(REFUSED[name])


SQL = {
    "delete": "DELETE FROM orders",
    "hidden change": "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a",
    "union": "SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders)",
    "lateral": "SELECT 1 FROM orders, LATERAL (SELECT 2) x",
    "recursive": "WITH RECURSIVE t AS (SELECT 1) SELECT * FROM t",
    "offset": "SELECT o_orderkey FROM orders OFFSET 5",
    "distinct on": "SELECT DISTINCT ON (o_custkey) o_orderkey FROM orders",
    "json path": "SELECT props->'k' FROM events",
    "pivot": "SELECT * FROM orders PIVOT (sum(x) FOR y IN (1))",
    "rollup": "SELECT o_custkey, count(*) FROM orders GROUP BY ROLLUP(o_custkey)",
    "two statements": "SELECT 1 FROM orders; SELECT 2 FROM orders",
    "cross join": "SELECT o_orderkey FROM orders CROSS JOIN customer",
    "subquery beside or": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders)",
    "full join": "SELECT o_orderkey FROM orders FULL JOIN customer ON o_custkey = c_custkey",
    "star": "SELECT * FROM orders",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_refused(tables, name):
    with pytest.raises(Refusal):
        sql_import.parse(SQL[name], tables[1])


def test_words_in_strings_are_no_statements():
    validate.check_sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'drop table; union'")


def test_sub_day_window_on_a_date(spark):
    from pyspark.sql import functions as F

    from tessera.plans.catalog import Catalog

    df = spark.range(1).select(F.current_date().alias("d"))
    q = Query(select=(item(col("t.d"), "d"),), tables=("t",), where=Within(col("t.d"), 3, "hour"))
    with pytest.raises(ValueError):
        Compiler({"t": df}, Catalog.reflect({"t": df})).compile(q)


def test_sensitive_columns(tables):
    import copy

    frames, catalog = tables
    catalog = copy.deepcopy(catalog)
    catalog.tables["customer"].columns["c_acctbal"].sensitivity = "restricted"
    catalog.tables["customer"].columns["c_name"].sensitivity = "hidden"
    with pytest.raises(Refusal):
        Compiler(frames, catalog).compile(Query(select=(item(SEGMENT, "s"),), tables=("customer",), where=where(col("customer.c_acctbal"), ">", 1)))
    with pytest.raises(Refusal):
        Compiler(frames, catalog).compile(Query(select=(item(NAME, "n"),), tables=("customer",)))


def test_required_filter(tables):
    import copy

    frames, catalog = tables
    catalog = copy.deepcopy(catalog)
    catalog.tables["orders"].required_filters = ("o_orderdate",)
    with pytest.raises(Refusal):
        Compiler(frames, catalog).compile(one())


def test_case_of_predicates(tables):
    q = one(select=(item(KEY, "k"), item(Case(((where(PRICE, ">", 1), Lit("a")),)), "c")))
    assert Compiler(*tables).compile(q).filter("c is null").count() == 0
