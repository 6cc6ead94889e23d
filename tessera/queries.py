"""Every operator of the engine as a query over the supplied tables, each beside the SQL that it must agree with.

The queries go through the engine: a specification is normalised, validated, joined along the key graph and compiled.
Nulls are made inside the queries, since the tables hold none; the anchor of relative dates is fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profile, sets
from .plans import sql_import
from .plans.catalog import Catalog
from .plans.compile import Compiler
from .plans.federate import CrossJoin, Federation, Logical, Member, cross_source_average, semi_instead_of_fan_out
from .plans.normalize import drop_redundant_key_joins
from .plans.spec import Agg, And, Between, Case, Cast, DateDiff, Frame, Interval, Lit, Now, Or, Order, Query, Step, Unnest, Window, Within, arith, call, col, dumps, item, loads, where
from .plans.templates import Store
from .sources.tables import open_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = date(1998, 9, 2)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def spec(name: str, sql: str, q: Query, change: Callable | None = None, **options) -> None:
    """Registers a specification; ``change`` edits the frames and the catalog first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, catalog = open_tables(spark, sf_dir)
        if change:
            frames, catalog = change(frames, catalog)
        return Compiler(frames, catalog, NOW, **options).compile(q)

    query(name, sql)(run)


def nullable_tables(frames: dict[str, DataFrame], catalog: Catalog):
    """Customers with a null segment where the balance is negative, orders with a null customer where the price is low."""
    frames = dict(frames)
    frames["customer"] = frames["customer"].withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    frames["orders"] = frames["orders"].withColumn("o_custkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_custkey")))
    catalog.tables["orders"].columns["o_custkey"].nullable = True
    return frames, catalog


NULL_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer"
NULL_ORDERS = "SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"

O, C, L, N = "orders", "customer", "lineitem", "nation"
price, order_key, order_date, status = col("orders.o_totalprice"), col("orders.o_orderkey"), col("orders.o_orderdate"), col("orders.o_orderstatus")
balance, segment, cust_key, cust_name = col("customer.c_acctbal"), col("customer.c_mktsegment"), col("customer.c_custkey"), col("customer.c_name")
nation_name = col("nation.n_name")
priority = col("orders.o_orderpriority")


def count(x=None, **k) -> Agg:
    return Agg("count", x, **k)


def rounded(x, n: int = 2):
    return call("round", x, n)


# --- the flagship -----------------------------------------------------------------------------------------------------

FLAGSHIP = Query(
    select=(item(nation_name, "n_name"), item(count(order_key), "order_count"), item(rounded(Agg("sum", price)), "revenue")),
    tables=(O, C, N),
    where=And((where(status, "=", "o"), Between(order_date, "1996-01-01", "1996-12-31"))),
    group_by=(nation_name,),
    having=where(count(order_key), ">", 5),
    order_by=(Order(rounded(Agg("sum", price)), True), Order(nation_name)),
    limit=10,
)
spec(
    "flagship",
    """SELECT n_name, CAST(COUNT(o_orderkey) AS BIGINT) AS order_count, ROUND(SUM(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE LOWER(o_orderstatus) = 'o' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1996-12-31'
    GROUP BY n_name HAVING COUNT(o_orderkey) > 5 ORDER BY revenue DESC NULLS FIRST, n_name ASC NULLS LAST LIMIT 10""",
    FLAGSHIP,
)

# --- projections ------------------------------------------------------------------------------------------------------

spec("scan_project", "SELECT c_custkey, c_name FROM customer", Query(select=(item(cust_key, "c_custkey"), item(cust_name, "c_name")), tables=(C,)))
spec(
    "arithmetic",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem",
    Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber"), item(arith("*", col("lineitem.l_extendedprice"), arith("-", 1, col("lineitem.l_discount")), arith("+", 1, col("lineitem.l_tax"))), "charge"), item(arith("/", col("lineitem.l_extendedprice"), col("lineitem.l_quantity")), "unit_price")), tables=(L,)),
)
spec("true_division", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / 7 AS seventh, CAST(o_orderkey AS DOUBLE) / nullif(o_custkey - o_custkey, 0) AS by_zero FROM orders", Query(select=(item(order_key, "o_orderkey"), item(arith("/", order_key, 7), "seventh"), item(arith("/", order_key, arith("-", col("orders.o_custkey"), col("orders.o_custkey"))), "by_zero")), tables=(O,)))
spec(
    "casts_and_literals",
    "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS exact_price, CAST(o_orderkey AS VARCHAR) AS key_text, 'x' AS letter, CAST('1.50' AS DECIMAL(4,2)) AS amount, DATE '1998-09-02' AS today FROM orders",
    Query(select=(item(order_key, "o_orderkey"), item(Cast(price, "decimal(12,2)"), "exact_price"), item(Cast(order_key, "string"), "key_text"), item("x", "letter"), item(Lit("1.50", "decimal(4,2)"), "amount"), item(Now(), "today")), tables=(O,)),
)
spec("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", Query(select=(item(status, "o_orderstatus"), item(priority, "o_orderpriority")), tables=(O,), distinct=True))
spec(
    "distinct_on",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_custkey ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST) AS n FROM orders) WHERE n = 1",
    Query(select=(item(col("orders.o_custkey"), "o_custkey"), item(order_key, "o_orderkey"), item(price, "o_totalprice")), tables=(O,), distinct_on=(col("orders.o_custkey"),), order_by=(Order(col("orders.o_custkey")), Order(price, True), Order(order_key))),
)
spec("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", Query(select=(item(order_key, "o_orderkey"), item(Case(((where(price, ">", 200000), Lit("high")), (where(price, ">", 100000), Lit("mid"))), Lit("low")), "band")), tables=(O,)))
spec("case_in_aggregate", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM orders GROUP BY 1", Query(select=(item(status, "o_orderstatus"), item(Agg("sum", Case(((where(price, ">", 200000), Lit(1)),), Lit(0))), "n_high")), tables=(O,), group_by=(status,)))
spec(
    "expand_keys",
    "SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    Query(select=(item(col("supplier.s_suppkey"), "s_suppkey"), item(col("supplier.s_nationkey"), "s_nationkey")), tables=("supplier",), expand_keys=True),
)


def with_arrays(frames, catalog):
    frames = dict(frames, items=frames["part"].select("p_partkey", F.split("p_name", " ").alias("words"), F.to_json(F.split("p_name", " ")).alias("words_json")))
    extra = Catalog.reflect({"items": frames["items"]}, {"items": ("p_partkey",)})
    catalog.tables |= extra.tables
    return frames, catalog


spec("unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part", Query(select=(item(col("s.p_partkey"), "p_partkey"), item(col("s.word"), "word")), tables=("s",), steps=(Step("s", Query(select=(item(col("items.p_partkey"), "p_partkey"), item(Unnest(col("items.words")), "word")), tables=("items",))),)), with_arrays)
spec("array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'widget')", Query(select=(item(col("items.p_partkey"), "p_partkey"),), tables=("items",), where=where(col("items.words"), "contains", " WIDGET ")), with_arrays)
spec("json_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'widget')", Query(select=(item(col("items.p_partkey"), "p_partkey"),), tables=("items",), where=where(col("items.words_json"), "contains", "Widget")), with_arrays)

# --- scalar functions -------------------------------------------------------------------------------------------------

spec(
    "string_functions",
    "SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, trim(concat(' ', c_name, ' ')) AS trimmed, ltrim(concat(' ', c_name)) AS lt, rtrim(concat(c_name, ' ')) AS rt, CAST(length(c_name) AS BIGINT) AS n FROM customer",
    Query(select=(item(cust_key, "c_custkey"), item(call("upper", cust_name), "up"), item(call("lower", cust_name), "low"), item(call("trim", call("concat", " ", cust_name, " ")), "trimmed"), item(call("ltrim", call("concat", " ", cust_name)), "lt"), item(call("rtrim", call("concat", cust_name, " ")), "rt"), item(call("length", cust_name), "n")), tables=(C,)),
)
spec("concat_skips_null", f"SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS label FROM ({NULL_CUSTOMER})", Query(select=(item(cust_key, "c_custkey"), item(call("concat", cust_name, "-", segment), "label")), tables=(C,)), nullable_tables)
spec("numeric_functions", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal / 3, 2) AS r2 FROM customer", Query(select=(item(cust_key, "c_custkey"), item(call("abs", balance), "a"), item(rounded(balance, 1), "r"), item(call("floor", balance), "f"), item(call("ceil", balance), "c"), item(call("round", arith("/", balance, 3)), "r2")), tables=(C,)))
spec("coalesce", f"SELECT c_custkey, coalesce(c_mktsegment, 'none') AS s FROM ({NULL_CUSTOMER})", Query(select=(item(cust_key, "c_custkey"), item(call("coalesce", segment, "none"), "s")), tables=(C,)), nullable_tables)
UNITS = ("day", "week", "month", "quarter", "year")
spec("date_trunc", "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP) AS {u}_start" for u in UNITS) + " FROM orders", Query(select=(item(order_key, "o_orderkey"), *(item(call("date_trunc", order_date, unit=u), f"{u}_start") for u in UNITS)), tables=(O,)))
spec("half_year", "SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) ELSE make_timestamp(year(o_orderdate), 7, 1, 0, 0, 0) END AS half_start, CAST(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS half FROM orders", Query(select=(item(order_key, "o_orderkey"), item(call("date_trunc", order_date, unit="half_year"), "half_start"), item(call("extract", order_date, unit="half_year"), "half")), tables=(O,)))
spec("extract", "SELECT event_id, " + ", ".join(f"CAST(floor(extract({u} FROM ts)) AS BIGINT) AS {u}_part" for u in ("second", "minute", "hour", *UNITS)) + " FROM events", Query(select=(item(col("events.event_id"), "event_id"), *(item(call("extract", col("events.ts"), unit=u), f"{u}_part") for u in ("second", "minute", "hour", *UNITS))), tables=("events",)))
spec("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q FROM orders", Query(select=(item(order_key, "o_orderkey"), item(call("year", order_date), "y"), item(call("month", order_date), "m"), item(call("day", order_date), "d"), item(call("date_part", order_date, unit="quarter"), "q")), tables=(O,)))
spec("date_shift", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS later, o_orderdate - INTERVAL 1 MONTH AS before, o_orderdate + INTERVAL 3 MONTH AS quarter_on FROM orders", Query(select=(item(order_key, "o_orderkey"), item(arith("+", order_date, 30), "later"), item(arith("-", order_date, Interval(1, "month")), "before"), item(arith("+", order_date, Interval(1, "quarter")), "quarter_on")), tables=(O,)))

# --- predicates -------------------------------------------------------------------------------------------------------

COMPARE = {"=": "=", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
for op, sql in COMPARE.items():
    name = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}[op]
    spec(f"where_{name}", f"SELECT p_partkey FROM part WHERE p_size {sql} 25", Query(select=(item(col("part.p_partkey"), "p_partkey"),), tables=("part",), where=where(col("part.p_size"), op, 25)))
spec("text_equality_folds_case", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE lower(c_mktsegment) = 'building'", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "=", "Building")), nullable_tables)
spec("not_equal_keeps_unknown", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE lower(c_mktsegment) <> 'building' OR c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "!=", "building")), nullable_tables)
spec("in_list", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE lower(c_mktsegment) IN ('building', 'machinery')", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "in", ["BUILDING", "machinery"])), nullable_tables)
spec("not_in_keeps_unknown", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE lower(c_mktsegment) NOT IN ('building', 'machinery') OR c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "not in", ["BUILDING", "machinery"])), nullable_tables)
spec("between", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950 AND 1100", Query(select=(item(col("part.p_partkey"), "p_partkey"),), tables=("part",), where=where(col("part.p_retailprice"), "between", [Lit(950), Lit(1100)])))
spec("like", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE lower('CUST%1')", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(cust_name, "like", "CUST%1")))
spec("like_escaped", "SELECT n_nationkey FROM nation WHERE lower(n_name) LIKE 'nation/_1%' ESCAPE '/'", Query(select=(item(col("nation.n_nationkey"), "n_nationkey"),), tables=(N,), where=where(nation_name, "like", "NATION/_1%")))
spec("not_like_keeps_unknown", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE lower(c_mktsegment) NOT LIKE 'b%' OR c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "not like", "B%")), nullable_tables)
spec("ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%ing'", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "ilike", "%ING")))
spec("not_ilike", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE c_mktsegment NOT ILIKE '%ing' OR c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "not ilike", "%ING")), nullable_tables)
spec("is_null", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "is null")), nullable_tables)
spec("is_not_null", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE c_mktsegment IS NOT NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "is not null")), nullable_tables)
spec("equals_null_is_null", f"SELECT c_custkey FROM ({NULL_CUSTOMER}) WHERE c_mktsegment IS NULL", Query(select=(item(cust_key, "c_custkey"),), tables=(C,), where=where(segment, "=", Lit(None))), nullable_tables)
spec("and_or_tree", "SELECT o_orderkey FROM orders WHERE (lower(o_orderstatus) = 'f' AND o_totalprice > 100000) OR (lower(o_orderstatus) = 'o' AND o_totalprice < 50000)", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), where=Or((And((where(status, "=", "F"), where(price, ">", 100000))), And((where(status, "=", "O"), where(price, "<", 50000)))))))
spec("or_equalities", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 7 OR p_size = 9", Query(select=(item(col("part.p_partkey"), "p_partkey"),), tables=("part",), where=Or(tuple(where(col("part.p_size"), "=", k) for k in (1, 7, 9)))))
spec("contradiction", "SELECT p_partkey FROM part WHERE p_size = 1 AND p_size = 2", Query(select=(item(col("part.p_partkey"), "p_partkey"),), tables=("part",), where=And((where(col("part.p_size"), "=", 1), where(col("part.p_size"), "=", 2)))))
spec("range_tightening", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size > 20 AND p_size <= 30", Query(select=(item(col("part.p_partkey"), "p_partkey"),), tables=("part",), where=And((where(col("part.p_size"), ">", 10), where(col("part.p_size"), ">", 20), where(col("part.p_size"), "<=", 30)))))
spec("column_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount", Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber")), tables=(L,), where=where(col("lineitem.l_tax"), ">", col("lineitem.l_discount"))))
spec("theta_across_tables", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice > o_totalprice", Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber")), tables=(L, O), where=where(col("lineitem.l_extendedprice"), ">", price)))
for n, u, low in ((90, "day", "DATE '1998-09-02' - INTERVAL 90 DAY"), (6, "month", "DATE '1998-09-02' - INTERVAL 6 MONTH"), (2, "quarter", "DATE '1998-09-02' - INTERVAL 6 MONTH"), (1, "half_year", "DATE '1998-09-02' - INTERVAL 6 MONTH"), (2, "week", "DATE '1998-09-02' - INTERVAL 14 DAY"), (1, "year", "DATE '1998-09-02' - INTERVAL 1 YEAR")):
    spec(f"last_{n}_{u}", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= {low} AND o_orderdate <= DATE '1998-09-02'", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), where=Within(order_date, n, u)))
spec("this_quarter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-07-01' AND o_orderdate <= DATE '1998-09-02'", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), where=Within(order_date, 0, "quarter")))
spec("absolute_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate <= DATE '1997-03-31'", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), where=Between(order_date, "1997-01-01", "1997-03-31")))
for u in ("day", "week", "month", "quarter", "year"):
    spec(f"date_diff_{u}", f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('{u}', o_orderdate, l_shipdate) > {30 if u == 'day' else 1 if u != 'year' else 0}", Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber")), tables=(L, O), where=DateDiff(u, order_date, col("lineitem.l_shipdate"), ">", 30 if u == "day" else 1 if u != "year" else 0)))
spec("date_subtraction", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 60", Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber")), tables=(L, O), where=where(arith("-", col("lineitem.l_shipdate"), order_date), ">", 60)))

# --- joins ------------------------------------------------------------------------------------------------------------

spec("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", Query(select=(item(order_key, "o_orderkey"), item(cust_name, "c_name")), tables=(O, C)))
spec("left_join_on_nullable_key", f"SELECT o_orderkey, c_name FROM ({NULL_ORDERS}) LEFT JOIN customer ON o_custkey = c_custkey", Query(select=(item(order_key, "o_orderkey"), item(cust_name, "c_name")), tables=(O, C)), nullable_tables)
spec("join_path", "SELECT l_orderkey, l_linenumber, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", Query(select=(item(col("lineitem.l_orderkey"), "l_orderkey"), item(col("lineitem.l_linenumber"), "l_linenumber"), item(col("region.r_name"), "r_name")), tables=(L, O, C, N, "region")))
spec("count_zero_fill", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1996-01-31') ON c_custkey = o_custkey GROUP BY 1", Query(select=(item(cust_key, "c_custkey"), item(count(col("m.o_orderkey")), "n")), tables=(C, "m"), group_by=(cust_key,), preserve=(C,), steps=(Step("m", Query(select=(item(order_key, "o_orderkey"), item(col("orders.o_custkey"), "o_custkey")), tables=(O,), where=Between(order_date, "1996-01-01", "1996-01-31")), "table", (("o_custkey", "customer.c_custkey"),)),)))
spec("preserved_anchor", "SELECT n_name, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", Query(select=(item(nation_name, "n_name"), item(count(col("supplier.s_suppkey"), distinct=True), "n")), tables=(N, "supplier"), group_by=(nation_name,), preserve=(N,)))
big_customers = Query(select=(item(col("orders.o_custkey"), "k"),), tables=(O,), where=where(price, ">", 400000))
spec("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", Query(select=(item(cust_key, "c_custkey"), item(cust_name, "c_name")), tables=(C,), steps=(Step("big", big_customers, "semi", (("k", "customer.c_custkey"),)),)))
spec("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", Query(select=(item(cust_key, "c_custkey"), item(cust_name, "c_name")), tables=(C,), steps=(Step("big", big_customers, "anti", (("k", "customer.c_custkey"),)),)))
spec("orders_without_items", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), steps=(Step("i", Query(select=(item(col("lineitem.l_orderkey"), "k"),), tables=(L,)), "anti", (("k", "orders.o_orderkey"),)),)))
spec("scalar_threshold", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", Query(select=(item(order_key, "o_orderkey"), item(price, "o_totalprice")), tables=(O,), where=where(price, ">", col("m.a")), steps=(Step("m", Query(select=(item(Agg("avg", price), "a"),), tables=(O,)), "scalar"),)))
spec("self_join", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", Query(select=(item(nation_name, "one"), item(col("b.n_name"), "two")), tables=(N,), aliases=(("b", N),), where=And((where(col("nation.n_regionkey"), "=", col("b.n_regionkey")), where(col("nation.n_nationkey"), "<", col("b.n_nationkey"))))))
spec("where_equality_join", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > 9500", Query(select=(item(cust_key, "c_custkey"), item(col("s.s_suppkey"), "s_suppkey")), tables=(C,), aliases=(("s", "supplier"),), where=And((where(col("customer.c_nationkey"), "=", col("s.s_nationkey")), where(balance, ">", 9500)))))
spec("composite_step_join", "SELECT o_orderkey, o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) t ON o.o_custkey = t.o_custkey AND o.o_totalprice = t.m", Query(select=(item(order_key, "o_orderkey"), item(price, "o_totalprice")), tables=(O, "t"), steps=(Step("t", Query(select=(item(col("orders.o_custkey"), "k"), item(Agg("max", price), "m")), tables=(O,), group_by=(col("orders.o_custkey"),)), "table", (("k", "orders.o_custkey"), ("m", "orders.o_totalprice"))),)))


@query("key_join_elimination", "SELECT o_orderkey, o_custkey AS c_custkey FROM orders")
def key_join_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    q = drop_redundant_key_joins(Query(select=(item(order_key, "o_orderkey"), item(cust_key, "c_custkey")), tables=(O, C)), catalog)
    return Compiler(frames, catalog, NOW).compile(q)


# --- aggregates -------------------------------------------------------------------------------------------------------

spec(
    "aggregates",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice) / 1000000, 4) AS var, median(o_totalprice) AS med FROM orders GROUP BY 1",
    Query(select=(item(status, "o_orderstatus"), item(count(), "n"), item(count(col("orders.o_custkey"), distinct=True), "customers"), item(rounded(Agg("sum", price)), "total"), item(rounded(Agg("avg", price)), "mean"), item(Agg("min", price), "least"), item(Agg("max", price), "most"), item(rounded(Agg("stddev", price), 4), "sd"), item(rounded(arith("/", Agg("variance", price), 1000000), 4), "var"), item(Agg("median", price), "med")), tables=(O,), group_by=(status,)),
)
spec("scalar_aggregate", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders", Query(select=(item(count(), "n"), item(rounded(Agg("sum", price)), "total")), tables=(O,)))
spec("empty_aggregate", "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0", Query(select=(item(count(), "n"), item(Agg("sum", price), "total")), tables=(O,), where=where(price, "<", 0)))
spec("sum_distinct", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY 1", Query(select=(item(col("part.p_brand"), "p_brand"), item(Agg("sum", col("part.p_size"), distinct=True), "s")), tables=("part",), group_by=(col("part.p_brand"),)))
spec("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1", Query(select=(item(col("nation.n_regionkey"), "n_regionkey"), item(Agg("string_agg", nation_name, separator=", ", order=(Order(nation_name),)), "names")), tables=(N,), group_by=(col("nation.n_regionkey"),)))
spec("string_agg_unordered", "SELECT n_regionkey, CAST(length(string_agg(n_name, ', ')) AS BIGINT) AS n FROM nation GROUP BY 1", Query(select=(item(col("nation.n_regionkey"), "n_regionkey"), item(call("length", Agg("string_agg", nation_name, separator=", ")), "n")), tables=(N,), group_by=(col("nation.n_regionkey"),)))
spec("group_by_expression", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1", Query(select=(item(call("year", order_date), "y"), item(count(), "n")), tables=(O,), group_by=(call("year", order_date),)))
spec("ratio_of_sums", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS share FROM lineitem GROUP BY 1", Query(select=(item(col("lineitem.l_returnflag"), "l_returnflag"), item(rounded(arith("/", Agg("sum", arith("*", col("lineitem.l_extendedprice"), col("lineitem.l_discount"))), Agg("sum", col("lineitem.l_extendedprice"))), 6), "share")), tables=(L,), group_by=(col("lineitem.l_returnflag"),)))
spec("scalar_in_aggregate", "SELECT max(upper(c_name)) AS last FROM customer", Query(select=(item(Agg("max", call("upper", cust_name)), "last"),), tables=(C,)))
spec("having_two_aggregates", "SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) > 3 * min(o_totalprice) AND count(*) >= 5", Query(select=(item(col("orders.o_custkey"), "o_custkey"),), tables=(O,), group_by=(col("orders.o_custkey"),), having=And((where(Agg("max", price), ">", arith("*", 3, Agg("min", price))), where(count(), ">=", 5)))))
spec("exact_sums", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total FROM lineitem GROUP BY 1", Query(select=(item(col("lineitem.l_returnflag"), "l_returnflag"), item(Agg("sum", Cast(col("lineitem.l_extendedprice"), "decimal(12,2)")), "total")), tables=(L,), group_by=(col("lineitem.l_returnflag"),)))
spec("pre_aggregated_step", "SELECT c_mktsegment, round(avg(total), 2) AS mean_total FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1", Query(select=(item(segment, "c_mktsegment"), item(rounded(Agg("avg", col("t.total"))), "mean_total")), tables=(C, "t"), group_by=(segment,), steps=(Step("t", Query(select=(item(col("orders.o_custkey"), "k"), item(Agg("sum", price), "total")), tables=(O,), group_by=(col("orders.o_custkey"),)), "table", (("k", "customer.c_custkey"),)),)))

# --- windows ----------------------------------------------------------------------------------------------------------

by_customer = (col("orders.o_custkey"),)
by_date = (Order(order_date), Order(order_key))
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST"
ranking = ("row_number", "rank", "dense_rank")
spec("window_ranking", "SELECT o_orderkey, " + ", ".join(f"CAST({f}() {OVER}) AS BIGINT) AS {f}_" for f in ranking) + f", percent_rank() {OVER}) AS pr, cume_dist() {OVER}) AS cd, CAST(ntile(4) {OVER}) AS BIGINT) AS quarter FROM orders", Query(select=(item(order_key, "o_orderkey"), *(item(Window(f, partition=by_customer, order=by_date), f"{f}_") for f in ranking), item(Window("percent_rank", partition=by_customer, order=by_date), "pr"), item(Window("cume_dist", partition=by_customer, order=by_date), "cd"), item(Window("ntile", n=4, partition=by_customer, order=by_date), "quarter")), tables=(O,)))
FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
full = Frame("rows", None, None)
spec("window_values", f"SELECT o_orderkey, lag(o_totalprice) {OVER}) AS before, lead(o_totalprice) {OVER}) AS after, first_value(o_totalprice) {OVER}) AS first, last_value(o_totalprice) {OVER} {FULL}) AS last, nth_value(o_totalprice, 2) {OVER} {FULL}) AS second FROM orders", Query(select=(item(order_key, "o_orderkey"), item(Window("lag", price, partition=by_customer, order=by_date), "before"), item(Window("lead", price, partition=by_customer, order=by_date), "after"), item(Window("first_value", price, partition=by_customer, order=by_date), "first"), item(Window("last_value", price, partition=by_customer, order=by_date, frame=full), "last"), item(Window("nth_value", price, 2, by_customer, by_date, full), "second")), tables=(O,)))
spec("window_running", f"SELECT o_orderkey, round(sum(o_totalprice) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, round(avg(o_totalprice) {OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM orders", Query(select=(item(order_key, "o_orderkey"), item(rounded(Window("sum", price, partition=by_customer, order=by_date, frame=Frame("rows", None, 0))), "running"), item(rounded(Window("avg", price, partition=by_customer, order=by_date, frame=Frame("rows", -2, 1)), 6), "smooth")), tables=(O,)))
spec("window_range", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size ASC NULLS LAST RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS near, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size ASC NULLS LAST) AS BIGINT) AS upto FROM part", Query(select=(item(col("part.p_partkey"), "p_partkey"), item(Window("sum", col("part.p_size"), partition=(col("part.p_brand"),), order=(Order(col("part.p_size")),), frame=Frame("range", -5, 0)), "near"), item(Window("sum", col("part.p_size"), partition=(col("part.p_brand"),), order=(Order(col("part.p_size")),)), "upto")), tables=("part",)))
spec("window_whole_partition", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders", Query(select=(item(order_key, "o_orderkey"), item(rounded(Window("sum", price, partition=by_customer)), "total")), tables=(O,)))
spec("window_over_aggregate", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC NULLS FIRST) AS BIGINT) AS place FROM orders GROUP BY 1", Query(select=(item(priority, "o_orderpriority"), item(rounded(Agg("sum", price)), "total"), item(Window("rank", order=(Order(Agg("sum", price), True),)), "place")), tables=(O,), group_by=(priority,)))
spec("window_filter", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST) AS n FROM orders) WHERE n <= 2", Query(select=(item(col("orders.o_custkey"), "o_custkey"), item(order_key, "o_orderkey")), tables=(O,), where=where(Window("row_number", partition=by_customer, order=(Order(price, True), Order(order_key))), "<=", 2)))

# --- sort and limit ---------------------------------------------------------------------------------------------------

spec("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 25", Query(select=(item(order_key, "o_orderkey"), item(price, "o_totalprice")), tables=(O,), order_by=(Order(price, True), Order(order_key)), limit=25))
spec("nulls_last_ascending", f"SELECT c_custkey, c_mktsegment FROM ({NULL_CUSTOMER}) ORDER BY c_mktsegment ASC NULLS LAST, c_custkey ASC NULLS LAST LIMIT 2000000", Query(select=(item(cust_key, "c_custkey"), item(segment, "c_mktsegment")), tables=(C,), order_by=(Order(segment), Order(cust_key)), limit=2_000_000), nullable_tables)
spec("nulls_last_ascending_all", f"SELECT c_custkey, c_mktsegment FROM ({NULL_CUSTOMER}) ORDER BY c_mktsegment ASC NULLS LAST, c_custkey ASC NULLS LAST", Query(select=(item(cust_key, "c_custkey"), item(segment, "c_mktsegment")), tables=(C,), order_by=(Order(segment), Order(cust_key))), nullable_tables)
spec("nulls_first_descending", f"SELECT c_custkey, c_mktsegment FROM ({NULL_CUSTOMER}) ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 50", Query(select=(item(cust_key, "c_custkey"), item(segment, "c_mktsegment")), tables=(C,), order_by=(Order(segment, True), Order(cust_key)), limit=50), nullable_tables)
spec("nulls_first_descending_all", f"SELECT c_custkey, c_mktsegment FROM ({NULL_CUSTOMER}) ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey ASC NULLS LAST", Query(select=(item(cust_key, "c_custkey"), item(segment, "c_mktsegment")), tables=(C,), order_by=(Order(segment, True), Order(cust_key))), nullable_tables)
spec("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), limit=0))

# --- several sources --------------------------------------------------------------------------------------------------


def _federation(spark: SparkSession, sf_dir: str) -> Federation:
    """Orders in two sources by year, the second under other names; nations in both; customers in a third."""
    frames, catalog = open_tables(spark, sf_dir)
    early = frames["orders"].filter(F.year("o_orderdate") < 1998)
    renamed = {c: f"x_{c[2:]}" for c in frames["orders"].columns}
    late = frames["orders"].filter(F.year("o_orderdate") >= 1998).withColumnsRenamed(renamed)
    a = {"orders": early, "nation": frames["nation"], "lineitem": frames["lineitem"]}
    b = {"purchases": late, "nation": frames["nation"]}
    c = {"customer": frames["customer"]}
    pick = lambda own, keys: Catalog.reflect(own, keys)
    return Federation(
        {"one": (a, pick(a, {"orders": ("o_orderkey",), "nation": ("n_nationkey",), "lineitem": ("l_orderkey", "l_linenumber")})), "two": (b, pick(b, {"purchases": ("x_orderkey",), "nation": ("n_nationkey",)})), "three": (c, pick(c, {"customer": ("c_custkey",)}))},
        (Logical("orders", "union", (Member("one", "orders"), Member("two", "purchases", tuple(renamed.items()))), union_key=("o_orderkey",)), Logical("nation", "replica", (Member("one", "nation"), Member("two", "nation")), "one")),
        (CrossJoin("orders", ("o_custkey",), "customer", ("c_custkey",)), CrossJoin("customer", ("c_nationkey",), "nation", ("n_nationkey",)), CrossJoin("lineitem", ("l_orderkey",), "orders", ("o_orderkey",))),
    )


def federated(name: str, sql: str, q: Query) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, catalog = _federation(spark, sf_dir).compose()
        return Compiler(frames, catalog, NOW).compile(semi_instead_of_fan_out(q, catalog))


federated("union_of_sources", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", Query(select=(item(order_key, "o_orderkey"), item(col("orders.o_custkey"), "o_custkey"), item(price, "o_totalprice")), tables=(O,)))
federated("cross_source_join", "SELECT n_name, CAST(count(o_orderkey) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", Query(select=(item(nation_name, "n_name"), item(count(order_key), "n"), item(rounded(Agg("sum", price)), "total")), tables=(O, C, N), group_by=(nation_name,)))
federated("fan_out_to_semi", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1", Query(select=(item(status, "o_orderstatus"), item(rounded(Agg("sum", price)), "total")), tables=(O, L), where=where(col("lineitem.l_quantity"), ">", 45), group_by=(status,)))


@query("cross_source_average", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def partial_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.groupBy(F.col(f"{p}_orderpriority").alias("o_orderpriority")).agg(F.sum(f"{p}_totalprice").alias("s"), F.count(f"{p}_totalprice").alias("n")) for df, p in ((f["orders"] if "orders" in f else f["purchases"], "o" if "orders" in f else "x") for f, _ in list(_federation(spark, sf_dir).sources.values())[:2])]
    return sets.union_all(parts).groupBy("o_orderpriority").agg(F.round(cross_source_average("s", "n"), 2).alias("mean"))


@query("replica_parity", "SELECT 'two' AS source, CAST(0 AS BIGINT) AS lacks, CAST(0 AS BIGINT) AS beyond")
def replica_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _federation(spark, sf_dir).replica_differences("nation")
    return spark.createDataFrame([(s, *d) for s, d in found.items()], "source string, lacks long, beyond long")


@query("intersect_keys", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = open_tables(spark, sf_dir)
    return sets.intersect_keys(f["customer"].select("c_custkey", "c_nationkey"), f["supplier"].filter("s_acctbal > 9000"), [("c_nationkey", "s_nationkey")]).select("c_custkey")


@query("except_keys", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def except_(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _ = open_tables(spark, sf_dir)
    return sets.except_keys(f["customer"].select("c_custkey", "c_nationkey"), f["supplier"].filter("s_acctbal > 5000"), [("c_nationkey", "s_nationkey")]).select("c_custkey")


# --- profiles and inference -------------------------------------------------------------------------------------------

_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
spec_sql = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM part" for c in _PART)


@query("profile_columns", spec_sql)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(open_tables(spark, sf_dir, ["part"])[0]["part"]).drop("least", "greatest")


@query("profile_bounds", "SELECT 'p_size' AS column_name, CAST(min(p_size) AS VARCHAR) AS least, CAST(max(p_size) AS VARCHAR) AS greatest FROM part UNION ALL SELECT 'p_partkey', CAST(min(p_partkey) AS VARCHAR), CAST(max(p_partkey) AS VARCHAR) FROM part")
def profile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(open_tables(spark, sf_dir, ["part"])[0]["part"]).filter("column_name IN ('p_size', 'p_partkey')").select("column_name", "least", "greatest")


@query("frequent_values", "SELECT column_name, value, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS BIGINT) AS place FROM (SELECT 'p_brand' AS column_name, p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, CAST(count(*) AS BIGINT) FROM part GROUP BY 2)) WHERE place <= 20")
def frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequent_values(open_tables(spark, sf_dir, ["part"])[0]["part"], columns=["p_brand", "p_type"])


@query("overlap_sample", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part ORDER BY 1 LIMIT 100")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overlap_sample(open_tables(spark, sf_dir, ["part"])[0]["part"], "p_size")


@query("composite_distinct", "SELECT CAST(count(DISTINCT concat(p_brand, ' ', p_type)) AS BIGINT) AS n_distinct FROM part")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.composite_distinct(open_tables(spark, sf_dir, ["part"])[0]["part"], ["p_brand", "p_type"])


@query("array_elements", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS element FROM part")
def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.array_elements(open_tables(spark, sf_dir, ["part"])[0]["part"].select(F.split("p_type", " ").alias("e")), "e")


@query("infer_keys", "SELECT * FROM (VALUES ('customer', 'c_custkey', 'primary'), ('nation', 'n_nationkey', 'primary'), ('supplier', 's_suppkey', 'primary'), ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation')) t(table_name, column_name, found)")
def infer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = open_tables(spark, sf_dir, ["nation", "customer", "supplier"])
    catalog = profile.profile(frames, Catalog.reflect(frames))
    primary = profile.infer_primary_keys(frames, catalog)
    foreign = profile.infer_foreign_keys(frames, catalog)
    rows = [(t, c, "primary") for t, k in primary.items() for c in k] + [(k.table, k.columns[0], k.parent) for k in foreign]
    return spark.createDataFrame(rows, "table_name string, column_name string, found string")


@query("orphan_rate", "SELECT CAST(0 AS DOUBLE) AS rate")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    return spark.createDataFrame([(profile.orphan_rate(frames, next(k for k in catalog.foreign_keys if k.table == "orders")),)], "rate double")


@query("suggest_value", "SELECT DISTINCT c_mktsegment AS value, CAST(levenshtein(lower(c_mktsegment), 'bilding') AS INTEGER) AS distance FROM customer WHERE levenshtein(lower(c_mktsegment), 'bilding') <= 5")
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.suggest_value("bilding", open_tables(spark, sf_dir)[0]["customer"], "c_mktsegment")


# --- text, templates, persistence -------------------------------------------------------------------------------------

SQL_TEXTS = {
    "sql_import_group": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY c_mktsegment",
    "sql_import_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice BETWEEN 100000 AND 150000 AND c.c_acctbal IS NOT NULL",
    "sql_import_window": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders",
    "sql_import_case": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')",
    "sql_import_cte": "WITH t AS (SELECT avg(o_totalprice) AS a FROM orders) SELECT o_orderkey FROM orders, t WHERE o_totalprice > t.a",
}


def _import(name: str, text: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, catalog = open_tables(spark, sf_dir)
        return Compiler(frames, catalog, NOW).compile(sql_import.parse(text, catalog))


for _name, _text in SQL_TEXTS.items():
    _sql = _text.replace("count(*) AS n", "CAST(count(*) AS BIGINT) AS n").replace("rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)", "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST) AS BIGINT)")
    _import(_name, _text, _sql.replace("p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')", "lower(p_brand) IN ('brand#11', 'brand#12', 'brand#21')"))


@query("template_replay", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 300000")
def template_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    store = Store()
    kept = store.insert("orders with status O over 100000", Query(select=(item(order_key, "o_orderkey"),), tables=(O,), where=And((where(status, "=", "O"), where(price, ">", 100000)))))
    store.promote(kept.handle)
    found = store.match("orders with status F over 100000")
    return Compiler(frames, catalog, NOW).compile(store.replay(found.handle, p0="F", p1=300000))


@query("saved_specification", ORACLES["flagship"])
def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    return Compiler(frames, Catalog.from_json(catalog.to_json()), NOW).compile(loads(dumps(FLAGSHIP)))


@query("catalog_description", "SELECT 'region' AS table_name, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'nation', 3 UNION ALL SELECT 'customer', 5")
def description(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import Engine

    frames, catalog = open_tables(spark, sf_dir, ["region", "nation", "customer"])
    return Engine(spark, frames, catalog).describe().groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


from . import queries_shape, queries_uploads  # noqa: E402, F401  they register their queries here
