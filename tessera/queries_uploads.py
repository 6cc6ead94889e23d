"""Queries over uploads, their transforms, imported SQL text and refusals; they join those of ``queries``."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import sql_import, validate
from .plans.compile import Compiler
from .plans.spec import Agg, Query, Refusal, Step, col, item, where
from .queries import NOW, query
from .sources import ingest, results
from .sources.tables import open_tables

# --- transforms of uploads, over whole tables ---------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return open_tables(spark, sf_dir, [name])[0][name]


@query("upload_parse_temporal", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(key % 7 == 0, "no day").when(key % 2 == 0, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return ingest.transform(_read(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), [("parse_temporal", {"column": "day", "formats": ("yyyy-MM-dd", "dd.MM.yyyy")})])


@query("upload_strip_numeric_affix", "SELECT c_custkey, CAST(round(c_acctbal, 2) AS DOUBLE) AS v FROM customer")
def strip_numeric_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_number(F.abs("c_acctbal"), 2)
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), shown, F.lit(")"))).when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("$"), shown)).otherwise(F.concat(shown, F.lit(" EUR")))
    return ingest.transform(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("v")), [("strip_numeric_affix", {"column": "v"})])


@query("upload_band_value_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'houses' WHEN 'MACHINERY' THEN 'engines' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def band_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.transform(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [("band_value_map", {"column": "c_mktsegment", "values": {"BUILDING": "houses", "MACHINERY": "engines"}})])


@query("upload_keep_canonical_columns", "SELECT c_custkey, c_name AS name FROM customer")
def keep_canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("c_custkey") % 3
    parts = [F.when(third == k, F.col("c_name")).alias(n) for k, n in enumerate(("name", "customer_name", "full_name"))]
    return ingest.transform(_read(spark, sf_dir, "customer").select("c_custkey", *parts), [("keep_canonical_columns", {"canonical": {"name": ["customer_name", "full_name"]}})])


@query("upload_derive_by_pattern", "SELECT p_partkey, p_brand, nullif(regexp_extract(p_brand, '#([0-9])', 1), '') AS maker FROM part")
def derive_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.transform(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), [("derive_by_pattern", {"column": "p_brand", "target": "maker", "pattern": "#([0-9])"})])


@query("upload_drop_empty_columns", "SELECT s_suppkey, s_name FROM supplier")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.transform(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(" ").alias("blank"), F.lit(None).cast("string").alias("nothing")), [("drop_empty_columns", {})])


@query("upload_null_tokens", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_name END AS v FROM customer")
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    fourth = F.col("c_custkey") % 4
    text = F.when(fourth == 0, "N/A").when(fourth == 1, " - ").when(fourth == 2, "NULL").otherwise(F.col("c_name"))
    return ingest.transform(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("v")), [("null_tokens", {"column": "v"})])


@query("upload_band_bounds", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 40.0::DOUBLE ELSE (p_size - p_size % 10)::DOUBLE END AS low, CASE WHEN p_size < 40 THEN (p_size - p_size % 10 + 9)::DOUBLE END AS high FROM part")
def band_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("p_size") - F.col("p_size") % 10
    text = F.when(F.col("p_size") >= 40, "40+").otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))
    return ingest.transform(_read(spark, sf_dir, "part").select("p_partkey", text.alias("band")), [("band_bounds", {"column": "band", "low": "low", "high": "high"})]).drop("band")


@query("upload_unpivot_columns", "SELECT o_orderkey, 'price' AS name, CAST(o_totalprice AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM orders")
def unpivot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return ingest.transform(wide, [("unpivot_columns", {"keep": ["o_orderkey"], "columns": ["price", "customer"]})])


# --- uploads: the 25 nations and 5 regions as files of the driver --------------------------------------------------------


def _csv(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """The relation of an upload that ``text`` writes from the nations (key, name, region)."""
    rows = sorted(map(tuple, _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()))
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "Nations 1.csv")
        path.write_bytes(text(rows))
        (frame,) = ingest.ingest(spark, [str(path)]).values()
    return frame


_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"


@query("upload_csv_preamble_total", _NATIONS)
def csv_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir, lambda rows: ("All nations\n\nId;Name;Region\n" + "".join(f"{a};{b};{c}\n" for a, b, c in rows) + ";;\nTotal;;\n").encode())


@query("upload_csv_dialect_encoding", _NATIONS.replace("n_name AS", "concat(n_name, ' é, \"x\"') AS"))
def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv(spark, sf_dir, lambda rows: ("Id\tName\tRegion\n" + "".join(f'{a}\t"{b} é, ""x"""\t{c}\n' for a, b, c in rows)).encode("cp1252"))


@query("upload_csv_regions_appended", _NATIONS)
def csv_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda rows: "Id,Name,Region\n" + "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    return _csv(spark, sf_dir, lambda rows: (part(rows[:12]) + ",,\n" + part(rows[12:])).encode())


@query("upload_types", "SELECT CAST(n_nationkey AS BIGINT) AS id, make_date(CAST(2000 + n_nationkey AS BIGINT), 1, 5) AS day, n_nationkey % 2 = 0 AS even, CAST(n_nationkey * 1000.5 AS DOUBLE) AS amount, CAST(n_nationkey AS DOUBLE) AS share, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS name FROM nation")
def upload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda a, b: f'{a};{2000 + a}-01-05;{"yes" if a % 2 == 0 else "no"};"${a * 1000.5:,.2f}";{a}%;{b if a % 5 else "n/a"}\n'
    return _csv(spark, sf_dir, lambda rows: ("Id;Day;Even;Amount;Share;Name\n" + "".join(line(a, b) for a, b, _ in rows)).encode())


@query("upload_issues", "SELECT 'blank_row' AS kind UNION ALL SELECT 'total_row' UNION ALL SELECT 'number_as_text'")
def upload_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "sales.csv")
        path.write_text("Report of sales\n\nId;Name;Amount;Paid;Day\n1;Ann;$1,200.50;yes;2024-01-05\n2;Bob;$0;no;2024-02-06\n;;;;\nTotal;;$1,200.50;;\n")
        kinds = {i.kind for found in ingest.inspect(str(path)).values() for i in found}
    return spark.createDataFrame([(k,) for k in sorted(kinds & {"blank_row", "total_row", "number_as_text"})], "kind string")


@query("upload_transposed", "SELECT 'nations' AS table_name, CAST(25 AS BIGINT) AS size")
def upload_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = str(_read(spark, sf_dir, "nation").count())
    return ingest.to_frame(spark, ingest.to_relation("facts", [["table_name", "nations"], ["size", size]]))


@query("results_csv_round_trip", "SELECT o_orderkey, o_totalprice FROM orders")
def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    folder = tempfile.mkdtemp()
    results.write_csv(frame, f"{folder}/orders")
    return ingest.read_csv(spark, f"{folder}/orders", frame._jdf.schema().toDDL())


@query("results_parquet_spill", "SELECT c_custkey, c_mktsegment FROM customer")
def results_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tempfile.mkdtemp()
    results.write_parquet(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), f"{folder}/spill", ["c_mktsegment"])
    return spark.read.parquet(f"{folder}/spill")


# --- imported SQL text ---------------------------------------------------------------------------------------------------

SQL_TEXTS = {
    "sql_import_like_escape": ("SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'", "SELECT n_name FROM nation WHERE n_name ILIKE 'NATION!_1%' ESCAPE '!'"),
    "sql_import_like_slash": ("SELECT c_custkey FROM customer WHERE concat(c_name, '/x') LIKE '%/x'", None),
    "sql_import_like_two_slashes": ("SELECT c_custkey FROM customer WHERE concat(c_name, '//x') LIKE '%//x'", None),
    "sql_import_from_subquery": ("SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 12", None),
    "sql_import_nested_subquery": ("SELECT u.k FROM (SELECT t.k AS k, t.n AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 5) u WHERE u.n < 20", None),
    "sql_import_in": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "sql_import_not_in": ("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "sql_import_exists": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "sql_import_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey)", None),
    "sql_import_not_group": ("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 1000 OR o_orderkey < 100)", None),
    "sql_import_distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", None),
    "sql_import_first_row": ("SELECT t.o_custkey, t.o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE t.n = 1", None),
}


def _text(name: str, text: str, oracle: str) -> None:
    @query(name, oracle.replace("count(*) AS n", "CAST(count(*) AS BIGINT) AS n"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames, catalog = open_tables(spark, sf_dir)
        return Compiler(frames, catalog, NOW).compile(sql_import.parse(text, catalog))


for _name, (_given, _own) in SQL_TEXTS.items():
    _text(_name, _given, _own or _given)

# --- refusals ------------------------------------------------------------------------------------------------------------

REFUSED_TEXTS = {
    "data change": "DELETE FROM orders",
    "set operation": "SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer",
    "lateral": "SELECT 1 FROM orders, LATERAL (SELECT 2) x",
    "recursive": "WITH RECURSIVE t AS (SELECT 1) SELECT * FROM t",
    "offset": "SELECT o_orderkey FROM orders OFFSET 5",
    "json path": "SELECT props->'k' FROM events",
    "pivot": "SELECT * FROM orders PIVOT (sum(x) FOR y IN (1))",
    "grouping sets": "SELECT o_custkey, count(*) FROM orders GROUP BY GROUPING SETS ((o_custkey), ())",
    "rollup": "SELECT o_custkey, count(*) FROM orders GROUP BY ROLLUP(o_custkey)",
    "two statements": "SELECT 1 FROM orders; SELECT 2 FROM orders",
    "cross join": "SELECT o_orderkey FROM orders CROSS JOIN customer",
    "full join": "SELECT o_orderkey FROM orders FULL JOIN customer ON o_custkey = c_custkey",
    "unknown function": "SELECT soundex(c_name) FROM customer",
    "exists without a key": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders)",
    "subquery beside or": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders)",
}
_key, _price = col("orders.o_orderkey"), col("orders.o_totalprice")
REFUSED_SPECS = {
    "nested aggregation": Query(select=(item(Agg("sum", Agg("max", _price)), "x"),), tables=("orders",)),
    "select outside of group by": Query(select=(item(_key, "k"), item(Agg("count"), "n")), tables=("orders",), group_by=(col("orders.o_custkey"),)),
    "fan-out of an aggregate": Query(select=(item(Agg("sum", _price), "x"), item(Agg("sum", col("lineitem.l_quantity")), "y")), tables=("orders", "lineitem")),
    "null in a negated list": Query(select=(item(_key, "k"),), tables=("orders",), where=where(col("orders.o_custkey"), "not in", (1, None))),
    "unknown column": Query(select=(item(col("orders.nothing"), "k"),), tables=("orders",)),
    "sum of a text": Query(select=(item(Agg("sum", col("customer.c_name")), "x"),), tables=("customer",)),
    "scalar with groups": Query(select=(item(_key, "k"),), tables=("orders",), steps=(Step("s", Query(select=(item(Agg("count"), "n"),), tables=("orders",), group_by=(col("orders.o_custkey"),)), "scalar"),)),
    "probe without keys": Query(select=(item(_key, "k"),), tables=("orders",), steps=(Step("p", Query(select=(item(_key, "k"),), tables=("orders",)), "semi"),)),
    "no relation": Query(select=(item(_key, "k"), item(col("embeddings.vec_id"), "v")), tables=("orders", "embeddings")),
    "more than sixteen steps": Query(select=(item(_key, "k"),), tables=("orders",), steps=tuple(Step(f"s{k}", Query(select=(item(_key, "k"),), tables=("orders",))) for k in range(17))),
}


def _refused(spark: SparkSession, cases: dict, run) -> DataFrame:
    def one(case) -> bool:
        try:
            run(case)
        except (Refusal, ValueError):
            return True
        return False

    return spark.createDataFrame([(name, one(case)) for name, case in cases.items()], "what string, refused boolean")


def _all_refused(cases: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS what, TRUE AS refused" for name in cases)


@query("refused_sql_text", _all_refused(REFUSED_TEXTS))
def refused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = open_tables(spark, sf_dir)[1]
    return _refused(spark, REFUSED_TEXTS, lambda text: validate.check(sql_import.parse(text, catalog), catalog))


@query("refused_specifications", _all_refused(REFUSED_SPECS))
def refused_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, catalog = open_tables(spark, sf_dir)
    return _refused(spark, REFUSED_SPECS, lambda q: (validate.check(q, catalog), Compiler(frames, catalog, NOW).compile(q)))
