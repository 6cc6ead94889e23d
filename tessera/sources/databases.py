"""JDBC databases and their catalogs. Drivers come with the cluster; without one, Spark's own error says so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import Catalog, ForeignKey
from .results import select_statements

#: JDBC drivers and URL patterns by engine.
ENGINES = {
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}"),
    "duckdb": ("org.duckdb.DuckDBDriver", "jdbc:duckdb:{database}"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "mariadb": ("org.mariadb.jdbc.Driver", "jdbc:mariadb://{host}:{port}/{database}"),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}"),
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}"),
    "bigquery": ("com.simba.googlebigquery.jdbc.Driver", "jdbc:bigquery://{host}:{port};ProjectId={database}"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}"),
    "spark": ("", ""),
}
PORTS = {"mysql": 3306, "mariadb": 3306, "sqlserver": 1433, "postgresql": 5432, "redshift": 5439, "bigquery": 443, "oracle": 1521}

#: Foreign keys of the engines with an information schema: child, column, parent, parent column, constraint, position.
INFORMATION_SCHEMA_KEYS = """
SELECT c.table_name AS child, c.column_name AS child_column, p.table_name AS parent, p.column_name AS parent_column, r.constraint_name AS name, c.ordinal_position AS place
FROM information_schema.referential_constraints r
JOIN information_schema.key_column_usage c ON c.constraint_name = r.constraint_name AND c.constraint_schema = r.constraint_schema
JOIN information_schema.key_column_usage p ON p.constraint_name = r.unique_constraint_name AND p.constraint_schema = r.unique_constraint_schema AND p.ordinal_position = c.position_in_unique_constraint"""
#: MySQL and MariaDB call every primary key PRIMARY, so keys cannot be joined by name there; they name the parent themselves.
MYSQL_KEYS = """
SELECT table_name AS child, column_name AS child_column, referenced_table_name AS parent, referenced_column_name AS parent_column, constraint_name AS name, ordinal_position AS place
FROM information_schema.key_column_usage WHERE table_schema = DATABASE() AND referenced_table_name IS NOT NULL"""
MYSQL_PRIMARY = """
SELECT table_name AS child, column_name AS child_column, ordinal_position AS place
FROM information_schema.key_column_usage WHERE table_schema = DATABASE() AND constraint_name = 'PRIMARY'"""
#: Engines without an information schema of keys.
ORACLE_KEYS = """
SELECT c.table_name AS child, c.column_name AS child_column, p.table_name AS parent, p.column_name AS parent_column, r.constraint_name AS name, c.position AS place
FROM user_constraints r
JOIN user_cons_columns c ON c.constraint_name = r.constraint_name
JOIN user_cons_columns p ON p.constraint_name = r.r_constraint_name AND p.position = c.position
WHERE r.constraint_type = 'R'"""
ORACLE_PRIMARY = """
SELECT c.table_name AS child, c.column_name AS child_column, c.position AS place
FROM user_constraints r JOIN user_cons_columns c ON c.constraint_name = r.constraint_name WHERE r.constraint_type = 'P'"""
SQLITE_KEYS = """
SELECT m.name AS child, f."from" AS child_column, f."table" AS parent, coalesce(f."to", f."from") AS parent_column, 'key_' || f.id AS name, f.seq AS place
FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE m.type = 'table'"""
SQLITE_PRIMARY = """
SELECT m.name AS child, c.name AS child_column, c.pk AS place
FROM sqlite_master m JOIN pragma_table_info(m.name) c WHERE m.type = 'table' AND c.pk > 0"""
INFORMATION_SCHEMA_PRIMARY = """
SELECT k.table_name AS child, k.column_name AS child_column, k.ordinal_position AS place
FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k ON k.constraint_name = t.constraint_name AND k.table_schema = t.table_schema AND k.table_name = t.table_name
WHERE t.constraint_type = 'PRIMARY KEY'"""
KEYS = {"mysql": (MYSQL_PRIMARY, MYSQL_KEYS), "mariadb": (MYSQL_PRIMARY, MYSQL_KEYS), "oracle": (ORACLE_PRIMARY, ORACLE_KEYS), "sqlite": (SQLITE_PRIMARY, SQLITE_KEYS)}


#: Where engines keep the statements that ran last; ``{most}`` is how many. Embedded ones keep none.
QUERY_LOGS = {
    "databricks": "SELECT statement_text AS statement FROM system.query.history WHERE statement_type = 'SELECT' ORDER BY start_time DESC LIMIT {most}",
    "mysql": "SELECT query_sample_text AS statement FROM performance_schema.events_statements_summary_by_digest WHERE schema_name = DATABASE() ORDER BY last_seen DESC LIMIT {most}",
    "redshift": "SELECT query_text AS statement FROM sys_query_history WHERE query_type = 'SELECT' ORDER BY start_time DESC LIMIT {most}",
    "sqlserver": "SELECT TOP {most} t.text AS statement FROM sys.dm_exec_query_stats s CROSS APPLY sys.dm_exec_sql_text(s.sql_handle) t ORDER BY s.last_execution_time DESC",
    "oracle": "SELECT sql_fulltext AS statement FROM v$sql WHERE parsing_schema_name = USER ORDER BY last_active_time DESC FETCH FIRST {most} ROWS ONLY",
    "snowflake": "SELECT query_text AS statement FROM TABLE(information_schema.query_history(result_limit => {most})) WHERE query_type = 'SELECT'",
    "bigquery": "SELECT query AS statement FROM `region-us`.INFORMATION_SCHEMA.JOBS_BY_PROJECT WHERE statement_type = 'SELECT' ORDER BY creation_time DESC LIMIT {most}",
    "postgresql": "SELECT query AS statement FROM pg_stat_statements ORDER BY calls DESC LIMIT {most}",
}
QUERY_LOGS["mariadb"], QUERY_LOGS["spark"] = QUERY_LOGS["mysql"].replace("query_sample_text", "digest_text"), QUERY_LOGS["databricks"]


@dataclass
class Database:
    """A JDBC source. Reads are split over ``partitions`` ranges of ``split_by``, and filters and columns are pushed down."""

    engine: str
    database: str
    host: str = "localhost"
    port: int | None = None
    user: str = ""
    password: str = ""
    options: dict | None = None

    def url(self) -> str:
        if self.engine not in ENGINES:
            raise ValueError(f"unknown engine {self.engine}")
        return ENGINES[self.engine][1].format(host=self.host, port=self.port or PORTS.get(self.engine, ""), database=self.database)

    def _reader(self, spark: SparkSession):
        own = {"url": self.url(), "driver": ENGINES[self.engine][0], "fetchsize": "10000", "pushDownAggregate": "true", "pushDownLimit": "true"} | ({"user": self.user, "password": self.password} if self.user else {})
        return spark.read.format("jdbc").options(**own, **(self.options or {}))

    def table(self, spark: SparkSession, name: str, split_by: str = "", bounds: tuple | None = None, partitions: int = 16) -> DataFrame:
        if self.engine == "spark":
            return spark.table(name)
        reader = self._reader(spark).option("dbtable", name)
        if split_by:
            if bounds is None:
                low, high = self.query(spark, f"SELECT min({split_by}) AS low, max({split_by}) AS high FROM {name}").first()
                bounds = (low, high) if low is not None else (0, 0)
            reader = reader.options(partitionColumn=split_by, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
        return reader.load()

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return self._reader(spark).option("query", sql).load()

    def keys(self, spark: SparkSession) -> tuple[dict[str, tuple], list[ForeignKey]]:
        """Declared primary and foreign keys, by the engine's own views of them, or the information schema."""
        of_primary, of_foreign = KEYS.get(self.engine, (INFORMATION_SCHEMA_PRIMARY, INFORMATION_SCHEMA_KEYS))
        primary: dict[str, list] = {}
        for r in sorted(self.query(spark, of_primary).collect(), key=lambda r: r["place"]):
            primary.setdefault(r["child"], []).append(r["child_column"])
        edges: dict[tuple, list] = {}
        for r in sorted(self.query(spark, of_foreign).collect(), key=lambda r: r["place"]):
            edges.setdefault((r["name"], r["child"], r["parent"]), []).append((r["child_column"], r["parent_column"]))
        return {t: tuple(c) for t, c in primary.items()}, [ForeignKey(c, tuple(a for a, _ in on), p, tuple(b for _, b in on)) for (_, c, p), on in edges.items()]

    def query_log(self, spark: SparkSession, most: int = 500) -> list[str]:
        """SELECT statements that the engine ran last, without repeats; none where it keeps no log (SQLite, DuckDB)."""
        if self.engine not in QUERY_LOGS:
            return []
        sql = QUERY_LOGS[self.engine].format(most=int(most))
        rows = (spark.sql(sql) if self.engine == "spark" else self.query(spark, sql)).collect()
        return list(dict.fromkeys(s for r in rows for s in select_statements(r["statement"] or "")))

    def reflect(self, spark: SparkSession, names: list[str], sidecar: Catalog | None = None, split_by: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], Catalog]:
        """Frames and catalog; keys come from the database where it declares them, else from a saved catalog.

        ``split_by`` names the number or date column by which a large table is read in parallel.
        """
        frames = {n: self.table(spark, n, (split_by or {}).get(n, "")) for n in names}
        if sidecar is not None:
            primary, foreign = {n: t.primary_key for n, t in sidecar.tables.items() if n in frames}, [k for k in sidecar.foreign_keys if k.table in frames and k.parent in frames]
        else:
            primary, foreign = self.keys(spark)
        return frames, Catalog.reflect(frames, primary, foreign, self.engine)
