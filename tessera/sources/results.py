"""Results: batches, caps, Arrow, CSV, and statements of earlier sessions."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.spec import Refusal


def batches(df: DataFrame, rows: int = 10_000) -> Iterator[list]:
    """Rows in lists, partition by partition: the driver holds two partitions at most."""
    it = df.toLocalIterator(prefetchPartitions=True)
    while chunk := list(islice(it, rows)):
        yield chunk


def capped(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 268_435_456) -> list:
    """All rows, or a refusal beyond a cap; no more than one row over it is fetched."""
    out, size = [], 0
    for chunk in batches(df.limit(most_rows + 1)):
        out += chunk
        size += sum(len(str(r)) for r in chunk)
        if len(out) > most_rows:
            raise Refusal(f"more than {most_rows} rows")
        if size > most_bytes:
            raise Refusal(f"more than {most_bytes} bytes")
    return out


def arrow(df: DataFrame):
    return df.toArrow()


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, written by the executors; ``single`` streams the rows into one file of the driver."""
    if single:
        with open(path, "w", newline="") as file:
            out = csv.writer(file)
            out.writerow(df.columns)
            for chunk in batches(df):
                out.writerows(chunk)
    else:
        df.write.csv(path, header=True, mode="overwrite")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def statements(path: str) -> list[str]:
    """SELECT statements of a SQL file or query history, without comments and repeats."""
    return select_statements(Path(path).read_text())


def select_statements(text: str) -> list[str]:
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL)
    found = (re.sub(r"\s+", " ", s).strip() for s in re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", text))
    return list(dict.fromkeys(s for s in found if re.match(r"(?i)(select|with)\b", s)))


def run_sql(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """SQL text with named parameters, bound by Spark and never spliced in."""
    return spark.sql(sql, args=params or {})
