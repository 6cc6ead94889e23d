"""Set operations over whole results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame], columns: dict[str, str] | None = None) -> DataFrame:
    """All rows, aligned by name; ``columns`` gives the types to cast to."""
    if columns:
        parts = [p.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def intersect_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` whose keys are in ``right``; null keys match nothing."""
    return left.join(right.select(*[F.col(b).alias(f"__{i}") for i, (_, b) in enumerate(keys)]), [F.col(a) == F.col(f"__{i}") for i, (a, _) in enumerate(keys)], "left_semi")


def except_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` whose keys are not in ``right``; rows with null keys stay."""
    return left.join(right.select(*[F.col(b).alias(f"__{i}") for i, (_, b) in enumerate(keys)]), [F.col(a) == F.col(f"__{i}") for i, (a, _) in enumerate(keys)], "left_anti")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two results hold the same rows, as often."""
    return left.columns == right.columns and not left.exceptAll(right).take(1) and not right.exceptAll(left).take(1)
