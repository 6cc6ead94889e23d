"""The scalar whitelist. Results have the types that an independent SQL engine gives (counts of characters are bigint, floors stay double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates

STRING = ("upper", "lower", "trim", "ltrim", "rtrim", "length", "concat")
NUMERIC = ("abs", "round", "floor", "ceil", "coalesce")
TEMPORAL = ("date_trunc", "extract", "date_part", "year", "month", "day")
WHITELIST = (*STRING, *NUMERIC, *TEMPORAL)
#: Default second arguments.
DEFAULTS = {"round": 2, "coalesce": 0}


def apply(func: str, args: list[Column], unit: str = "") -> Column:
    """``args`` are Columns, but for round's digits, an int."""
    if func in ("upper", "lower", "trim", "ltrim", "rtrim", "abs"):
        return getattr(F, func)(args[0])
    if func == "length":
        return F.length(args[0]).cast("bigint")
    if func == "concat":
        return F.concat_ws("", *args)  # nulls are skipped
    if func == "round":
        return F.round(args[0], args[1])
    if func in ("floor", "ceil"):
        return getattr(F, func)(args[0]).cast("double")
    if func == "coalesce":
        return F.coalesce(*args)
    if func == "date_trunc":
        return dates.truncate(unit, args[0])
    if func in ("extract", "date_part"):
        return dates.part(unit, args[0])
    if func in ("year", "month", "day"):
        return dates.part(func, args[0])
    raise ValueError(f"function {func} is not in the whitelist")
