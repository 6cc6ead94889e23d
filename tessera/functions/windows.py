"""The window-function whitelist and its rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANKING = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")
COUNTED = ("ntile", "nth_value")  # need n > 0
OFFSET = ("lag", "lead")  # by one row, without a default
VALUE = ("first_value", "last_value")
AGGREGATE = ("sum", "avg")
WHITELIST = (*RANKING, *COUNTED, *OFFSET, *VALUE, *AGGREGATE)


def check(func: str, has_arg: bool, n: int | None, has_order: bool) -> None:
    if func not in WHITELIST:
        raise ValueError(f"window function {func} is not in the whitelist")
    if func in COUNTED and not (n and n > 0):
        raise ValueError(f"{func} needs n > 0")
    if func not in AGGREGATE and not has_order:
        raise ValueError(f"{func} needs an order")
    if (func in RANKING or func == "ntile") == has_arg:
        raise ValueError(f"{func} takes {'no' if has_arg else 'an'} argument")


def apply(func: str, arg: Column | None, n: int | None, partition: list[Column], order: list[Column], frame: tuple | None) -> Column:
    """``frame``: (kind, start, end) with None for unbounded; without one the default is RANGE up to the current row."""
    spec = W.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
        if frame and func not in (*RANKING, "ntile", *OFFSET):
            kind, start, end = frame
            bounds = W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end
            spec = spec.rowsBetween(*bounds) if kind == "rows" else spec.rangeBetween(*bounds)
    if func in RANKING:
        made = getattr(F, func)()
    elif func == "ntile":
        made = F.ntile(n)
    elif func == "nth_value":
        made = F.nth_value(arg, n)
    else:
        made = {"lag": F.lag, "lead": F.lead, "first_value": F.first, "last_value": F.last, "sum": F.sum, "avg": F.avg}[func](arg)
    made = made.over(spec)
    return made.cast("bigint") if func in ("row_number", "rank", "dense_rank", "ntile") else made
