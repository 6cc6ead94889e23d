"""The aggregate whitelist."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITELIST = ("count", "sum", "avg", "min", "max", "string_agg", "stddev", "variance", "median")


def apply(func: str, arg: Column | None, distinct: bool = False, separator: str | None = None, order: list[Column] = ()) -> Column:
    """``order`` are sort expressions; string_agg with one collects and sorts, so it needs no second shuffle."""
    if func == "count":
        return F.count(F.lit(1)) if arg is None else F.count_distinct(arg) if distinct else F.count(arg)
    if func == "string_agg":
        if order:
            return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], arg.alias("v")))), lambda x: x["v"]), separator)
        return F.listagg_distinct(arg, F.lit(separator)) if distinct else F.listagg(arg, F.lit(separator))
    if func in ("sum", "avg"):
        if distinct:
            return F.sum_distinct(arg) if func == "sum" else F.sum_distinct(arg) / F.count_distinct(arg)
        return getattr(F, func)(arg)
    made = {"min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp, "median": F.median}
    if func not in made:
        raise ValueError(f"aggregate {func} is not in the whitelist")
    return made[func](arg)
