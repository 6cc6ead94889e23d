import datetime
import math


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=repr)
