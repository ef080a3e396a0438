"""Comparison with DuckDB as multisets of rows, columns by name."""

import math


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float("%.9g" % v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float("%.9g" % float(v))
    if isinstance(v, int):
        return float("%.9g" % v) if abs(v) < 1e9 else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def of(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck(con, sql):
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall()), sorted(c[0].lower() for c in cur.description)
