"""Rows of a Spark query and of DuckDB's SQL, made comparable."""

import math


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x)


def same_rows(df, con, sql):
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    mine = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    other = sorted(tuple(cell(r[theirs.index(c)]) for c in names) for r in cursor.fetchall())
    assert mine == other
