"""Comparing a Spark result with DuckDB's."""

import math


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


def same(df, rel):
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(tidy(r[i]) for i in place) for r in rel.fetchall()), key=str)
    assert got == want
