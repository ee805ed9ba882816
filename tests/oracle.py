"""A query's rows against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return round(v, 9) if isinstance(v, float) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(df, sql, folder):
    """(columns alike, rows of df missing in the SQL's, and the other way round)."""
    rel = connect(folder).sql(sql)
    want, cols = rel.fetchall(), list(rel.columns)
    mine = df.columns
    if sorted(mine) != sorted(cols):
        return False, mine, cols
    names = sorted(mine)
    a = rows_of([tuple(r) for r in df.collect()], [mine.index(n) for n in names])
    b = rows_of(want, [cols.index(n) for n in names])
    if a == b:
        return True, [], []
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return True, list((x - y).elements()), list((y - x).elements())
