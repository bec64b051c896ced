"""Compare a query with its DuckDB oracle, as sorted rows by sorted columns."""

import datetime
import decimal
import glob
import math
import os


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in r)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def differs(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows and {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return None
