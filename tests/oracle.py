"""Compare a query with its SQL on the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def database(d=DATA):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def compare(spark, f, sql, d=DATA):
    """None if names and rows are the same, else what differs."""
    got = f(spark, d)
    names = sorted(got.columns)
    rows = sorted((plain(r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    rel = database(d).execute(sql)
    cols = [x[0] for x in rel.description]
    if sorted(cols) != names:
        return f"columns {names} {sorted(cols)}"
    order = [cols.index(n) for n in names]
    want = sorted((plain(tuple(r[i] for i in order)) for r in rel.fetchall()), key=repr)
    if rows != want:
        only = [x for x in rows if x not in set(want)][:3], [x for x in want if x not in set(rows)][:3]
        return f"{len(rows)} and {len(want)} rows; {only}"
    return None
