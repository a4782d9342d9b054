"""Runs a registered query and its SQL counterpart side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0) if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, query, sql, sf):
    """None if equal, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; {diff}"
    return None
