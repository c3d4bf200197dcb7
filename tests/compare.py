"""Compare a query's rows with what DuckDB returns for its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else v


def rows_of(names, rows, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    mine, theirs = rows_of(df.columns, df.collect(), order), rows_of(names, found.fetchall(), order)
    assert mine == theirs
    return len(mine)
