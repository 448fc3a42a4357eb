"""Spark results against SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "as_integer_ratio"):
        return round(float(v), 9)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [("columns", sorted(spark_df.columns), sorted(names))]
    if len(got) != len(want):
        g, w = set(got), set(want)
        return [("rows", len(got), len(want)), *list(g - w)[:2], *list(w - g)[:2]]
    bad = []
    for g, w in zip(got, want):
        if g != w and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(g, w)):
            bad.append((g, w))
    return bad[:3]
