"""Runs a query and its SQL on the same tables and compares all rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def _text(v):
    return "" if v is None else repr(float(v)) if isinstance(v, float) else str(v)


def same(df, sql, sf_dir):
    columns = sorted(df.columns)
    spark_rows = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert spark_rows == sorted(tuple(_text(r[i]) for i in at) for r in found.fetchall())
