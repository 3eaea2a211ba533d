"""Comparison of a query with its SQL, as rows without order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql: str, sf_dir: str) -> None:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    b = c.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(b.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    left = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    right = sorted(b.select(*[f'"{x}"' for x in cols]).fetchall(), key=key)
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert x == y
