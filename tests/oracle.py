"""Compares a query's rows with those of its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def assert_same(df, sql: str, sf_dir: str) -> int:
    names, expected = sql_rows(sql, sf_dir)
    got = df.collect()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(_plain(r[c]) for c in order) for r in got), key=repr)
    right = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in expected), key=repr)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a == b
    return len(left)
