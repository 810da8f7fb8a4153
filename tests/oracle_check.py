"""Runs queries beside their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, query, sql: str, sf_dir: str = SF) -> str:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(names).collect())
    rel = connect(sf_dir).sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    want = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.select(*names).fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
