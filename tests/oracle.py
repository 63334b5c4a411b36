"""Runs a query and its SQL over the same tables and compares all rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in plain.itertuples(index=False, name=None)))


def compare(spark, query, sql: str, sf_dir: str) -> int:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, expected = query(spark, sf_dir).toPandas(), c.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)
    return len(got)
