"""Compares a query with its SQL in DuckDB, order aside."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _text(v) -> str:
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if pd.isna(v):
        return "null"
    return str(int(v)) if isinstance(v, (int, float)) and v == int(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, name: str, sf_dir: str) -> None:
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
