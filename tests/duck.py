"""Comparison with DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda x: None if x is None or x is pd.NA or x != x else round(x, 9) if isinstance(x, float) else x
    return list(frame.columns), sorted((tuple(map(shown, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


def same_rows(spark, query, sql, sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert rows_of(query(spark, sf_dir).toPandas()) == rows_of(connection.sql(sql).df())
