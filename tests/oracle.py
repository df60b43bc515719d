"""A query's rows against its SQL in DuckDB on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value if isinstance(value, (int, float, str, bool)) else str(pd.Timestamp(value))[:19]


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(normal(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    (names, got), (expected_names, expected) = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).fetchdf())
    assert names == expected_names
    assert len(got) == len(expected)
    assert [p for p in zip(got, expected, strict=True) if p[0] != p[1]][:3] == []
