"""Results of Spark and DuckDB as sorted rows, for comparison."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


def spark_rows(df):
    return rows(df.columns, df.collect())


def duck_rows(sql, folder):
    with duckdb.connect() as con:
        for t in TABLES:
            if Path(f"{folder}/{t}.parquet").exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        con.execute("SET timezone = 'UTC'")
        con.execute("SET max_temp_directory_size = '4GB'")
        got = con.execute(sql)
        return rows([c[0] for c in got.description], got.fetchall())
