"""Compare a Spark query with its SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def spark_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def sql_rows(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
