"""Rows of a Spark query and of DuckDB's SQL over the same Parquet files, in one comparable form."""

import os

import duckdb


def normal(rows):
    return sorted(tuple("null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def spark_rows(df):
    names = sorted(df.columns)
    return names, normal([[r[c] for c in names] for r in df.collect()])


def duck_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), normal([[dict(zip(names, r, strict=True))[c] for c in sorted(names)] for r in found.fetchall()])
