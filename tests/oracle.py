"""Runs a query's oracle SQL with DuckDB and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())


def duckdb_rows(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        columns = sorted(names)
        at = [names.index(x) for x in columns]
        return columns, sorted(tuple(normal(x[i]) for i in at) for x in r.fetchall())
