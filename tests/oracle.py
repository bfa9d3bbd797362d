"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x


def same_rows(df, con, sql):
    relation = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    ours = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_value(r[relation.columns.index(n)]) for n in names) for r in relation.fetchall()), key=repr)
    assert ours == theirs
    return ours
