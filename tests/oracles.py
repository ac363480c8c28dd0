"""Comparison of a query's rows with those of its DuckDB SQL."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(query, sql, spark, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert len(got) == len(want)
    assert [str(t) for t in got[names].dtypes] == [str(t) for t in want[names].dtypes]
    rows = lambda df: sorted(map(str, df[names].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
