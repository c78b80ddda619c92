"""Spark rows against DuckDB rows of the same query."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def same(spark, name, query, sql, folder=SMALL):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found, wanted = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns), name
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(found) == rows(wanted), name
