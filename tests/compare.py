"""Spark's result of a query against DuckDB's of its SQL, column by column name."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def check(spark, run, sql):
    link = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        link.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, other = run(spark, SF), link.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)

    def rows(columns, found):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in found)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(other.columns, other.fetchall())
