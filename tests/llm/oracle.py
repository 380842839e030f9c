"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

from touchline.llm.queries import QUERIES, SQL

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def assert_equals_sql(spark, sf_dir: str, name: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = con.sql(SQL[name])
    columns = sorted(wanted.columns)
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(wanted.columns, map(str, wanted.types)))
    assert {c: kinds.get(k, k) for c, k in found.dtypes} == types
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert rows
    assert rows == sorted((tuple(r) for r in wanted.select(*columns).fetchall()), key=str)
