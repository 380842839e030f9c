"""Runs every registered query next to its SQL: ``python tests/oracle_check.py [sf_dir] [name...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events".split()

_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET temp_directory = ''")  # the long forms must fit in memory
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def compare(df, con, name: str) -> str:
    """Empty when the query's result and its SQL agree, else what differs."""
    found = _rows(df.columns, df.collect())
    result = con.execute(oracle_sql()[name])
    columns = {c[0]: str(c[1]) for c in result.description}
    wanted = _rows(list(columns), result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {c: _KINDS.get(kind, kind) for c, kind in df.dtypes}
    if kinds != columns:
        return f"types {kinds} / {columns}"
    if found != wanted:
        pairs = [pair for pair in zip(found, wanted) if pair[0] != pair[1]]
        return f"rows {len(found)} / {len(wanted)}, first difference {pairs[:1]}"
    return "" if found else "empty on both sides"


if __name__ == "__main__":
    from touchline.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("oracle check"), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or queries():
        began = time.time()
        problem = compare(queries()[name](spark, sf_dir), con, name)
        bad += bool(problem)
        print(f"{name:32s} {time.time() - began:6.1f}s {problem or 'ok'}"[:1500], flush=True)
    sys.exit(bad > 0)
