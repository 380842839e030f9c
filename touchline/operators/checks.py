"""Key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count. Keys with a NULL part never clash."""
    counted = df.dropna(subset=list(keys)).groupBy(*keys).count()
    return counted.withColumnRenamed("count", "n_rows").where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key repeats; shows a few offenders."""
    offenders = duplicate_keys(df, keys).limit(5).collect()
    if offenders:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {[tuple(r) for r in offenders]}")
