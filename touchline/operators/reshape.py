"""Pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_mean(
    df: DataFrame, index: str, columns: str, values: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Mean of ``values`` per index and label; empty cells are NULL, NULL index rows drop out.

    Pass ``labels`` to save the extra job that looks them up.
    """
    grouped = df.dropna(subset=[index]).groupBy(index)
    return grouped.pivot(columns, list(labels) if labels else None).agg(F.avg(values))


def pivot_strict(
    df: DataFrame, index: str, columns: str, values: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Pivot that fails when two rows claim the same cell."""
    clash = f"raise_error(concat_ws(' / ', 'duplicate cell', {index}, {columns}))"
    cells = (
        df.groupBy(index, columns)
        .agg(F.count("*").alias("_rows"), F.min(values).alias("_value"))
        .selectExpr(index, columns, f"if(_rows = 1, _value, {clash}) AS {values}")
    )
    return cells.groupBy(index).pivot(columns, list(labels) if labels else None).agg(F.max(values))
