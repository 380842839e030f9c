"""Surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import quoted
from touchline.session import stage

# monotonically_increasing_id: partition number above bit 33, row number below.
_ROW_BITS = 33


def contiguous_ids(df: DataFrame, order: Sequence[str] | None, id_col: str) -> DataFrame:
    """Number the rows 1..N in the order of ``order``: SQL expressions that identify a row.

    A range shuffle sorts the rows in parallel and each task counts its own. The numbered
    rows are staged, so both uses below see the same placement. The per-task counts that turn
    local into global numbers are one row per shuffle partition, hence the broadcast.

    Without an ``order`` the rows are numbered where they are: no shuffle, but another run may
    number them differently.
    """
    rows = df
    if order is not None:
        ordering = [F.expr(e).asc_nulls_last() for e in order]
        rows = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    placed = stage(rows.withColumn("_place", F.monotonically_increasing_id()), id_col)
    placed = placed.selectExpr("*", f"shiftright(_place, {_ROW_BITS}) AS _task")
    sizes = placed.groupBy("_task").count()
    offsets = sizes.selectExpr("_task", "sum(count) OVER (ORDER BY _task) - count AS _offset")
    row = f"(_place & {(1 << _ROW_BITS) - 1})"
    return placed.join(F.broadcast(offsets), "_task").selectExpr(
        f"_offset + {row} + 1 AS {id_col}", *quoted(df.columns)
    )


def label_ids(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """Number a short dimension by its label. Only for label sets with a small proven bound.

    NULL comes last and is dropped after the numbering: a filter before it would be pushed down
    to every source row.
    """
    number = f"row_number() OVER (ORDER BY {label} ASC NULLS LAST) AS {id_col}"
    return labels.selectExpr(number, label).where(f"{label} IS NOT NULL")
