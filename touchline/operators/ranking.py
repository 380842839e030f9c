"""Top-k and arg-max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str, tie_break: Sequence[str], k: int = 1) -> DataFrame:
    """The ``k`` largest rows; ties resolved by ``tie_break`` so that reruns agree."""
    return df.orderBy(
        F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]
    ).limit(k)


def argmax_with_ties(df: DataFrame, metric: str) -> DataFrame:
    """All rows whose ``metric`` equals the maximum.

    The maximum is a plain aggregate joined back, so no group is ever gathered in one task.
    """
    best = df.agg(F.max(metric).alias(metric))
    return df.join(F.broadcast(best), metric).select(*df.columns)
