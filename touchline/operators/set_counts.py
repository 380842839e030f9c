"""Distinct counts that merge: sets of small numbers kept as words of bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import FEW_SALTS, salted_join
from touchline.operators.keys import contiguous_ids


def member_sets(rows: DataFrame, member: str, by: Sequence[str]) -> DataFrame:
    """(by, word, bits): which members each group has met, exactly.

    Members are numbered without gaps; 64 neighbours share a word, and a group has a row for each
    word in which it has a member. Groups by season merge into any period by OR, where a distinct
    count would have to read the rows again.
    """
    known = rows.where(F.col(member).isNotNull())
    numbers = contiguous_ids(known.select(member).distinct(), [f"`{member}`"], "_number")
    numbered = salted_join(
        known.select(*by, member).distinct(), numbers, [member], spread_by=list(by), salts=FEW_SALTS
    )
    return numbered.groupBy(*by, F.expr("(_number - 1) DIV 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST((_number - 1) % 64 AS INT))")).alias("bits")
    )


def merged_counts(sets: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(by, ``name``): distinct members of the groups of :func:`member_sets` put together."""
    words = sets.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias(name))
