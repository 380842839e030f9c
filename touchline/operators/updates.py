"""Update a table from another one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import FEW_SALTS, quoted, salted_join


def update_from(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ambiguous: str = "error",
) -> DataFrame:
    """Set ``columns`` of ``target`` from the ``source`` row with equal ``keys``.

    Target rows without a match keep their values; a matched NULL overwrites. When source rows
    disagree for a key, ``ambiguous`` decides: ``"error"`` fails the job if such a key is
    used, ``"min"`` takes the smallest candidate row. Source copies are folded before the join.
    """
    values = F.struct(*columns)
    folded = source.groupBy(*keys).agg(F.min(values).alias("_low"), F.max(values).alias("_high"))
    if ambiguous == "error":
        clash = f"concat('ambiguous update for key ', to_json(struct({', '.join(quoted(keys))})))"
        new = f"if(_low <=> _high, _low, raise_error({clash}))"
    elif ambiguous == "min":
        new = "_low"
    else:
        raise ValueError(f"unknown rule for ambiguous keys: {ambiguous}")
    joined = salted_join(target, folded, keys, "left", salts=FEW_SALTS).selectExpr(
        *quoted(target.columns), f"CASE WHEN _low IS NOT NULL THEN {new} END AS _new"
    )
    return joined.selectExpr(
        *[
            f"if(_new IS NULL, `{c}`, _new.`{c}`) AS `{c}`" if c in columns else f"`{c}`"
            for c in target.columns
        ]
    )
