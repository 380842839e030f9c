"""Join shapes that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Powers of two. The first suits a dimension far shorter than the facts. The second is for a
# side that was just aggregated on the join key: it gives that side a shuffle of its own, which
# adaptive execution needs before it can split a hot key as far as necessary.
SALTS = 16
FEW_SALTS = 2


def quoted(columns: Sequence[str]) -> list[str]:
    """Column names safe to use inside SQL expressions."""
    return [f"`{c}`" for c in columns]


def _repeated(dim: DataFrame, salts: int, short: bool) -> DataFrame:
    """``dim`` once per salt, which is the column ``_salt``.

    Unpivoted, because the planner then counts every row. What ``explode`` makes it takes for no
    more than it was made of, and would gather up to ``salts`` times the broadcast threshold on the
    driver; a few salts, or a ``short`` table, may.
    """
    if short or salts <= FEW_SALTS:
        return dim.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS _salt")
    values = {f"_salt_{salt}": F.lit(salt) for salt in range(salts)}
    wide = dim.withColumns(values)
    return wide.unpivot(quoted(dim.columns), list(values), "_name", "_salt").drop("_name")


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    salts: int = SALTS,
    distinct: bool = False,
    short: bool = False,
) -> DataFrame:
    """Equi-join a long fact table to a much shorter table, spreading every key over ``salts`` tasks.

    The salt of a fact row is a hash of ``spread_by`` (all other columns by default), so a
    retried task sends the row to the same place. ``dim`` is repeated once per salt. When all its
    repeats are under the broadcast threshold the planner still broadcasts them; of a table said to
    be ``short``, such as teams, it does not count the repeats. ``distinct`` drops
    repeated rows after the join without another shuffle: equal rows share key and salt, provided
    that ``dim`` has a key once and adds no columns. A fact of key columns only has nothing to
    spread by and is refused; join it plainly.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join: dim rows are repeated")
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    spread = ", ".join(quoted(spread_by or [c for c in fact.columns if c not in on]))
    if not spread:
        raise ValueError("nothing to spread the rows by: the fact has key columns only")
    salted = fact.selectExpr("*", f"CAST(xxhash64({spread}) & {salts - 1} AS INT) AS _salt")
    joined = salted.join(_repeated(dim, salts, short), [*on, "_salt"], how)
    return (joined.distinct() if distinct else joined).drop("_salt")


def keep_known(
    df: DataFrame, keys: DataFrame, on: str, key: str, distinct: bool = False
) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in ``keys[key]`` (EXISTS), each once if ``distinct``.

    Key values are made unique before they travel, so copies on that side cost nothing. An inner
    join, because a semi join would be moved below a DISTINCT of ``df`` and meet its copies.
    """
    unique = keys.selectExpr(f"{key} AS {on}").distinct()
    # Adaptive execution splits a hot key of a join, but not where DISTINCT needs the rows of a key
    # together; there the salts alone have to spread it.
    salts = SALTS if distinct else FEW_SALTS
    known = salted_join(df, unique, [on], salts=salts, distinct=distinct)
    return known.select(*df.columns)
