"""Ranks of all suffixes of many strings by the difference cover of three, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import stage

_PLACE = ["d", "r", "i"]


def counts_below(
    rows: DataFrame, keys: list[str], classes: list[str], scratch: list[DataFrame]
) -> DataFrame:
    """For each distinct ``keys``: how many rows of each class column have smaller ones.

    Equal keys are folded first, so a key with many rows is one row. The range partitions are
    summed, and one offset per partition makes running sums within them global.
    """
    folded = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in classes))
    dealt = folded.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    scratch.append(dealt)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*(F.sum(c).alias(c) for c in classes))
    offsets = totals.select(
        "part", *(F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"{c}_all") for c in classes)
    )  # one row per range partition
    within = (
        Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    )
    running = dealt.select(
        "part", *keys, *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in classes)
    )
    return running.join(F.broadcast(offsets), "part").select(
        *keys, *((F.col(c) + F.col(f"{c}_all")).alias(f"below_{c}") for c in classes)
    )


def _following(column: str, steps: int) -> list:
    """The next symbols or ranks along a string; nothing follows its end."""
    along = Window.partitionBy("d", "r").orderBy("i")
    return [
        F.coalesce(F.lead(column, k).over(along), F.lit(-1)).alias(f"{column}{k}")
        for k in range(1, steps + 1)
    ]


def suffix_ranks(strings: DataFrame, levels: int, scratch: list[DataFrame]) -> DataFrame:
    """(d, r, i, rank) for ``strings`` (d, r, i, sym): string (d, r) has ``sym`` >= 0 at place i.

    The rank is the number of smaller suffixes, so equal ones tie. Suffixes are compared over
    their first ``3 ** levels`` symbols at least; beyond that they may tie. Tables that the result reads
    are added to ``scratch``, for the caller to delete.

    The suffixes at places 1 and 2 modulo 3 are the sample. Their triples of symbols are sorted
    and named by rank; the names make two shorter strings, whose suffixes are ranked the same way.
    The others are then merged in by a symbol and the rank of the sample suffix that follows.
    """
    triples = stage(strings.select(*_PLACE, "sym", *_following("sym", 2)), "triples")
    scratch.append(triples)
    return ranks_of(triples, levels, scratch)


def ranks_of(triples: DataFrame, levels: int, scratch: list[DataFrame]) -> DataFrame:
    """:func:`suffix_ranks` of strings that bring the two symbols along that follow each one."""
    key = ["sym", "sym1", "sym2"]
    if levels <= 1:
        names = counts_below(triples.withColumn("n", F.lit(1)), key, ["n"], scratch)
        return triples.join(names, key).select(*_PLACE, F.col("below_n").alias("rank"))
    sample = triples.where("i % 3 <> 0")
    names = counts_below(sample.withColumn("n", F.lit(1)), key, ["n"], scratch)
    named = sample.join(names, key).select(
        "d",
        F.expr("2 * r + i % 3 - 1").alias("r"),
        F.expr("CAST(i DIV 3 AS INT)").alias("i"),
        F.col("below_n").alias("sym"),
    )
    named = stage(named, "names")
    scratch.append(named)
    ranked = suffix_ranks(named, levels - 1, scratch).select(
        "d",
        F.expr("r DIV 2").alias("r"),
        F.expr("CAST(3 * i + r % 2 + 1 AS INT)").alias("i"),
        "rank",
    )
    whole = triples.join(ranked, _PLACE, "left")
    whole = whole.select(*_PLACE, "sym", "sym1", "rank", *_following("rank", 2))
    whole = stage(
        whole.withColumns({f"n{k}": F.expr(f"if(i % 3 = {k}, 1, 0)") for k in range(3)}), "merge"
    )
    scratch.append(whole)
    # The rest against the sample at 1 modulo 3 by one symbol, at 2 modulo 3 by two.
    one = counts_below(whole.where("n2 = 0"), ["sym", "rank1"], ["n0", "n1"], scratch)
    two = counts_below(whole.where("n1 = 0"), ["sym", "sym1", "rank2"], ["n0", "n2"], scratch)
    rest = (
        whole.where("n0 = 1")
        .join(one, ["sym", "rank1"])
        .join(two.drop("below_n0"), ["sym", "sym1", "rank2"])
        .select(*_PLACE, F.expr("below_n0 + below_n1 + below_n2").alias("rank"))
    )
    first = whole.where("n1 = 1").join(one, ["sym", "rank1"])
    second = whole.where("n2 = 1").join(two, ["sym", "sym1", "rank2"])
    sampled = (
        side.select(*_PLACE, (F.col("rank") + F.col("below_n0")).alias("rank"))
        for side in (first, second)
    )
    return rest.union(next(sampled)).union(next(sampled))
