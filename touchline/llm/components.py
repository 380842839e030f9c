"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stage, unstage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(least, "a")
    return (
        joined.where("b <> low")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .union(least.select("a", F.col("low").alias("b")))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long); the root is the smallest node reached.

    Every round is written to the shared folder, so lost executors cost one round at most. A hub
    is folded by partial aggregation and joined, never gathered into one row. The loop ends when
    a round leaves the links as they were; that takes logarithmically many rounds.
    """
    links = links.where("a <> b").select("a", "b")
    links = stage(_small_star(_large_star(links)), "stars")
    state = _state(links)
    while state[0]:
        used, links = links, stage(_small_star(_large_star(links)), "stars")
        unstage(used)
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
