"""Rows that cannot meet a table of keys go before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key; with one hash a key that is not known passes with a chance of 1 in so many.
BITS = 16
#: Keys, at most, for which the filter is built: its words are broadcast, 16 bytes for every 64
#: bits, so that it takes a few dozen megabytes then. With more keys all rows pass.
MOST_KEYS = 1 << 20


def may_be_known(df: DataFrame, keys: DataFrame, on: str, most: int = MOST_KEYS) -> DataFrame:
    """The rows of ``df`` whose ``on`` may be among ``keys[on]``, which hold each key once.

    A Bloom filter of one hash: the words of its bits are merged by OR, broadcast, and looked up in
    the scan's own stage. Every known key passes, and few others, so that a join that decides
    exactly has few rows to move. NULL never passes.
    """
    count = keys.count()
    if count > most:
        return df.where(F.col(on).isNotNull())
    size = 64 * max(1, count * BITS // 64)
    place = F.pmod(F.xxhash64(on), F.lit(size))
    word, bit = F.shiftright("_place", 6), F.expr("CAST(_place & 63 AS INT)")
    words = (
        keys.select(place.alias("_place"))
        .groupBy(word.alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")).alias("_bits"))
    )
    hashed = df.where(F.col(on).isNotNull()).withColumn("_place", place).withColumn("_word", word)
    met = hashed.join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1)
    return met.select(*df.columns)
