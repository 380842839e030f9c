"""Reading, Arrow and driver-side helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ASCII white space, as the regular expression class of every word rule here.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a NULL id has no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, NULL as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


_remembered: list = []


def remembered(make: Callable) -> Callable:
    """``make`` with its last two results kept by the worker between the tasks of one operator."""
    kept = lru_cache(maxsize=2)(make)
    _remembered.append(kept)
    return kept


def slices(column: pa.Array, size: int) -> Iterator[slice]:
    """Ranges of rows of a string column that hold ``size`` bytes or a single row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for i, length in enumerate(lengths):
        if total and total + length > size:
            yield slice(start, i)
            start, total = i, 0
        total += length
    if lengths:
        yield slice(start, len(lengths))


def map_rows(
    df: DataFrame,
    schema: str | StructType,
    work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """``work`` on every Arrow batch; Spark bounds a batch in rows and in bytes.

    A worker waits for later tasks, of other operators too: after a task it keeps no free buffers,
    and what it remembers (:func:`remembered`) goes when another operator's task begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in _remembered:
            if kept.__module__ != work.__module__:
                kept.cache_clear()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        batch = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
