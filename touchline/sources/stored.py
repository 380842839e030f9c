"""Stored tables that later feeds add to and correct, and ids that later feeds keep.

A table is a folder of parquet files with one folder per season. A change rewrites the seasons it
touches and no others. What they will hold is written aside first, beside the table; only when that
is complete do Spark's dynamic partition overwrite and the removal of emptied seasons take it over. A
run that dies while it writes aside has changed nothing. One that dies later is finished by the next
call, from what lies aside, so that a repeated change leaves the table as one that succeeded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.keys import contiguous_ids
from touchline.operators.updates import update_from
from touchline.session import stage

SEASON = "season_id"
_NO_SEASON = "__HIVE_DEFAULT_PARTITION__"


class Folder:
    """A folder of the file system that holds ``path``, whichever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._new(f"{self.path}/{name}"))

    def names(self) -> list[str]:
        at = self._new(self.path)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return sorted(status.getPath().getName() for status in found)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._new(f"{self.path}/{name}".rstrip("/")), True)


def _aside(path: str) -> str:
    return f"{path.rstrip('/')}.aside"


def read_stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as its last complete change left it; empty if nothing was stored."""
    finish(spark, path, schema)
    return _read(spark, path, schema)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not Folder(spark, path).names():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def finish(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Take over a change that lies complete beside the table; drop one that is not."""
    aside = Folder(spark, _aside(path))
    if aside.has("touched/_SUCCESS"):
        rows = spark.read.schema(schema).parquet(f"{aside.path}/rows").select(*schema.names)
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(SEASON)
            .parquet(path)
        )
        filled = set(Folder(spark, f"{aside.path}/rows").names())
        # One row a season.
        for r in spark.read.parquet(f"{aside.path}/touched").collect():
            name = f"{SEASON}={_NO_SEASON if r.season is None else r.season}"
            if name not in filled:
                Folder(spark, path).delete(name)
    aside.delete()


def _change(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    seasons: DataFrame,
    changed: Callable[[DataFrame], DataFrame],
) -> None:
    """Replace the rows of ``seasons`` (season) by what ``changed`` makes of them."""
    aside = _aside(path)
    old = _read(spark, path, schema)
    touched = seasons.distinct()
    # A list of literals, one per season, so that the scan opens no other folder.
    values = [r.season for r in touched.collect()]
    if not values:
        return
    listed = F.col(SEASON).isin([v for v in values if v is not None])
    if None in values:
        listed = F.coalesce(listed, F.lit(False)) | F.col(SEASON).isNull()
    rows = changed(old.where(listed)).select(*schema.names)
    rows.hint("rebalance", SEASON).write.mode("overwrite").partitionBy(SEASON).parquet(f"{aside}/rows")
    found = spark.createDataFrame([(v,) for v in values], "season int")
    found.write.mode("overwrite").parquet(f"{aside}/touched")
    finish(spark, path, schema)


def append_stored(path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Add ``rows`` to the table at ``path``; a stored row with equal ``keys`` gives way.

    Keys identify a row in the whole table; NULL equals NULL in them. A row whose season changed
    leaves its old one. ``rows`` hold each key once, have an integer ``season_id`` and all columns of the
    table; appending them again changes nothing.
    """
    spark, schema = rows.sparkSession, rows.schema
    finish(spark, path, schema)
    rows = stage(rows, "feed")
    met = _on(keys)
    old = _read(spark, path, schema)
    replaced = old.alias("old").join(rows.select(*keys).alias("new"), met, "left_semi")
    seasons = rows.select(F.col(SEASON).alias("season")).union(replaced.select(SEASON))
    _change(
        spark,
        path,
        schema,
        seasons,
        lambda kept: kept.alias("old")
        .join(rows.select(*keys).alias("new"), met, "left_anti")
        .unionByName(rows),
    )


def update_stored(
    path: str,
    schema: T.StructType,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ambiguous: str = "error",
) -> None:
    """Set ``columns`` of the stored rows from the ``source`` row with equal ``keys``, as
    :func:`touchline.operators.updates.update_from` does. ``columns`` may not hold the season."""
    if SEASON in columns:
        raise ValueError("append rows to move them to another season")
    spark = source.sparkSession
    finish(spark, path, schema)
    source = stage(source.select(*keys, *columns), "feed")
    old = _read(spark, path, schema)
    matched = old.join(source.select(*keys).distinct(), list(keys), "left_semi")
    _change(
        spark,
        path,
        schema,
        matched.select(F.col(SEASON).alias("season")),
        lambda kept: update_from(kept, source, keys, columns, ambiguous),
    )


def _on(keys: Sequence[str]):
    met = F.col(f"old.{keys[0]}").eqNullSafe(F.col(f"new.{keys[0]}"))
    for key in keys[1:]:
        met = met & F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}"))
    return met


def kept_ids(keys: DataFrame, folder: str, feed: str, id_col: str) -> DataFrame:
    """(``id_col``, keys) for every row of ``keys``, which has key columns only.

    The dictionary in ``folder`` has one folder per feed with the keys that feed brought. Keys that
    an earlier feed brought keep their id; new ones are numbered from the greatest id on, in their
    order. A feed that was numbered completely is not numbered again, and what one that
    died has left is written anew.
    """
    spark, names = keys.sparkSession, keys.columns
    schema = T.StructType([T.StructField(id_col, T.LongType()), *keys.schema.fields])
    feeds = [name for name in Folder(spark, folder).names() if Folder(spark, f"{folder}/{name}").has("_SUCCESS")]
    if f"feed={feed}" not in feeds:
        known = _feeds(spark, folder, feeds, schema)
        fresh = keys.distinct().alias("old").join(
            known.select(*names).alias("new"), _on(names), "left_anti"
        )
        last = known.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        numbered = contiguous_ids(fresh, names, id_col)
        numbered = numbered.withColumn(id_col, F.col(id_col) + F.lit(last))
        numbered.write.mode("overwrite").parquet(f"{folder}/feed={feed}")
        feeds.append(f"feed={feed}")
    known = _feeds(spark, folder, feeds, schema)
    return (
        keys.alias("old")
        .join(known.alias("new"), _on(names))
        .select(f"new.{id_col}", *[f"old.{name}" for name in names])
    )


def _feeds(spark: SparkSession, folder: str, feeds: list[str], schema: T.StructType) -> DataFrame:
    if not feeds:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{name}" for name in feeds])
