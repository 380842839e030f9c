"""Reading and writing the feed and the normalized tables."""

from __future__ import annotations

import os
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.checks import assert_unique
from touchline.schemas import CHARTS, MULTILINE_TABLES, NORMALIZED, RAW
from touchline.session import stage
from touchline.sources.headings import RESULTS

# Quotes inside a quoted cell are doubled and outer blanks kept, on both ways.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Bounds the size of a file, and with it the work of a task that has to read it unsplit.
ROWS_PER_FILE = 1_000_000

# Tables joined on one long key; equal bucketing makes those joins local. Only tables in which
# the key is unique and never NULL, so that no bucket can outgrow the others: squad rows without
# a season have no member id.
BUCKET_KEYS = {
    "matches": "match_id",
    "fixtures": "match_id",
    "lineups": "match_id",
    "players": "player_id",
}

# Long tables that the questions filter by season.
SEASON_TABLES = {"matches", "player_attributes"}


def _typed(name: str, kind: T.DataType) -> str:
    """Cell text to its type. Whole numbers may come as ``7.0``, as tools write columns with gaps."""
    if isinstance(kind, T.StringType):
        return f"`{name}`"
    text = f"`{name}`"
    if isinstance(kind, (T.LongType, T.IntegerType)):
        text = f"if(endswith({text}, '.0'), left({text}, length({text}) - 2), {text})"
    return f"CAST({text} AS {kind.simpleString()}) AS `{name}`"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """CSV with a header line. Columns are found by name and typed by ``schema``.

    Columns the schema does not know stay as text; a missing one is an error, and a cell or row
    that does not fit fails the read. ``multiline`` is for text cells with line breaks. Such files
    cannot be split, so ask for it only where needed and keep those files small
    (:func:`write_csv` does). An empty cell is NULL, quoted or not.
    """
    reader = spark.read.options(**_CSV).option("multiLine", str(multiline).lower())
    names = reader.csv(path).columns
    missing = [name for name in schema.names if name not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = reader.schema(text).option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    kinds = {field.name: field.dataType for field in schema}
    extra = [name for name in names if name not in kinds]
    return rows.selectExpr(
        *[_typed(name, kinds[name]) for name in schema.names], *[f"`{name}`" for name in extra]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .options(**_CSV)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .csv(path)
    )


def _read_folder(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType],
    fmt: str,
    multiline: Collection[str],
) -> dict[str, DataFrame]:
    def load(name: str, schema: T.StructType) -> DataFrame:
        path = os.path.join(folder, f"{name}.{fmt}")
        if fmt == "csv":
            return stage(read_csv(spark, path, schema, multiline=name in multiline), name)
        return spark.read.schema(schema).parquet(path).select(*schema.names)

    return {name: load(name, schema) for name, schema in schemas.items()}


def read_feed(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    multiline: Collection[str] = MULTILINE_TABLES,
) -> dict[str, DataFrame]:
    """The six raw tables, one file or folder each, named as in ``schemas.RAW``.

    Further columns of CSV files pass through as text. CSV is parsed once and staged as parquet,
    because every table built from the feed reads some of its columns again.

    ``multiline`` names the CSV tables whose cells hold line breaks. Their files can't be split, so
    a long one has to come as a folder of many files; a feed without line breaks passes ``()``.
    """
    return _read_folder(spark, folder, RAW, fmt, multiline)


def read_tables(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    multiline: Collection[str] = MULTILINE_TABLES,
) -> dict[str, DataFrame]:
    """The normalized tables written by :func:`write_tables`; ``multiline`` as in the feed."""
    return _read_folder(spark, folder, NORMALIZED, fmt, multiline)


def read_chart(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A published chart table, from CSV, under our column names."""
    rows = read_csv(spark, path, CHARTS[name])
    return rows.selectExpr(*[f"`{theirs}` AS `{ours}`" for ours, theirs in RESULTS[name].items()])


def write_tables(
    tables: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    by_season: bool = False,
) -> dict[str, dict[str, int]]:
    """One folder per table, written in parallel part files; returns counts of what was written.

    Counted while it is written: ``rows`` and, of tables with a season id, those ``without_season``.

    ``by_season`` lays the long parquet tables out in one folder per season id, so that a question
    about some seasons opens no other file. Rows are rebalanced for that: adaptive execution cuts a
    large season into several tasks and files.
    """
    watched = {}
    for name, table in tables.items():
        df, watched[name] = _observed(name, table)
        path = os.path.join(folder, f"{name}.{fmt}")
        if fmt == "csv":
            write_csv(df, path, mode)
        elif fmt != "parquet":
            raise ValueError(f"unknown format: {fmt}")
        elif by_season and name in SEASON_TABLES:
            rows = df.hint("rebalance", "season_id")
            rows.write.mode(mode).partitionBy("season_id").parquet(path)
        else:
            df.write.mode(mode).parquet(path)
    return {name: {k: int(v or 0) for k, v in seen.get.items()} for name, seen in watched.items()}


def _observed(name: str, df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if "season_id" in df.columns:
        counts.append(F.count_if(F.col("season_id").isNull()).alias("without_season"))
    return df.observe(seen, *counts), seen


def save_bucketed(
    tables: Mapping[str, DataFrame], database: str, buckets: int, mode: str = "overwrite"
) -> None:
    """Save the tables to the catalog, the long ones bucketed and sorted by their join key.

    Rows are shuffled to their bucket first, so that each task writes few files. A bucketed key
    that repeats is an error; the check reads the key column bucket by bucket, without a shuffle.
    """
    for name, df in tables.items():
        key = BUCKET_KEYS.get(name)
        if key is None:
            df.write.mode(mode).saveAsTable(f"{database}.{name}")
            continue
        (
            df.repartition(buckets, key)
            .write.mode(mode)
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(f"{database}.{name}")
        )
        assert_unique(df.sparkSession.table(f"{database}.{name}"), [key])


def register_views(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Make the tables available to ``spark.sql`` by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def describe_tables(spark: SparkSession) -> dict[str, list[tuple[str, str]]]:
    """Column names and types of every registered table or view."""
    return {
        table.name: spark.table(table.name).dtypes for table in spark.catalog.listTables()
    }
