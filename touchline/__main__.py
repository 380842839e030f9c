"""Command line: ``normalize`` a feed, then ``answer`` the questions over its tables.

Run with ``spark-submit`` on a cluster; the session's settings are taken as they are.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from touchline.plans.normalize import normalize
from touchline.plans.report import answers
from touchline.schemas import MULTILINE_TABLES
from touchline.session import clear_stage
from touchline.sources.headings import published_answers, published_tables
from touchline.sources.tables import read_feed, read_tables, write_tables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="touchline")
    parser.add_argument("job", choices=["normalize", "answer"])
    parser.add_argument("source", help="folder with the feed or the normalized tables")
    parser.add_argument("target", help="folder for the results")
    parser.add_argument("--read", default="parquet", choices=["csv", "parquet"])
    parser.add_argument("--write", default="parquet", choices=["csv", "parquet"])
    parser.add_argument("--one-line-cells", action="store_true", help="no CSV cell has a line break")
    parser.add_argument("--published", action="store_true", help="write published names")
    normalizing = parser.add_argument_group("normalize")
    normalizing.add_argument("--country", help="keep one country's leagues")
    normalizing.add_argument("--suffix", default="", help="ends published table names")
    normalizing.add_argument("--by-season", action="store_true", help="one folder per season")
    normalizing.add_argument("--member-of", default="season_exact", choices=["season_exact", "any"])
    normalizing.add_argument("--strict-goals", action="store_true", help="fail on bad documents")
    normalizing.add_argument("--unordered-ids", action="store_true", help="saves two range shuffles")
    normalizing.add_argument(
        "--squad-dictionary", nargs=2, metavar=("FOLDER", "FEED"), help="squad ids that later feeds keep"
    )
    parser.add_argument_group("answer").add_argument("--team", type=int, help="id for one team's series")
    return parser


def results(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    multiline = () if chosen.one_line_cells else MULTILINE_TABLES
    if chosen.job == "answer":
        found = answers(read_tables(spark, chosen.source, chosen.read, multiline), team=chosen.team)
        return published_answers(found) if chosen.published else found
    tables = normalize(
        read_feed(spark, chosen.source, chosen.read, multiline),
        chosen.country,
        member_of=chosen.member_of,
        strict_goals=chosen.strict_goals,
        ordered_ids=not chosen.unordered_ids,
        squad_dictionary=chosen.squad_dictionary,
    )
    return published_tables(tables, chosen.suffix) if chosen.published else tables


def main(arguments: list[str] | None = None) -> None:
    chosen = _parser().parse_args(arguments)
    if chosen.by_season and (chosen.job == "answer" or chosen.published):
        raise SystemExit("--by-season is for normalized tables under our names")
    spark = SparkSession.builder.appName(f"touchline {chosen.job}").getOrCreate()
    written = write_tables(results(spark, chosen), chosen.target, chosen.write, by_season=chosen.by_season)
    for name, counts in written.items():
        print(name, *[f"{what}={n}" for what, n in counts.items()])
    clear_stage(spark)


if __name__ == "__main__":
    main()
    SparkSession.getActiveSession().stop()
