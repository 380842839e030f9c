"""Team-by-season tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.reshape import pivot_mean, pivot_strict
from touchline.operators.sides import match_sides, team_matches
from touchline.plans.questions import FIRST_SEASON, LAST_SEASON

# Fixed value: head room above the tallest bar.
AXIS_HEADROOM = 1.1
#: Season columns of a pivot at most.
MOST_SEASONS = 100


def _labelled(per_team_season: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    named = per_team_season.join(teams.selectExpr("team_id", "long_name AS team_name"), "team_id")
    return named.join(seasons.select("season_id", "season"), "season_id")


def team_season_goals(matches: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Goals for, against and mean goals for, per team and season."""
    sums = (
        team_matches(matches)
        .groupBy("team_id", "season_id")
        .agg(
            F.expr("sum(goals_for) AS goals_for"),
            F.expr("sum(goals_against) AS goals_against"),
            F.expr("avg(goals_for) AS avg_goals"),
        )
    )
    return _labelled(sums, teams, seasons).select(
        "team_id", "season_id", "goals_for", "goals_against", "avg_goals", "team_name", "season"
    )


def home_away_goals(matches: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Goals scored at home and away per team and season, NULL on a side never played."""
    sums = (
        match_sides(matches)
        .groupBy("team_id", "season_id")
        .agg(
            F.expr("sum(goals_for) FILTER (WHERE side = 'H') AS home_goals"),
            F.expr("sum(goals_for) FILTER (WHERE side = 'A') AS away_goals"),
        )
    )
    return _labelled(sums, teams, seasons).selectExpr(
        "team_id",
        "season_id",
        "home_goals",
        "away_goals",
        "home_goals - away_goals AS home_minus_away",
        "team_name",
        "season",
    )


def period_labels(
    seasons: DataFrame, first: int = FIRST_SEASON, last: int = LAST_SEASON
) -> list[str]:
    """Labels of the seasons ``first..last`` in their order; fails if they are more than a hundred."""
    rows = seasons.where(f"season_id BETWEEN {first} AND {last}").orderBy("season_id")
    labels = [r.season for r in rows.select("season").limit(MOST_SEASONS + 1).collect()]
    if len(labels) > MOST_SEASONS:
        raise ValueError(f"more than {MOST_SEASONS} seasons from {first} to {last}")
    return labels


def team_by_season_mean(
    chart: DataFrame, values: str, seasons: Sequence[str] | None = None
) -> DataFrame:
    return pivot_mean(chart, "team_name", "season", values, seasons)


def team_by_season_strict(
    chart: DataFrame, values: str, seasons: Sequence[str] | None = None
) -> DataFrame:
    return pivot_strict(chart, "team_name", "season", values, seasons)


def team_series(chart: DataFrame, team_id: int) -> DataFrame:
    """One team's seasons with the upper end of a common axis.

    The window spans the seasons of one team, at most one row per season label.
    """
    tallest = "max(greatest(goals_for, goals_against)) OVER (PARTITION BY team_id)"
    return chart.where(f"team_id = {int(team_id)}").selectExpr(
        "*", f"{tallest} * CAST({AXIS_HEADROOM} AS DOUBLE) AS axis_max"
    )
