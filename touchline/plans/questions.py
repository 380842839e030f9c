"""Tally questions over matches and goals.

``matches`` here means the rows of :func:`season_matches`. Team counts and sums are taken per
team id before names are joined, so a team with most of the matches shrinks to one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.seasons import label_year
from touchline.operators.joins import FEW_SALTS, salted_join
from touchline.operators.ranking import top_k
from touchline.operators.sides import match_sides, outcome_rows, team_matches

# The season ids and starting years the questions are about.
FIRST_SEASON, LAST_SEASON = 2, 5
YEARS = [2008, 2009, 2010, 2011]

_MATCH_COLUMNS = [
    "match_id",
    "season_id",
    "home_goals",
    "away_goals",
    "home_team_id",
    "away_team_id",
]


def season_matches(
    matches: DataFrame,
    seasons: DataFrame | None = None,
    fixtures: DataFrame | None = None,
    first: int = FIRST_SEASON,
    last: int = LAST_SEASON,
) -> DataFrame:
    """Score and teams of the matches in seasons ``first..last``.

    Leave ``seasons`` out when the season ids of ``matches`` come from that dimension, and
    ``fixtures`` when ``matches`` still carries the team ids: the latter saves a join of two
    tables as long as each other.
    """
    period = f"season_id BETWEEN {first} AND {last}"
    inside = matches.where(period)
    if seasons is not None:
        inside = inside.join(seasons.where(period).select("season_id"), "season_id")
    if fixtures is not None:
        inside = inside.join(fixtures, "match_id")
    return inside.select(*_MATCH_COLUMNS)


def _by_name(per_team: DataFrame, teams: DataFrame, value: str) -> DataFrame:
    named = per_team.join(teams.select("team_id", "long_name"), "team_id")
    return named.groupBy("long_name").agg(F.expr(f"sum({value}) AS {value}"))


def most_wins(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Team name with most matches won."""
    wins = outcome_rows(matches, "win").groupBy("team_id").agg(F.expr("count(match_id) AS wins"))
    return top_k(_by_name(wins, teams, "wins"), "wins", ["long_name"]).select("wins", "long_name")


def most_outcomes_by_year(
    matches: DataFrame,
    seasons: DataFrame,
    teams: DataFrame,
    outcome: str,
    years: Sequence[int] = tuple(YEARS),
) -> DataFrame:
    """Team names with most wins, losses or draws in each of ``years``, ties included.

    A name is listed when its count equals the best count of any single team id, also of an id
    that has no row in ``teams``; then a year may come out empty.
    """
    rows = outcome_rows(matches, outcome)
    per_team = (
        rows.groupBy("season_id", "team_id")
        .agg(F.expr("count(match_id) AS n"))
        .join(seasons, "season_id")
        .selectExpr("*", f"{label_year('season')} AS year")
        .where(f"year IN ({', '.join(str(int(y)) for y in years)})")
    )
    # One row per year of the list, hence the broadcast.
    best = (
        per_team.groupBy("year", "team_id")
        .agg(F.expr("sum(n) AS n"))
        .groupBy("year")
        .agg(F.expr("max(n) AS n"))
    )
    named = (
        per_team.join(teams.select("team_id", "long_name"), "team_id")
        .groupBy("year", "long_name")
        .agg(F.expr("sum(n) AS n"), F.expr("min(season) AS season"))
    )
    return named.join(F.broadcast(best), ["year", "n"]).select("n", "long_name", "season")


def most_losses_by_season(
    matches: DataFrame, seasons: DataFrame, teams: DataFrame, years: Sequence[int] = tuple(YEARS)
) -> DataFrame:
    found = most_outcomes_by_year(matches, seasons, teams, "loss", years)
    return found.withColumnRenamed("n", "losses")


def most_draws_in(
    matches: DataFrame, seasons: DataFrame, teams: DataFrame, year: int = YEARS[-1]
) -> DataFrame:
    found = most_outcomes_by_year(matches, seasons, teams, "draw", [year])
    return found.selectExpr("n AS draws", "long_name")


def team_goals(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Goals for and against per team over all the matches."""
    sums = (
        team_matches(matches)
        .groupBy("team_id")
        .agg(
            F.expr("sum(goals_for) AS goals_for"),
            F.expr("sum(goals_against) AS goals_against"),
        )
    )
    return sums.join(teams.select("team_id", "long_name"), "team_id").select(
        "team_id", "long_name", "goals_for", "goals_against"
    )


def most_goals_for(matches: DataFrame, teams: DataFrame) -> DataFrame:
    best = top_k(team_goals(matches, teams), "goals_for", ["team_id"])
    return best.select("long_name", "goals_for")


def best_goal_difference(matches: DataFrame, teams: DataFrame) -> DataFrame:
    difference = team_goals(matches, teams).selectExpr(
        "team_id", "long_name", "goals_for - goals_against AS goal_difference"
    )
    return top_k(difference, "goal_difference", ["team_id"]).select("long_name", "goal_difference")


def top_scorer(
    goals: DataFrame, squad_members: DataFrame, matches: DataFrame, players: DataFrame
) -> DataFrame:
    """Player with most goals in the matches.

    Goals are folded per match and member before the joins, so neither a match nor a scorer
    with most of the goals travels as rows.
    """
    folded = goals.groupBy("match_id", "member_id").agg(F.expr("count(goal_id) AS goals"))
    per_member = (
        salted_join(folded, matches.select("match_id"), ["match_id"], salts=FEW_SALTS)
        .groupBy("member_id")
        .agg(F.expr("sum(goals) AS goals"))
    )
    per_player = (
        per_member.join(squad_members.select("member_id", "player_id"), "member_id")
        .groupBy("player_id")
        .agg(F.expr("sum(goals) AS goals"))
    )
    best = top_k(per_player, "goals", ["player_id"])
    return players.select("player_id", "player_name").join(
        F.broadcast(best), "player_id"
    ).select("goals", "player_name")


def goals_per_team_name(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Home plus away goals per team name; a team facing itself counts for both sides."""
    sums = match_sides(matches).groupBy("team_id").agg(F.expr("sum(goals_for) AS goals"))
    return _by_name(sums, teams, "goals")


def top_scoring_team(matches: DataFrame, teams: DataFrame) -> DataFrame:
    return top_k(goals_per_team_name(matches, teams), "goals", ["long_name"]).select(
        "goals", "long_name"
    )
