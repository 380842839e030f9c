"""Questions about squads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import keep_known, salted_join
from touchline.operators.ranking import argmax_with_ties
from touchline.operators.set_counts import member_sets, merged_counts
from touchline.operators.sides import match_sides, outcome_rows
from touchline.plans.questions import FIRST_SEASON, LAST_SEASON


def roster(squad_members: DataFrame, squad_seasons: DataFrame) -> DataFrame:
    """Who was in which team in which season."""
    return squad_members.join(squad_seasons, "member_id")


def rated(
    attributes: DataFrame, first: int = FIRST_SEASON, last: int = LAST_SEASON
) -> DataFrame:
    """Measurements taken in seasons ``first..last``."""
    return attributes.where(f"season_id BETWEEN {first} AND {last}")


def squad_size(
    squad_members: DataFrame, attributes: DataFrame, matches: DataFrame, teams: DataFrame
) -> DataFrame:
    """Distinct players of each team, from any season, that were measured in the period.

    Only teams with a match in ``matches`` are listed.
    """
    pairs = squad_members.select("team_id", "player_id").distinct()
    counted = (
        keep_known(pairs, rated(attributes), "player_id", "player_id")
        .groupBy("team_id")
        .agg(F.expr("count(*) AS n_players"))
    )
    playing = keep_known(counted, match_sides(matches), "team_id", "team_id")
    return playing.join(teams.select("team_id", "long_name"), "team_id").select(
        "team_id", "long_name", "n_players"
    )


def player_team_wins(roster_rows: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """Wins of a player's teams in the seasons the player belonged to them, played or not."""
    wins = (
        outcome_rows(matches, "win")
        .groupBy("team_id", "season_id")
        .agg(F.expr("count(match_id) AS wins"))
    )
    member_of = roster_rows.select("player_id", "team_id", "season_id")
    per_player = (
        salted_join(member_of, wins, ["team_id", "season_id"])
        .groupBy("player_id")
        .agg(F.expr("sum(wins) AS wins"))
    )
    return players.select("player_id", "player_name").join(per_player, "player_id")


def most_team_wins(roster_rows: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    return argmax_with_ties(player_team_wins(roster_rows, matches, players), "wins")


def clubs_per_player(squad_members: DataFrame, players: DataFrame) -> DataFrame:
    """Different teams per player over all seasons."""
    counts = squad_members.groupBy("player_id").agg(
        F.expr("count(DISTINCT team_id) AS n_teams")
    )
    return players.select("player_id", "player_name").join(counts, "player_id")


def club_sets(roster_rows: DataFrame) -> DataFrame:
    """The teams of each player and season (player_id, season_id, word, bits), which merge."""
    return member_sets(roster_rows, "team_id", ["player_id", "season_id"])


def clubs_in_period(sets: DataFrame, players: DataFrame, first: int, last: int) -> DataFrame:
    """:func:`clubs_per_player` of the seasons ``first`` to ``last``, merged from :func:`club_sets`."""
    inside = sets.where(F.col("season_id").between(first, last))
    counts = merged_counts(inside, ["player_id"], "n_teams")
    return players.select("player_id", "player_name").join(counts, "player_id")


def most_clubs(squad_members: DataFrame, players: DataFrame) -> DataFrame:
    return argmax_with_ties(clubs_per_player(squad_members, players), "n_teams")
