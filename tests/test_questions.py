from __future__ import annotations

import pytest

from touchline.plans import charts as C
from touchline.plans import questions as Q
from touchline.plans import ratings as R
from touchline.plans import rosters as S

MATCH = (
    "match_id int, season_id int, home_team_id bigint, away_team_id bigint, "
    "home_goals int, away_goals int"
)


@pytest.fixture(scope="module")
def seasons(spark):
    labels = [(i, f"{2006 + i}/{2007 + i}") for i in range(1, 7)]
    return spark.createDataFrame(labels, "season_id int, season string")


@pytest.fixture(scope="module")
def teams(spark):
    # Two ids share a name; team 9 has no row.
    return spark.createDataFrame(
        [(1, "Alfa", "A"), (2, "Beta", "B"), (3, "Beta", "C"), (4, "Delta", "D")],
        "team_id bigint, long_name string, short_name string",
    )


def matches(spark, *rows):
    return spark.createDataFrame(list(rows), MATCH)


def test_season_matches_bounds_and_joins(spark, seasons, rows):
    table = spark.createDataFrame(
        [(1, 1, 0, 0), (2, 2, 0, 0), (3, 5, 0, 0), (4, 6, 0, 0), (5, None, 0, 0)],
        "match_id int, season_id int, home_goals int, away_goals int",
    )
    fixtures = table.selectExpr("match_id", "1L AS home_team_id", "2L AS away_team_id")
    assert rows(Q.season_matches(table, seasons, fixtures), "match_id") == [(2,), (3,)]
    wide = table.join(fixtures, "match_id")
    assert rows(Q.season_matches(wide), "match_id") == [(2,), (3,)]


def test_most_wins_counts_by_name(spark, teams, rows):
    played = matches(
        spark,
        (1, 2, 1, 4, 1, 0),
        (2, 2, 1, 4, 1, 0),
        (3, 2, 2, 4, 1, 0),
        (4, 2, 4, 3, 0, 1),
        (5, 2, 3, 4, 1, 0),
        (6, 2, 1, 4, None, 0),
    )
    assert rows(Q.most_wins(played, teams)) == [(3, "Beta")]


def test_most_losses_compares_names_with_the_best_single_id(spark, seasons, teams, rows):
    # 2008: ids 1 and 4 tie with two losses each, Beta has 1 + 1 over two ids.
    played = matches(
        spark,
        (1, 2, 1, 9, 0, 1),
        (2, 2, 1, 9, 0, 1),
        (3, 2, 4, 9, 0, 1),
        (4, 2, 4, 9, 0, 1),
        (5, 2, 2, 9, 0, 1),
        (6, 2, 3, 9, 0, 1),
        # 2009: the id with most losses has no team row, and no name reaches its count.
        (7, 3, 9, 1, 0, 1),
        (8, 3, 9, 1, 0, 1),
        (9, 3, 1, 4, 0, 1),
        # 2010: Beta's ids add up to more than any single id, so no name equals the best.
        (10, 4, 2, 1, 0, 1),
        (11, 4, 3, 1, 0, 1),
        # Season 6 is no year of the list.
        (12, 6, 1, 4, 0, 1),
    )
    found = rows(Q.most_losses_by_season(played, seasons, teams))
    assert found == [(2, "Alfa", "2008/2009"), (2, "Beta", "2008/2009"), (2, "Delta", "2008/2009")]


def test_most_draws_in_the_last_year(spark, seasons, teams, rows):
    played = matches(
        spark, (1, 5, 1, 4, 1, 1), (2, 5, 4, 2, 0, 0), (3, 4, 1, 2, 2, 2), (4, 5, 1, 2, 1, 0)
    )
    assert rows(Q.most_draws_in(played, seasons, teams)) == [(2, "Delta")]


def test_goals_of_a_team_facing_itself(spark, teams, rows):
    played = matches(spark, (1, 2, 1, 1, 3, 1), (2, 2, 1, 4, 2, 5), (3, 2, 4, 1, None, 7))
    assert rows(Q.team_goals(played, teams)) == [(1, "Alfa", 12, 6), (4, "Delta", 5, 9)]
    # The union of both sides counts the odd match twice.
    assert rows(Q.goals_per_team_name(played, teams)) == [("Alfa", 13), ("Delta", 5)]
    assert rows(Q.top_scoring_team(played, teams)) == [(13, "Alfa")]
    assert rows(Q.most_goals_for(played, teams)) == [("Alfa", 12)]
    assert rows(Q.best_goal_difference(played, teams)) == [("Alfa", 6)]


def test_top_scorer(spark, rows):
    goals = spark.createDataFrame(
        [(1, 1, 11), (2, 1, 12), (3, 2, 13), (4, 2, 13), (5, 9, 13), (6, 9, 13)],
        "goal_id int, match_id int, member_id int",
    )
    # Members 11 and 12 are one player in two seasons; match 9 is outside the period.
    members = spark.createDataFrame(
        [(11, 1, 100), (12, 1, 100), (13, 1, 200)], "member_id int, team_id int, player_id int"
    )
    players = spark.createDataFrame([(100, "X"), (200, "Y")], "player_id int, player_name string")
    played = matches(spark, (1, 2, 1, 4, 0, 0), (2, 2, 1, 4, 0, 0))
    assert rows(Q.top_scorer(goals, members, played, players)) == [(2, "X")]


ROSTER = "player_id int, team_id bigint, season_id int"


def test_team_wins_of_a_player(spark, rows):
    roster = spark.createDataFrame(
        [(100, 1, 2), (100, 4, 3), (200, 1, 2), (200, 1, 3), (300, 4, 2)], ROSTER
    )
    players = spark.createDataFrame(
        [(100, "X"), (200, "Y"), (300, "Z")], "player_id int, player_name string"
    )
    played = matches(
        spark, (1, 2, 1, 4, 1, 0), (2, 2, 4, 1, 0, 2), (3, 3, 4, 1, 1, 0), (4, 3, 1, 1, 0, 3)
    )
    assert rows(S.player_team_wins(roster, played, players)) == [(100, "X", 3), (200, "Y", 3)]
    assert rows(S.most_team_wins(roster, played, players)) == [(100, "X", 3), (200, "Y", 3)]


def test_most_clubs(spark, rows):
    members = spark.createDataFrame(
        [(1, 1, 100), (2, 1, 100), (3, 2, 100), (4, 1, 200), (5, 2, 200), (6, 1, 300)],
        "member_id int, team_id int, player_id int",
    )
    players = spark.createDataFrame(
        [(100, "X"), (200, "Y"), (300, "Z")], "player_id int, player_name string"
    )
    assert rows(S.most_clubs(members, players)) == [(100, "X", 2), (200, "Y", 2)]


def test_squad_size_needs_a_measurement_and_a_match_in_the_period(spark, teams, rows):
    members = spark.createDataFrame(
        [(1, 1, 100), (2, 1, 100), (3, 1, 200), (4, 1, 300), (5, 2, 100)],
        "member_id int, team_id bigint, player_id int",
    )
    measured = spark.createDataFrame(
        [(100, 2), (100, 3), (200, 5), (300, 1)], "player_id int, season_id int"
    )
    played = matches(spark, (1, 2, 1, 4, 0, 0))
    assert rows(S.squad_size(members, measured, played, teams)) == [(1, "Alfa", 2)]


def test_stable_players(spark, rows):
    measured = spark.createDataFrame(
        [(1, 2, 7), (1, 3, 7), (2, 2, 7), (2, 3, 8), (3, 2, 9), (4, 2, 5), (4, 6, 9), (4, 3, 5)],
        "player_id int, season_id int, potential int",
    )
    players = spark.createDataFrame(
        [(i, f"P{i}") for i in range(1, 5)], "player_id int, player_name string"
    )
    # 3 was measured once only, 4 moved outside the period.
    assert rows(R.stable_players(measured, players)) == [(1, "P1"), (4, "P4")]


def test_chart_tables(spark, seasons, teams, rows):
    played = matches(
        spark, (1, 2, 1, 4, 1, 3), (2, 2, 4, 1, 0, 2), (3, 3, 1, 4, 5, 0), (4, 2, 1, 4, None, 2)
    )
    chart = C.team_season_goals(played, teams, seasons)
    assert rows(chart, "team_id", "season_id", "goals_for", "goals_against", "avg_goals") == [
        (1, 2, 3, 5, 1.5),
        (1, 3, 5, 0, 5.0),
        (4, 2, 5, 3, 5 / 3),
        (4, 3, 0, 5, 0.0),
    ]
    sides = C.home_away_goals(played, teams, seasons)
    assert rows(sides, "team_id", "season_id", "home_goals", "away_goals", "home_minus_away") == [
        (1, 2, 1, 2, -1),
        (1, 3, 5, None, None),
        (4, 2, 0, 5, -5),
        (4, 3, None, 0, None),
    ]
    labels = ["2008/2009", "2009/2010"]
    wide = C.team_by_season_mean(chart, "goals_for", labels)
    assert rows(wide) == [("Alfa", 3.0, 5.0), ("Delta", 5.0, 0.0)]
    strict = C.team_by_season_strict(sides, "home_goals", labels)
    assert rows(strict) == [("Alfa", 1, 5), ("Delta", 0, None)]
    series = C.team_series(chart, 1)
    assert rows(series, "season", "axis_max") == [
        ("2008/2009", pytest.approx(5.5)),
        ("2009/2010", pytest.approx(5.5)),
    ]
