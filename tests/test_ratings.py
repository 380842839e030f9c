"""The factored forms against the joins they stand for, on small random leagues."""

from __future__ import annotations

import random

import pytest

from touchline.plans import ratings as R
from touchline.plans.charts import home_away_goals, team_season_goals

METRICS = ["overall_rating", "potential"]


def league(spark, seed: int):
    rnd = random.Random(seed)
    teams = [(t, f"Team {t % 4}") for t in range(1, 6)]  # teams 1 and 5 share a name
    members = [
        (i, rnd.randint(1, 6), 100 if rnd.random() < 0.4 else rnd.randint(100, 112), rnd.randint(1, 6))
        for i in range(40)
    ]
    attributes = [
        (
            100 if rnd.random() < 0.4 else rnd.randint(100, 115),
            rnd.choice([None, 1, 2, 3, 4, 5, 6]),
            rnd.choice([None, *range(40, 60)]),
            rnd.randint(1, 9),
        )
        for _ in range(60)
    ]
    played = [
        (
            i,
            rnd.randint(2, 5),
            rnd.randint(1, 5),
            rnd.randint(1, 5),
            rnd.choice([None, 0, 1, 2, 3]),
            rnd.choice([None, 0, 1, 2, 3]),
        )
        for i in range(30)
    ]
    frames = {
        "teams": spark.createDataFrame(teams, "team_id bigint, long_name string"),
        "roster": spark.createDataFrame(
            members, "member_id int, team_id bigint, player_id int, season_id int"
        ),
        "attributes": spark.createDataFrame(
            attributes, "player_id int, season_id int, overall_rating int, potential int"
        ),
        "played": spark.createDataFrame(
            played,
            "match_id int, season_id int, home_team_id bigint, away_team_id bigint, "
            "home_goals int, away_goals int",
        ),
        "seasons": spark.createDataFrame(
            [(i, f"{2006 + i}/{2007 + i}") for i in range(1, 7)], "season_id int, season string"
        ),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return frames


SEEDS = [1, 2, 3]


@pytest.mark.parametrize("seed", SEEDS)
def test_rating_vs_goals_equals_the_fan_out(spark, rows, seed):
    f = league(spark, seed)
    found = R.rating_vs_goals(f["roster"], f["attributes"], f["played"], f["teams"])
    literal = spark.sql(
        """
        SELECT t.team_id, t.long_name, sum(a.overall_rating) AS total_rating,
               sum(CASE WHEN p.home_team_id = t.team_id THEN p.home_goals
                        WHEN p.away_team_id = t.team_id THEN p.away_goals ELSE 0 END) AS total_goals
        FROM teams t JOIN roster r ON r.team_id = t.team_id
        JOIN attributes a ON a.player_id = r.player_id
        JOIN played p ON t.team_id = p.home_team_id OR t.team_id = p.away_team_id
        WHERE a.season_id BETWEEN 2 AND 5 GROUP BY t.team_id, t.long_name
        """
    )
    assert rows(found.drop("bubble_size")) == rows(literal)
    assert all(r["bubble_size"] == float(r["total_goals"]) / 100 for r in found.collect())


@pytest.mark.parametrize("seed", SEEDS)
def test_metric_totals_equal_the_season_join(spark, rows, seed):
    f = league(spark, seed)
    joined = """
        FROM (SELECT player_id, season_id, sum(overall_rating) AS overall_rating,
                     sum(potential) AS potential
              FROM attributes WHERE season_id BETWEEN 2 AND 5 GROUP BY player_id, season_id) a
        JOIN roster r ON r.season_id = a.season_id {key}
        JOIN teams t ON t.team_id = r.team_id
        GROUP BY t.long_name, a.season_id
    """
    select = "SELECT t.long_name, a.season_id, sum(overall_rating) AS x, sum(potential) AS y"
    literal = spark.sql(select + joined.format(key=""))
    found = R.squad_metric_totals(f["attributes"], f["roster"], f["teams"], METRICS)
    assert rows(found) == rows(literal)
    keyed = spark.sql(select + joined.format(key="AND r.player_id = a.player_id"))
    found = R.squad_metric_totals_keyed(f["attributes"], f["roster"], f["teams"], METRICS)
    assert rows(found) == rows(keyed)


@pytest.mark.parametrize("seed", SEEDS)
def test_plain_rating_and_goals(spark, rows, seed):
    f = league(spark, seed)
    literal = spark.sql(
        """
        SELECT t.team_id, t.long_name, r.total_rating, g.total_goals
        FROM teams t JOIN (
            SELECT m.team_id, sum(a.overall_rating) AS total_rating
            FROM (SELECT DISTINCT team_id, player_id FROM roster) m
            JOIN attributes a ON a.player_id = m.player_id
            WHERE a.season_id BETWEEN 2 AND 5 GROUP BY m.team_id) r ON r.team_id = t.team_id
        JOIN (
            SELECT t.team_id, sum(if(p.home_team_id = t.team_id, home_goals, away_goals)) AS total_goals
            FROM teams t JOIN played p ON t.team_id = p.home_team_id OR t.team_id = p.away_team_id
            GROUP BY t.team_id) g ON g.team_id = t.team_id
        """
    )
    found = R.rating_vs_goals_plain(f["roster"], f["attributes"], f["played"], f["teams"])
    assert rows(found) == rows(literal)


def test_leader_by_metric(spark, rows):
    totals = spark.createDataFrame(
        [("Alfa", 10, 5), ("Beta", 10, 7), ("Delta", 3, None)],
        "long_name string, overall_rating int, potential int",
    )
    top = spark.createDataFrame([(30, "Alfa")], "goals int, long_name string")
    found = rows(R.leader_by_metric(totals, top, METRICS))
    assert found == [("potential", 0, False), ("overall_rating", 1, True)]
    nobody = spark.createDataFrame([(30, "Nobody")], "goals int, long_name string")
    assert rows(R.leader_by_metric(totals, nobody, METRICS), "n_rows") == [(0,), (0,)]


@pytest.mark.parametrize("seed", SEEDS)
def test_chart_invariants(spark, seed):
    f = league(spark, seed)
    played = f["played"].where("home_team_id <> away_team_id").dropna()
    teams = f["teams"].dropDuplicates(["team_id"])
    chart = team_season_goals(played, teams, f["seasons"])
    for row in chart.groupBy("season_id").sum("goals_for", "goals_against").collect():
        assert row["sum(goals_for)"] == row["sum(goals_against)"]
    sides = home_away_goals(played, teams, f["seasons"])
    both = chart.join(sides, ["team_id", "season_id"]).collect()
    assert len(both) == chart.count() == sides.count()
    for row in both:
        assert row["goals_for"] == (row["home_goals"] or 0) + (row["away_goals"] or 0)


def test_products_do_not_overflow(spark):
    big = 2_000_000_000
    totals = R.squad_metric_totals(
        spark.range(4).selectExpr("id AS player_id", "2 AS season_id", f"{big}L * {big}L / 4 AS x"),
        spark.range(6).selectExpr("id AS player_id", "1L AS team_id", "2 AS season_id"),
        spark.createDataFrame([(1, "Alfa")], "team_id bigint, long_name string"),
        ["x"],
    )
    assert int(totals.first()["x"]) == big * big * 6
