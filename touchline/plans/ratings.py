"""Questions about measured attributes.

Two questions exist in two forms. The ``*_by_season`` totals and ``rating_vs_goals`` keep the
published arithmetic, in which every squad row meets every measurement or match of the team or
season; products of per-side aggregates give those sums without building the pairs. The
``keyed`` and ``plain`` forms count each measurement and each goal once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import FEW_SALTS, salted_join
from touchline.operators.sides import team_matches
from touchline.plans.questions import FIRST_SEASON, LAST_SEASON
from touchline.plans.rosters import rated
from touchline.schemas import METRICS

# Fixed value: goals per point of bubble area.
BUBBLE_SCALE = 100


def _product(left: str, right: str) -> str:
    """Exact integer product, wide enough for any number of pairs."""
    return f"CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(18, 0))"


def stable_entities(
    measurements: DataFrame,
    entity: str,
    metric: str,
    first: int = FIRST_SEASON,
    last: int = LAST_SEASON,
) -> DataFrame:
    """Entities whose metric never moved: sample deviation 0, at least two measurements."""
    spread = (
        rated(measurements, first, last)
        .groupBy(entity)
        .agg(F.expr(f"stddev_samp({metric}) AS deviation"))
    )
    return spread.where("deviation = 0").select(entity)


def stable_players(
    attributes: DataFrame, players: DataFrame, metric: str = "potential"
) -> DataFrame:
    steady = stable_entities(attributes, "player_id", metric)
    return players.select("player_id", "player_name").join(steady, "player_id")


def _sums(metrics: Sequence[str]) -> list[Column]:
    return [F.expr(f"sum({m}) AS {m}") for m in metrics]


def squad_metric_totals(
    attributes: DataFrame,
    roster_rows: DataFrame,
    teams: DataFrame,
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Per team name and season: squad rows times the metric total of *all* players that season."""
    league = rated(attributes).groupBy("season_id").agg(*_sums(metrics))
    sizes = (
        roster_rows.groupBy("team_id", "season_id")
        .agg(F.expr("count(*) AS _members"))
        .join(teams.select("team_id", "long_name"), "team_id")
        .groupBy("long_name", "season_id")
        .agg(F.expr("sum(_members) AS _members"))
    )
    # One row per season of the period, hence the broadcast.
    return sizes.join(F.broadcast(league), "season_id").selectExpr(
        "long_name", "season_id", *[f"{_product(m, '_members')} AS {m}" for m in metrics]
    )


def squad_metric_totals_keyed(
    attributes: DataFrame,
    roster_rows: DataFrame,
    teams: DataFrame,
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Per team name and season: metric totals of the players in that squad."""
    per_player = rated(attributes).groupBy("player_id", "season_id").agg(*_sums(metrics))
    per_team = (
        salted_join(
            roster_rows.select("player_id", "season_id", "team_id"),
            per_player,
            ["player_id", "season_id"],
            salts=FEW_SALTS,
        )
        .groupBy("team_id", "season_id")
        .agg(*_sums(metrics))
    )
    return (
        per_team.join(teams.select("team_id", "long_name"), "team_id")
        .groupBy("long_name", "season_id")
        .agg(*_sums(metrics))
    )


def metric_grand_totals(
    season_totals: DataFrame, metrics: Sequence[str] = tuple(METRICS)
) -> DataFrame:
    """Totals of all seasons per team name."""
    return season_totals.groupBy("long_name").agg(*_sums(metrics))


def leader_by_metric(
    grand_totals: DataFrame, top_team: DataFrame, metrics: Sequence[str] = tuple(METRICS)
) -> DataFrame:
    """For each metric: is the team of ``top_team`` (one row) also the one with the largest total?

    One pass finds all maxima; ``n_rows`` counts the matching rows and ``is_leader`` tells
    whether there is one.
    """
    top = top_team.selectExpr("long_name", "true AS _top")
    flagged = grand_totals.join(top, "long_name", "left")
    long = flagged.unpivot(["_top"], list(metrics), "metric", "total")
    per_metric = long.groupBy("metric").agg(
        F.expr("max(total) AS _best"), F.expr("max(total) FILTER (WHERE _top) AS _own")
    )
    return per_metric.selectExpr(
        "metric",
        "if(_own = _best, 1L, 0L) AS n_rows",
        "coalesce(_own = _best, false) AS is_leader",
    )


def _ratings_per_team(
    squad_members: DataFrame, attributes: DataFrame, rating: str
) -> DataFrame:
    """``_pairs`` and ``_rating`` per team over squad rows (one per season) and measurements."""
    per_player = (
        rated(attributes)
        .groupBy("player_id")
        .agg(F.expr("count(*) AS _times"), F.expr(f"sum({rating}) AS _sum"))
    )
    rows = squad_members.groupBy("team_id", "player_id").agg(F.expr("count(*) AS _rows"))
    return (
        salted_join(rows, per_player, ["player_id"], salts=FEW_SALTS)
        .groupBy("team_id")
        .agg(
            F.expr(f"sum({_product('_rows', '_times')}) AS _pairs"),
            F.expr(f"sum({_product('_sum', '_rows')}) AS _rating"),
        )
    )


def rating_vs_goals(
    squad_members: DataFrame,
    attributes: DataFrame,
    matches: DataFrame,
    teams: DataFrame,
    rating: str = "overall_rating",
) -> DataFrame:
    """Rating and goal sums per team over all pairs of (squad member's measurement, team match).

    ``bubble_size`` is the goal sum scaled for a bubble plot.
    """
    ratings = _ratings_per_team(squad_members, attributes, rating)
    played = (
        team_matches(matches)
        .groupBy("team_id")
        .agg(F.expr("count(*) AS _matches"), F.expr("sum(goals_for) AS _goals"))
    )
    both = ratings.join(played, "team_id").join(teams.select("team_id", "long_name"), "team_id")
    return both.selectExpr(
        "team_id",
        "long_name",
        "_rating * _matches AS total_rating",
        "_pairs * _goals AS total_goals",
        f"CAST(_pairs * _goals AS DOUBLE) / {BUBBLE_SCALE} AS bubble_size",
    )


def rating_vs_goals_plain(
    squad_members: DataFrame,
    attributes: DataFrame,
    matches: DataFrame,
    teams: DataFrame,
    rating: str = "overall_rating",
) -> DataFrame:
    """Rating sum of each team's players and goals of the team, nothing multiplied."""
    per_player = rated(attributes).groupBy("player_id").agg(F.expr(f"sum({rating}) AS _sum"))
    pairs = squad_members.select("team_id", "player_id").distinct()
    ratings = (
        salted_join(pairs, per_player, ["player_id"], salts=FEW_SALTS)
        .groupBy("team_id")
        .agg(F.expr("sum(_sum) AS total_rating"))
    )
    goals = (
        team_matches(matches).groupBy("team_id").agg(F.expr("sum(goals_for) AS total_goals"))
    )
    return (
        ratings.join(goals, "team_id")
        .join(teams.select("team_id", "long_name"), "team_id")
        .select("team_id", "long_name", "total_rating", "total_goals")
    )
