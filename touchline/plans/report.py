"""All questions and chart tables over one set of normalized tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans import charts as C
from touchline.plans import questions as Q
from touchline.plans import ratings as R
from touchline.plans import rosters as S
from touchline.schemas import METRICS
from touchline.session import stage


def _sorted(df: DataFrame, *columns: str) -> DataFrame:
    """NULL last, as published."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def answers(
    tables: Mapping[str, DataFrame],
    metrics: Sequence[str] = tuple(METRICS),
    team: int | None = None,
) -> dict[str, DataFrame]:
    """One lazy result per question, in the order they are asked.

    Lists and tables come sorted; their rows are teams, seasons or both. Seasons are those of the
    period that ``tables`` has, at most a hundred labels, looked up once. The period's matches with
    their teams are staged: nearly every question reads them, and the join behind them is that of
    the two longest tables. ``team`` asks for one team's series as well.
    """
    teams, seasons, players = tables["teams"], tables["seasons"], tables["players"]
    members, attributes = tables["squad_members"], tables["player_attributes"]
    labels = C.period_labels(seasons)
    years = [int(label[:4]) for label in labels]
    matches = stage(Q.season_matches(tables["matches"], seasons, tables["fixtures"]), "period")
    roster = S.roster(members, tables["squad_seasons"])
    totals = R.squad_metric_totals(attributes, roster, teams, metrics)
    keyed = R.squad_metric_totals_keyed(attributes, roster, teams, metrics)
    top_team = Q.top_scoring_team(matches, teams)
    chart = C.team_season_goals(matches, teams, seasons)
    sides = C.home_away_goals(matches, teams, seasons)
    series = {} if team is None else {"team_series": _sorted(C.team_series(chart, team), "season_id")}
    return {
        "most_wins": Q.most_wins(matches, teams),
        "most_losses_by_season": _sorted(
            Q.most_losses_by_season(matches, seasons, teams, years or Q.YEARS), "season", "long_name"
        ),
        "most_draws_last_season": Q.most_draws_in(matches, seasons, teams, (years or Q.YEARS)[-1]),
        "most_goals_for": Q.most_goals_for(matches, teams),
        "best_goal_difference": Q.best_goal_difference(matches, teams),
        "squad_size": S.squad_size(members, attributes, matches, teams),
        "top_scorer": Q.top_scorer(tables["goals"], members, matches, players),
        "most_team_wins": S.most_team_wins(roster, matches, players),
        "most_clubs": S.most_clubs(members, players),
        "stable_players": R.stable_players(attributes, players),
        "top_scoring_team": top_team,
        "squad_metric_totals": totals,
        "squad_metric_totals_keyed": keyed,
        "squad_metric_grand_totals": R.metric_grand_totals(totals, metrics),
        "leader_by_metric": R.leader_by_metric(
            R.metric_grand_totals(totals, metrics), top_team, metrics
        ),
        "leader_by_metric_keyed": R.leader_by_metric(
            R.metric_grand_totals(keyed, metrics), top_team, metrics
        ),
        "team_season_goals": _sorted(chart, "team_id", "season_id"),
        **{
            name: _sorted(C.team_by_season_mean(chart, values, labels), "team_name")
            for name, values in (
                ("pivot_goals_for", "goals_for"),
                ("pivot_goals_against", "goals_against"),
                ("pivot_avg_goals", "avg_goals"),
            )
        },
        "home_away_goals": _sorted(sides, "team_id", "season_id"),
        **{
            name: _sorted(C.team_by_season_strict(sides, values, labels), "team_name")
            for name, values in (
                ("pivot_home", "home_goals"),
                ("pivot_away", "away_goals"),
                ("pivot_home_away_diff", "home_minus_away"),
            )
        },
        **series,
        "rating_vs_goals": R.rating_vs_goals(members, attributes, matches, teams),
        "rating_vs_goals_plain": R.rating_vs_goals_plain(members, attributes, matches, teams),
    }
