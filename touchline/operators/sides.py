"""Match rows seen from the teams that played.

Expected columns: ``match_id, season_id, home_team_id, away_team_id, home_goals, away_goals``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_KEEP = ("match_id", "season_id")

_BOTH_SIDES = """
    stack(2,
          'H', home_team_id, home_goals, away_goals,
          'A', away_team_id, away_goals, home_goals
    ) AS (side, team_id, goals_for, goals_against)
"""


def match_sides(matches: DataFrame, keep: Sequence[str] = _KEEP) -> DataFrame:
    """Two rows per match: ``side`` H and A with ``team_id``, goals for and against."""
    return matches.selectExpr(*keep, _BOTH_SIDES)


def team_matches(matches: DataFrame, keep: Sequence[str] = _KEEP) -> DataFrame:
    """One row per team and match; a team facing itself counts once, as the home side."""
    marked = matches.selectExpr("*", "home_team_id <=> away_team_id AS _mirrored")
    sides = match_sides(marked, [*keep, "_mirrored"])
    return sides.where("side = 'H' OR NOT _mirrored").drop("_mirrored")


def outcome_rows(matches: DataFrame, outcome: str, keep: Sequence[str] = _KEEP) -> DataFrame:
    """``team_id`` per match for a win, a loss or a draw (a draw gives both teams).

    A match without a score has no outcome.
    """
    if outcome == "draw":
        drawn = matches.where("home_goals = away_goals")
        return drawn.selectExpr(*keep, "explode(array(home_team_id, away_team_id)) AS team_id")
    if outcome not in ("win", "loss"):
        raise ValueError(f"unknown outcome: {outcome}")
    sign = ">" if outcome == "win" else "<"
    return matches.where("home_goals <> away_goals").selectExpr(
        *keep, f"if(home_goals {sign} away_goals, home_team_id, away_team_id) AS team_id"
    )
