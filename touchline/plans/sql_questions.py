"""Questions as Spark SQL over registered views, with the period and the tables as parameters.

Values and names are bound by Spark (``:first``, ``IDENTIFIER(:matches)``); no text is put together
from what a caller passes. The goals of a team that met itself count once. The tables are views or saved tables under a common prefix, as
:func:`touchline.sources.tables.register_views` leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PERIOD = """
    played AS (
        SELECT m.match_id, m.season, m.season_id, m.home_goals, m.away_goals, f.home_team_id,
            f.away_team_id
        FROM IDENTIFIER(:matches) m JOIN IDENTIFIER(:fixtures) f USING (match_id)
        WHERE m.season_id BETWEEN :first AND :last),
    sides AS (
        SELECT match_id, season, season_id,
            inline(array(
                struct(home_team_id AS team_id, home_goals AS own, away_goals AS other, true AS counts),
                struct(away_team_id AS team_id, away_goals AS own, home_goals AS other,
                    home_team_id <> away_team_id AS counts)))
        FROM played)
"""

QUESTIONS = {
    "wins": f"""
        WITH {_PERIOD}
        SELECT team_id, long_name, wins
        FROM (SELECT team_id, count(*) AS wins FROM sides WHERE own > other GROUP BY team_id)
        JOIN IDENTIFIER(:teams) USING (team_id)""",
    "outcomes_by_season": f"""
        WITH {_PERIOD}
        SELECT team_id, season, count_if(own > other) AS wins, count_if(own = other) AS draws,
            count_if(own < other) AS losses
        FROM sides GROUP BY team_id, season""",
    "goals": f"""
        WITH {_PERIOD}
        SELECT team_id, long_name, goals_for, goals_against,
            goals_for - goals_against AS difference
        FROM (SELECT team_id, sum(own) AS goals_for, sum(other) AS goals_against
              FROM sides WHERE counts GROUP BY team_id)
        JOIN IDENTIFIER(:teams) USING (team_id)""",
}

TABLES = ("matches", "fixtures", "teams")


def ask(
    spark: SparkSession, question: str, first: int, last: int, prefix: str = ""
) -> DataFrame:
    """The answer to one of ``QUESTIONS`` for the seasons ``first`` to ``last``."""
    names = {name: prefix + name for name in TABLES}
    return spark.sql(QUESTIONS[question], args={"first": first, "last": last, **names})
