"""Explicit schemas for the raw feed and the normalized tables."""

from __future__ import annotations

from pyspark.sql import types as T

SLOTS = 11

# The twenty rating columns of the attribute feed, in feed order.
METRICS = [
    "overall_rating",
    "potential",
    "crossing",
    "finishing",
    "dribbling",
    "free_kick_accuracy",
    "ball_control",
    "acceleration",
    "sprint_speed",
    "agility",
    "reactions",
    "balance",
    "shot_power",
    "jumping",
    "strength",
    "aggression",
    "interceptions",
    "vision",
    "penalties",
    "marking",
]

# Feed columns that no table keeps.
UNUSED_MATCH_COLUMNS = [
    "shoton",
    "shotoff",
    "foulcommit",
    "card",
    "corner",
    "possession",
    "country_id",
    "stage",
    "cross",
]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


def slot_columns(prefix: str, slots: int = SLOTS) -> list[str]:
    return [f"{prefix}_{i}" for i in range(1, slots + 1)]


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()

RAW = {
    "countries": _struct(id=_LONG, name=_TEXT),
    "leagues": _struct(id=_LONG, country_id=_LONG, name=_TEXT),
    "teams": _struct(team_api_id=_LONG, team_long_name=_TEXT, team_short_name=_TEXT),
    "players": _struct(player_api_id=_LONG, player_name=_TEXT),
    "player_attributes": _struct(
        player_api_id=_LONG,
        player_fifa_api_id=_LONG,
        date=_TEXT,
        **{metric: _INT for metric in METRICS},
    ),
    "matches": _struct(
        match_api_id=_LONG,
        country_id=_LONG,
        league_id=_LONG,
        season=_TEXT,
        stage=_INT,
        date=_TEXT,
        home_team_api_id=_LONG,
        away_team_api_id=_LONG,
        home_team_goal=_INT,
        away_team_goal=_INT,
        **{c: _LONG for c in slot_columns("home_player") + slot_columns("away_player")},
        goal=_TEXT,
        shoton=_TEXT,
        shotoff=_TEXT,
        foulcommit=_TEXT,
        card=_TEXT,
        cross=_TEXT,
        corner=_TEXT,
        possession=_TEXT,
    ),
}

NORMALIZED = {
    "countries": _struct(id=_LONG, name=_TEXT),
    "leagues": _struct(name=_TEXT, id=_LONG),
    "matches": _struct(
        match_id=_LONG,
        league_id=_LONG,
        season=_TEXT,
        season_id=_INT,
        home_goals=_INT,
        away_goals=_INT,
        goal_xml=_TEXT,
    ),
    "fixtures": _struct(match_id=_LONG, home_team_id=_LONG, away_team_id=_LONG),
    "teams": _struct(team_id=_LONG, long_name=_TEXT, short_name=_TEXT),
    "lineups": _struct(
        match_id=_LONG,
        **{c: _LONG for c in slot_columns("home_member") + slot_columns("away_member")},
    ),
    "squad_members": _struct(member_id=_LONG, team_id=_LONG, player_id=_LONG),
    "squad_seasons": _struct(member_id=_LONG, season=_TEXT, season_id=_INT),
    "players": _struct(player_id=_LONG, player_name=_TEXT),
    "player_attributes": _struct(
        attribute_id=_LONG,
        player_id=_LONG,
        season=_TEXT,
        season_id=_INT,
        **{metric: _INT for metric in METRICS},
    ),
    "seasons": _struct(season_id=_INT, season=_TEXT),
    "goals": _struct(goal_id=_LONG, minute=_INT, match_id=_LONG, member_id=_LONG),
}

# The published chart tables, under their published headings; their sums come as ``35.0``.
CHARTS = {
    "team_season_goals": _struct(
        team_api_id=_LONG,
        id_temporada=_INT,
        goles_afavor=T.DoubleType(),
        goles_encontra=T.DoubleType(),
        promedio_gol=T.DoubleType(),
        nombre_equipo=_TEXT,
        nombre_temporada=_TEXT,
    ),
    "home_away_goals": _struct(
        team_api_id=_LONG,
        id_temporada=_INT,
        goles_de_local=T.DoubleType(),
        goles_de_visitante=T.DoubleType(),
        diferencia_goles_LvsV=T.DoubleType(),
        nombre_equipo=_TEXT,
        nombre_temporada=_TEXT,
    ),
    "rating_vs_goals": _struct(
        team_api_id=_LONG,
        team_long_name=_TEXT,
        suma_total_overall=T.DoubleType(),
        suma_total_goles=T.DoubleType(),
    ),
}

# Text cells of these tables may hold line breaks inside quotes.
MULTILINE_TABLES = {"matches"}
