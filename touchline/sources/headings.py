"""Published names of tables and columns, for files and SQL written against them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from touchline.schemas import SLOTS

# Published table name, and column names in table order.
TABLES = {
    "countries": ("paises", {"id": "id", "name": "name"}),
    "leagues": ("liga", {"name": "name", "id": "id"}),
    "matches": (
        "partidos",
        {
            "match_id": "match_api_id",
            "league_id": "league_id",
            "season_id": "id_temporada",
            "home_goals": "home_team_goal",
            "away_goals": "away_team_goal",
            "goal_xml": "goal",
        },
    ),
    "fixtures": (
        "juega",
        {
            "match_id": "match_api_id",
            "home_team_id": "home_team_api_id",
            "away_team_id": "away_team_api_id",
        },
    ),
    "teams": (
        "equipos",
        {
            "team_id": "team_api_id",
            "long_name": "team_long_name",
            "short_name": "team_short_name",
        },
    ),
    "lineups": (
        "participan",
        {"match_id": "match_api_id"}
        | {
            f"{side}_member_{slot}": f"{side}_J_plantel_{slot}"
            for slot in range(1, SLOTS + 1)
            for side in ("home", "away")
        },
    ),
    "squad_members": (
        "plantel",
        {"member_id": "id_j_en_plantel", "team_id": "id_equipo", "player_id": "id_jugadores"},
    ),
    "squad_seasons": (
        "temporalidad_j_de_un_plantel",
        {"season_id": "id_temporada", "member_id": "id_j_en_plantel"},
    ),
    "players": ("jugadores", {"player_id": "player_api_id", "player_name": "player_name"}),
    "player_attributes": (
        "atributos",
        {
            "attribute_id": "atributos_id",
            "player_id": "player_api_id",
            "season_id": "id_temporada",
        },
    ),
    "seasons": ("temporada", {"season_id": "id_temporada", "season": "season"}),
    "goals": (
        "goles",
        {
            "goal_id": "id_goles",
            "minute": "minuto",
            "match_id": "match_api_id",
            "member_id": "id_j_en_plantel",
        },
    ),
}

# Headings of the published results.
RESULTS = {
    "most_wins": {"wins": "Cantidad de partidos ganados", "long_name": "Equipos"},
    "most_losses_by_season": {
        "losses": "Cantidad de partidos perdidos",
        "long_name": "Equipos",
        "season": "Temporada",
    },
    "most_draws_last_season": {
        "draws": "Cantidad de partidos empatados",
        "long_name": "Equipos",
    },
    "most_goals_for": {"long_name": "team_long_name", "goals_for": "goles_afavor"},
    "best_goal_difference": {
        "long_name": "team_long_name",
        "goal_difference": "diferencia_goles",
    },
    "squad_size": {
        "team_id": "team_api_id",
        "long_name": "team_long_name",
        "n_players": "cantidad_jugadores",
    },
    "top_scorer": {"goals": "Cantidad de goles", "player_name": "player_name"},
    "most_team_wins": {
        "player_id": "player_api_id",
        "player_name": "player_name",
        "wins": "partidos_ganados",
    },
    "most_clubs": {
        "player_id": "player_api_id",
        "player_name": "player_name",
        "n_teams": "cantidad_equipos",
    },
    "stable_players": {"player_name": "player_name"},
    "team_season_goals": {
        "team_id": "team_api_id",
        "season_id": "id_temporada",
        "goals_for": "goles_afavor",
        "goals_against": "goles_encontra",
        "avg_goals": "promedio_gol",
        "team_name": "nombre_equipo",
        "season": "nombre_temporada",
    },
    "home_away_goals": {
        "team_id": "team_api_id",
        "season_id": "id_temporada",
        "home_goals": "goles_de_local",
        "away_goals": "goles_de_visitante",
        "home_minus_away": "diferencia_goles_LvsV",
        "team_name": "nombre_equipo",
        "season": "nombre_temporada",
    },
    "team_series": {
        "team_id": "team_api_id",
        "season_id": "id_temporada",
        "goals_for": "goles_afavor",
        "goals_against": "goles_encontra",
        "avg_goals": "promedio_gol",
        "team_name": "nombre_equipo",
        "season": "nombre_temporada",
        "axis_max": "axis_max",
    },
    "rating_vs_goals": {
        "team_id": "team_api_id",
        "long_name": "team_long_name",
        "total_rating": "suma_total_overall",
        "total_goals": "suma_total_goles",
    },
}

# Normalized columns without a published counterpart: the season label next to its id.
_OURS_ONLY = {"season"}


def published_result(name: str, df: DataFrame) -> DataFrame:
    """A result with its published headings, in their order."""
    headings = RESULTS[name]
    return df.selectExpr(*[f"`{ours}` AS `{theirs}`" for ours, theirs in headings.items()])


def published_answers(results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Results under their published headings where they have some."""
    return {n: published_result(n, df) if n in RESULTS else df for n, df in results.items()}


def published_tables(tables: Mapping[str, DataFrame], suffix: str = "") -> dict[str, DataFrame]:
    """Normalized tables under their published names; further columns keep theirs."""
    published = {}
    for name, df in tables.items():
        if name not in TABLES:  # ours alone
            published[f"{name}{suffix}"] = df
            continue
        theirs, headings = TABLES[name]
        more = [c for c in df.columns if c not in headings and c not in _OURS_ONLY]
        published[f"{theirs}{suffix}"] = df.selectExpr(
            *[f"`{a}` AS `{b}`" for a, b in headings.items()], *[f"`{c}`" for c in more]
        )
    return published
