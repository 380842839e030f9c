"""One entry per job or question, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline import bindings as B
from touchline.operators import checks
from touchline.operators.updates import update_from
from touchline.operators.xml_events import xml_rejects
from touchline.plans import charts as C
from touchline.plans import normalize as N
from touchline.plans import questions as Q
from touchline.plans import ratings as R
from touchline.plans import rosters as S
from touchline.plans.sql_questions import ask
from touchline.schemas import METRICS
from touchline.session import stage_path
from touchline.sources.headings import published_result
from touchline.sources.stored import append_stored, read_stored, update_stored
from touchline.sources.tables import read_chart, read_csv, register_views, write_csv

Query = Callable[[SparkSession, str], DataFrame]

# The one-country run of the checks, and the team of the series.
COUNTRY = "ASIA"
TEAM = 7

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _country_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = N.countries(B.countries(spark, sf_dir), COUNTRY)
    return N.league_matches(B.raw_matches(spark, sf_dir), chosen)


def _period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.season_matches(B.matches(spark, sf_dir))


# Sources and normalization


@query
def csv_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal documents of the feed rows, with quotes and line breaks, through CSV and back."""
    documents = B.documents(spark, sf_dir).where("sheet = 0").select("match_api_id", "season", "goal")
    path = stage_path(spark, "roundtrip")
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema, multiline=True)


@query
def chart_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart table under its published headings, through CSV and back."""
    path = stage_path(spark, "chart")
    write_csv(published_result("team_season_goals", _chart(spark, sf_dir)), path)
    return read_chart(spark, path, "team_season_goals")


@query
def country_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = N.countries(B.countries(spark, sf_dir), COUNTRY)
    return N.leagues(B.leagues(spark, sf_dir), chosen)


@query
def league_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _country_matches(spark, sf_dir)


@query
def fixtures_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fixtures(B.raw_matches(spark, sf_dir))


@query
def home_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.home_teams(B.teams(spark, sf_dir), N.fixtures(_country_matches(spark, sf_dir)))


@query
def wide_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.wide_lineups(B.raw_matches(spark, sf_dir))


@query
def squad_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.membership(spark, sf_dir)


@query
def squad_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.squad(spark, sf_dir)


def _lineup_ids(spark: SparkSession, sf_dir: str, member_of: str) -> DataFrame:
    squad = B.squad(spark, sf_dir)
    teams = B.all_teams(spark, sf_dir)
    return N.lineup_members(B.raw_matches(spark, sf_dir), teams, squad, member_of)


@query
def lineup_ids_season_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineup_ids(spark, sf_dir, "season_exact")


@query
def lineup_ids_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineup_ids(spark, sf_dir, "any")


@query
def squad_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.squad_seasons(B.squad(spark, sf_dir), B.seasons(spark, sf_dir))


@query
def players_in_squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.squad_players(B.players(spark, sf_dir), B.membership(spark, sf_dir))


@query
def attributes_seasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = N.squad_players(B.players(spark, sf_dir), B.membership(spark, sf_dir))
    dated = N.dated_attributes(B.player_attributes(spark, sf_dir), players)
    return N.with_season_id(dated, B.seasons(spark, sf_dir))


@query
def season_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.seasons(spark, sf_dir)


@query
def season_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.match_table(B.raw_matches(spark, sf_dir), B.seasons(spark, sf_dir)).select(
        "match_id", "season", "season_id"
    )


@query
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the lowest priority among their orders; those without keep their segment."""
    target = B.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment AS label")
    source = B.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS c_custkey", "o_orderpriority AS label"
    )
    return update_from(target, source, ["c_custkey"], ["label"], ambiguous="min")


def _played(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.matches(spark, sf_dir).select("match_id", "season_id", "home_goals", "away_goals")


@query
def stored_matches_second_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first feed of the earlier seasons without scores, a second one of all matches, and a
    correction of the drawn ones, all to one stored table."""
    path = stage_path(spark, "stored")
    whole = _played(spark, sf_dir)
    unknown = ["match_id", "season_id", "0 AS home_goals", "0 AS away_goals"]
    append_stored(path, whole.where("season_id <= 3").selectExpr(*unknown), ["match_id"])
    append_stored(path, whole, ["match_id"])
    drawn = whole.where("home_goals = away_goals").selectExpr("match_id", "home_goals + 1 AS home_goals")
    update_stored(path, whole.schema, drawn, ["match_id"], ["home_goals"])
    return read_stored(spark, path, whole.schema)


@query
def squad_ids_second_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memberships up to one season are numbered by a first feed, and keep their ids."""
    folder = stage_path(spark, "squads")
    whole = B.membership(spark, sf_dir)
    N.kept_squad_ids(whole.where("season <= '2009/2010'"), folder, "first").count()
    return N.kept_squad_ids(whole, folder, "second")


@query
def goal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.goal_events(B.documents(spark, sf_dir))


@query
def goal_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """February's documents lose their end, further sheets included, May's events their id, August's
    minutes become text."""
    cut = """CASE stage WHEN 2 THEN substring(goal, 1, length(goal) - 7)
        WHEN 5 THEN replace(replace(goal, '<id>', '<no>'), '</id>', '</no>')
        WHEN 8 THEN replace(goal, '<elapsed>', '<elapsed>x') ELSE goal END AS goal"""
    documents = B.documents(spark, sf_dir).where("sheet = 0 OR NOT stage <=> 2")
    documents = documents.selectExpr("match_api_id AS match_id", cut)
    return xml_rejects(documents, "goal", ["match_id"]).select("match_id", "reason")


@query
def goals_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    squad = B.squad(spark, sf_dir)
    return N.resolve_goals(N.goal_events(B.documents(spark, sf_dir)), squad)


# Questions


@query
def sql_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals per team as parameterised SQL over views."""
    matches = B.matches(spark, sf_dir)
    register_views(
        {
            "matches": matches.drop("home_team_id", "away_team_id"),
            "fixtures": matches.select("match_id", "home_team_id", "away_team_id"),
            "teams": B.all_teams(spark, sf_dir),
        },
        "asked_",
    )
    return ask(spark, "goals", Q.FIRST_SEASON, Q.LAST_SEASON, "asked_")


@query
def clubs_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different teams per player in two of the seasons, merged from sets per season."""
    sets = S.club_sets(B.memberships_with_season(spark, sf_dir))
    return S.clubs_in_period(sets, B.all_players(spark, sf_dir), 3, 4)


@query
def season_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, seasons = B.raw_matches(spark, sf_dir), B.seasons(spark, sf_dir)
    return Q.season_matches(N.match_table(raw, seasons), seasons, N.fixtures(raw))


@query
def most_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.most_wins(_period(spark, sf_dir), B.all_teams(spark, sf_dir))


@query
def most_losses_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.most_losses_by_season(
        _period(spark, sf_dir), B.seasons(spark, sf_dir), B.all_teams(spark, sf_dir)
    )


@query
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _period(spark, sf_dir)
    home = matches.selectExpr("season_id", "home_team_id AS team_id")
    away = matches.selectExpr("season_id", "away_team_id AS team_id")
    return home.union(away).distinct()


@query
def most_draws_last_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.most_draws_in(
        _period(spark, sf_dir), B.seasons(spark, sf_dir), B.all_teams(spark, sf_dir)
    )


@query
def team_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.team_goals(_period(spark, sf_dir), B.all_teams(spark, sf_dir))


@query
def most_goals_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.most_goals_for(_period(spark, sf_dir), B.all_teams(spark, sf_dir))


@query
def best_goal_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.best_goal_difference(_period(spark, sf_dir), B.all_teams(spark, sf_dir))


@query
def squad_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.squad_size(
        B.membership(spark, sf_dir),
        B.attributes(spark, sf_dir, metrics=[]),
        _period(spark, sf_dir),
        B.all_teams(spark, sf_dir),
    )


@query
def top_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    squad = B.squad(spark, sf_dir)
    goals = N.resolve_goals(N.goal_events(B.documents(spark, sf_dir)), squad)
    return Q.top_scorer(
        goals, N.squad_members(squad), _period(spark, sf_dir), B.all_players(spark, sf_dir)
    )


@query
def player_team_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.player_team_wins(
        B.memberships_with_season(spark, sf_dir),
        _period(spark, sf_dir),
        B.all_players(spark, sf_dir),
    )


@query
def most_team_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_team_wins(
        B.memberships_with_season(spark, sf_dir),
        _period(spark, sf_dir),
        B.all_players(spark, sf_dir),
    )


@query
def clubs_per_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clubs_per_player(B.membership(spark, sf_dir), B.all_players(spark, sf_dir))


@query
def most_clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_clubs(B.membership(spark, sf_dir), B.all_players(spark, sf_dir))


@query
def stable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here an order is the player, so that short series occur."""
    measured = B.attributes(spark, sf_dir, player="l_orderkey", metrics=["overall_rating"])
    players = B.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS player_id", "o_orderpriority AS player_name"
    )
    return R.stable_players(measured, players, "overall_rating")


@query
def top_scoring_team_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.top_scoring_team(_period(spark, sf_dir), B.all_teams(spark, sf_dir))


def _as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(
        *[f"CAST({c} AS DOUBLE) AS {c}" if c in columns else c for c in df.columns]
    )


def _season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.squad_metric_totals(
        B.attributes(spark, sf_dir),
        B.memberships_with_season(spark, sf_dir),
        B.all_teams(spark, sf_dir),
    )


@query
def squad_metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(_season_totals(spark, sf_dir), METRICS)


def _keyed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.squad_metric_totals_keyed(
        B.attributes(spark, sf_dir),
        B.memberships_with_season(spark, sf_dir),
        B.all_teams(spark, sf_dir),
    )


@query
def squad_metric_totals_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed_totals(spark, sf_dir)


@query
def squad_metric_grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(R.metric_grand_totals(_season_totals(spark, sf_dir)), METRICS)


@query
def leader_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leader_by_metric(
        R.metric_grand_totals(_season_totals(spark, sf_dir)),
        Q.top_scoring_team(_period(spark, sf_dir), B.all_teams(spark, sf_dir)),
    )


@query
def leader_by_metric_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leader_by_metric(
        R.metric_grand_totals(_keyed_totals(spark, sf_dir)),
        Q.top_scoring_team(_period(spark, sf_dir), B.all_teams(spark, sf_dir)),
    )


# Chart tables


def _labels(spark: SparkSession, sf_dir: str) -> list[str]:
    return C.period_labels(B.seasons(spark, sf_dir))


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_season_goals(
        _period(spark, sf_dir), B.all_teams(spark, sf_dir), B.seasons(spark, sf_dir)
    )


def _sides_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.home_away_goals(
        _period(spark, sf_dir), B.all_teams(spark, sf_dir), B.seasons(spark, sf_dir)
    )


@query
def team_season_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chart(spark, sf_dir)


@query
def pivot_goals_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_mean(_chart(spark, sf_dir), "goals_for", _labels(spark, sf_dir))


@query
def pivot_goals_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_mean(_chart(spark, sf_dir), "goals_against", _labels(spark, sf_dir))


@query
def pivot_avg_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_mean(_chart(spark, sf_dir), "avg_goals", _labels(spark, sf_dir))


@query
def team_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_series(_chart(spark, sf_dir), TEAM)


@query
def home_away_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides_chart(spark, sf_dir)


@query
def pivot_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_strict(_sides_chart(spark, sf_dir), "home_goals", _labels(spark, sf_dir))


@query
def pivot_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_strict(_sides_chart(spark, sf_dir), "away_goals", _labels(spark, sf_dir))


@query
def pivot_home_away_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.team_by_season_strict(_sides_chart(spark, sf_dir), "home_minus_away", _labels(spark, sf_dir))


@query
def rating_vs_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.rating_vs_goals(
        B.membership(spark, sf_dir),
        B.attributes(spark, sf_dir, metrics=["overall_rating"]),
        _period(spark, sf_dir),
        B.all_teams(spark, sf_dir),
    )
    return _as_double(found, ["total_rating", "total_goals"])


@query
def rating_vs_goals_unmultiplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rating_vs_goals_plain(
        B.membership(spark, sf_dir),
        B.attributes(spark, sf_dir, metrics=["overall_rating"]),
        _period(spark, sf_dir),
        B.all_teams(spark, sf_dir),
    )


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
