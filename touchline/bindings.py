"""A league feed derived from the driver tables (see FIXTURES.md, section 4).

An order is a match: the customer's nation hosts the nation of the lowest supplier key, lines
flagged A are home goals and lines flagged R away goals, part keys are players. A line is also a
measurement of its part. Whole tables are used throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.seasons import season_label
from touchline.plans import normalize as N
from touchline.schemas import METRICS, SLOTS, UNUSED_MATCH_COLUMNS

# Lines flagged N are not played.
SIDES = {"home": "A", "away": "R"}

# Measurements move 12 years ahead and match labels 13, so that season ids 2..5 are 2008/2009
# to 2011/2012 and the last match year has a label no measurement knows.
MEASURED_SHIFT = 12
MATCH_SHIFT = 13


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up in the file footer once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _shifted(date: str, years: int) -> str:
    return f"CAST(add_months({date}, {12 * years}) AS STRING)"


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "CAST(r_regionkey AS BIGINT) AS id", "r_name AS name"
    )


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a league of its region."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .selectExpr(
            "c_custkey AS id", "CAST(n_regionkey AS BIGINT) AS country_id", "c_name AS name"
        )
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS team_api_id",
        "n_name AS team_long_name",
        "concat('N', n_nationkey) AS team_short_name",
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS player_api_id", "p_name AS player_name"
    )


def metric_expr(position: int, metric: str) -> str:
    """Integer metric of a line, so that sums are exact. Reads alike in Spark and plain SQL."""
    direct = {
        "overall_rating": "CAST(l_quantity AS INT)",
        "potential": "l_linenumber",
        "crossing": "CAST(round(l_discount * 100) AS INT)",
        "marking": "CAST(round(l_tax * 100) AS INT)",
    }
    return direct.get(metric, f"CAST((l_suppkey + l_linenumber * {position}) % 100 AS INT)")


METRIC_EXPRS = [f"{metric_expr(i, m)} AS {m}" for i, m in enumerate(METRICS)]


def player_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS player_api_id",
        "l_suppkey AS player_fifa_api_id",
        f"{_shifted('l_shipdate', MEASURED_SHIFT)} AS date",
        *METRIC_EXPRS,
    )


def _goal_document() -> str:
    """XML from the filled slots of a sheet; some players and teams are left out, as in real feeds."""

    def values(side: str, away: int) -> str:
        slots = ", ".join(f"{side}_player_{i}" for i in range(1, SLOTS + 1))
        return f"""
            transform(array({slots}), (player, i) -> CASE WHEN player IS NOT NULL THEN concat(
                '<value><id>', match_api_id * 100 + {SLOTS} * sheet + i + {1 + 20 * away}, '</id>',
                '<elapsed>', ({SLOTS} * sheet + i) * 10 + {10 + 5 * away}, '</elapsed>',
                if(player % 9 = 4, '', concat('<player1>', player, '</player1>')),
                if(player % 11 = 7, '', concat('<team>', {side}_team_api_id, '</team>')),
                '</value>\\n<!-- "next" -->') END)
        """

    body = f"concat_ws('', {values('home', 0)}, {values('away', 1)})"
    return f"concat('<goal>', nullif({body}, ''), '</goal>')"


def _plain_matches(spark: SparkSession, sf_dir: str, lineups: bool = True) -> DataFrame:
    """One row per order that has lines; when ``lineups`` are wanted, one wide row per sheet of it.

    The lines are folded per order first, so the joins move one row per order. Every aggregate has
    a fixed size. A line's place is its place among the lines of its order and flag, by line number
    and part. Sheet 0 holds the first ``SLOTS`` places of both sides, the next sheet as many more,
    and so on: an order has as many sheets as its longer side fills, at least one. Goals and teams
    are those of the whole order on each of them.
    """
    lines = table(spark, sf_dir, "lineitem")
    whole = {
        "s_suppkey": "min(l_suppkey)",
        **{f"{side}_team_goal": f"count_if(l_returnflag = '{flag}')" for side, flag in SIDES.items()},
    }
    if lineups:
        # All windows go by order, so that the folding below needs no shuffle of its own.
        order = "PARTITION BY l_orderkey"
        along = f"{order} ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING"
        places = " ".join(
            f"WHEN '{flag}' THEN count_if(l_returnflag = '{flag}') OVER ({along}) - 1"
            for flag in SIDES.values()
        )
        placed = lines.selectExpr(
            "l_orderkey", "l_returnflag", "l_partkey",
            *[f"{what} OVER ({order}) AS {name}" for name, what in whole.items()],
            f"CASE l_returnflag {places} END AS place",
        )
        slots = [
            f"min(l_partkey) FILTER (WHERE l_returnflag = '{flag}' AND place % {SLOTS} = {slot - 1})"
            f" AS {side}_player_{slot}"
            for side, flag in SIDES.items()
            for slot in range(1, SLOTS + 1)
        ]
        per_order = placed.groupBy(
            "l_orderkey", F.expr(f"coalesce(place DIV {SLOTS}, 0)").alias("sheet")
        ).agg(*[F.expr(e) for e in [*[f"min({name}) AS {name}" for name in whole], *slots]])
    else:
        per_order = lines.groupBy("l_orderkey").agg(
            *[F.expr(f"{what} AS {name}") for name, what in whole.items()]
        )
    per_order = per_order.withColumnRenamed("l_orderkey", "o_orderkey")
    joined = (
        per_order.join(table(spark, sf_dir, "orders"), "o_orderkey")
        .withColumnRenamed("o_custkey", "c_custkey")
        .join(table(spark, sf_dir, "customer"), "c_custkey")
        .join(table(spark, sf_dir, "supplier"), "s_suppkey")
    )
    moment = _shifted("o_orderdate", MATCH_SHIFT)
    match = [
        "o_orderkey AS match_api_id",
        f"{season_label(moment)} AS season",
        "CAST(c_nationkey AS BIGINT) AS home_team_api_id",
        "CAST(s_nationkey AS BIGINT) AS away_team_api_id",
        *[f"CAST({side}_team_goal AS INT) AS {side}_team_goal" for side in SIDES],
    ]
    if not lineups:
        return joined.selectExpr(*match)
    filled = [f"{side}_player_{i}" for side in SIDES for i in range(1, SLOTS + 1)]
    unused = [c for c in UNUSED_MATCH_COLUMNS if c not in ("country_id", "stage")]
    return joined.selectExpr(
        *match,
        "sheet",
        "month(o_orderdate) AS stage",
        f"{moment} AS date",
        *filled,
        *[f"o_orderpriority AS `{c}`" for c in unused],
    )


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed row, with the league of the home nation's region and the goal document.

    A feed row has ``SLOTS`` places a side: those of the first sheet. Players of further sheets are
    in :func:`membership`, their goals in :func:`documents`.
    """
    league = table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS home_team_api_id",
        "CAST(n_regionkey AS BIGINT) AS league_id",
        "CAST(n_regionkey AS BIGINT) AS country_id",
    )
    plain = _plain_matches(spark, sf_dir).where("sheet = 0")
    return plain.join(league, "home_team_api_id").selectExpr(
        *[c for c in plain.columns if c != "sheet"],
        "league_id",
        "country_id",
        f"{_goal_document()} AS goal",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match, sheet, season and goal document only, one document a sheet."""
    return _plain_matches(spark, sf_dir).selectExpr(
        "match_api_id", "sheet", "season", "stage", f"{_goal_document()} AS goal"
    )


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "countries": countries(spark, sf_dir),
        "leagues": leagues(spark, sf_dir),
        "teams": teams(spark, sf_dir),
        "players": players(spark, sf_dir),
        "player_attributes": player_attributes(spark, sf_dir),
        "matches": raw_matches(spark, sf_dir),
    }


# Normalized tables without the restriction to teams seen at home or players seen in a squad,
# so that one question does not rebuild the whole model.


def all_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams(spark, sf_dir).toDF("team_id", "long_name", "short_name")


def all_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players(spark, sf_dir).toDF("player_id", "player_name")


def _label_of_line() -> str:
    return season_label(_shifted("l_shipdate", MEASURED_SHIFT))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are made once per day, not once per line."""
    days = table(spark, sf_dir, "lineitem").select("l_shipdate").distinct()
    return N.season_dimension(days.selectExpr(f"{_label_of_line()} AS season"))


def attributes(
    spark: SparkSession, sf_dir: str, player: str = "l_partkey", metrics: list[str] = METRICS
) -> DataFrame:
    """Every measurement with its season id, repeats included."""
    chosen = [e for m, e in zip(METRICS, METRIC_EXPRS, strict=True) if m in metrics]
    labelled = table(spark, sf_dir, "lineitem").selectExpr(
        f"{player} AS player_id", f"{_label_of_line()} AS season", *chosen
    )
    return N.with_season_id(labelled, seasons(spark, sf_dir))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized matches that still carry their team ids."""
    raw = _plain_matches(spark, sf_dir, lineups=False).selectExpr(
        "match_api_id AS match_id",
        "season",
        "home_team_api_id AS home_team_id",
        "away_team_api_id AS away_team_id",
        "home_team_goal AS home_goals",
        "away_team_goal AS away_goals",
    )
    return N.with_season_id(raw, seasons(spark, sf_dir))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.squad_membership(_plain_matches(spark, sf_dir), all_teams(spark, sf_dir))


def memberships_with_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_season_id(membership(spark, sf_dir), seasons(spark, sf_dir))


def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.squad_ids(membership(spark, sf_dir))
