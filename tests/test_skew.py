"""A third of all rows on one key, no broadcast joins, and skewed partitions really split."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from oracle_check import TABLES, compare, connect
from touchline import bindings as B
from touchline.operators.joins import keep_known
from touchline.plans import normalize as N
from touchline.plans import ratings as R

HOT = {
    "lineitem": "l_partkey = 7, l_suppkey = 3",
    "orders": "o_custkey = 5",
}
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}

# Joins on a team, a player, a match or a season, and both kinds of numbering.
NAMES = [
    "league_matches",
    "home_teams",
    "squad_members",
    "squad_ids",
    "lineup_ids_season_exact",
    "lineup_ids_any",
    "players_in_squads",
    "attributes_seasoned",
    "goals_resolved",
    "season_matches",
    "most_losses_by_season",
    "top_scorer",
    "squad_size",
    "player_team_wins",
    "most_clubs",
    "squad_metric_totals_keyed",
    "rating_vs_goals",
    "update_from_join",
    "team_season_goals",
]

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for name in TABLES:
        source = f"SELECT * FROM '{small}/{name}.parquet'"
        if name in HOT:
            changes = ", ".join(
                f"CASE WHEN hash({KEYS[name]}) % 3 = 0 THEN {value} ELSE {column} END AS {column}"
                for column, value in (c.split(" = ") for c in HOT[name].split(", "))
            )
            source = f"SELECT * REPLACE ({changes}) FROM '{small}/{name}.parquet'"
        con.execute(f"COPY ({source}) TO '{os.path.join(folder, name)}.parquet'")
    return folder


@pytest.fixture(scope="module")
def shuffling(spark):
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_result_under_skew(shuffling, skewed, name):
    assert compare(queries()[name](shuffling, skewed), connect(skewed), name) == ""


@pytest.fixture(scope="module")
def long_orders(small, tmp_path_factory):
    """Some sixty lines an order, so that a side has about twenty; one order has three sheets."""
    folder = str(tmp_path_factory.mktemp("long"))
    con = duckdb.connect()
    for name in TABLES:
        source = f"SELECT * FROM '{small}/{name}.parquet'"
        if name == "lineitem":
            source = f"""SELECT * REPLACE (CASE WHEN l_orderkey % 30 = 0 THEN 1 ELSE l_orderkey % 90 END
                AS l_orderkey) FROM '{small}/{name}.parquet'"""
        con.execute(f"COPY ({source}) TO '{os.path.join(folder, name)}.parquet'")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "csv_scan_roundtrip",
        "league_matches",
        "wide_lineups",
        "squad_members",
        "lineup_ids_any",
        "goal_events",
        "goal_rejects",
        "goals_resolved",
        "squad_ids_second_feed",
    ],
)
def test_sides_of_more_lines_than_slots(spark, long_orders, name):
    """Places beyond the row's are members and goals, as in the SQL, on further sheets."""
    assert B.documents(spark, long_orders).where("sheet > 1").count() > 0
    assert compare(queries()[name](spark, long_orders), connect(long_orders), name) == ""


@pytest.mark.parametrize(
    "name",
    [
        "clubs_in_period",
        "clubs_per_player",
        "leader_by_metric_keyed",
        "leader_by_metric",
        "lineup_ids_season_exact",
        "most_team_wins",
        "most_clubs",
        "player_team_wins",
        "rating_vs_goals",
        "players_in_squads",
        "rating_vs_goals_unmultiplied",
        "squad_ids",
        "squad_metric_totals",
        "squad_metric_grand_totals",
    ],
)
def test_questions_on_sides_of_more_lines_than_slots(spark, long_orders, name):
    """What is asked of squads counts the members of all sheets."""
    assert compare(queries()[name](spark, long_orders), connect(long_orders), name) == ""


def test_a_hot_scorer_is_split(shuffling, plan_of):
    """One squad member scores a third of the goals; the rest are spread thin."""
    events = shuffling.range(30000).selectExpr(
        "id AS goal_id", "1 AS minute", "id AS match_id", "'2008/2009' AS season",
        "if(id % 3 = 0, 7, id % 1000) AS player_id", "1L AS team_id",
    )
    squad = shuffling.range(1000).selectExpr(
        "id AS member_id", "1L AS team_id", "id AS player_id", "'2008/2009' AS season"
    )
    goals = N.resolve_goals(events, squad)
    assert goals.count() == 30000
    goals.collect()
    assert "SortMergeJoin(skew=true)" in plan_of(goals)


def test_a_hot_player_is_spread_on_the_way_to_numbering(shuffling):
    """A third of the measurements belong to one player; one shuffle serves join and DISTINCT."""
    measured = shuffling.range(30000).selectExpr(
        "if(id % 3 = 0, 7, id % 1000) AS player_id", "id DIV 2 AS reading"
    )
    squad = shuffling.range(2000).selectExpr("id % 1000 AS player_id")
    old = shuffling.conf.get("spark.sql.shuffle.partitions")
    shuffling.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        known = keep_known(measured, squad, "player_id", "player_id", distinct=True)
        sizes = [r["count"] for r in known.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == measured.distinct().count()
        assert max(sizes) < sum(sizes) / 10
        plan = known._jdf.queryExecution().executedPlan().toString()
        # Both steps of DISTINCT stand on the join, with no shuffle between them.
        assert plan.split("SortMergeJoin")[0].count("HashAggregate") == 2
        assert "Exchange" not in plan.split("SortMergeJoin")[0]
    finally:
        shuffling.conf.set("spark.sql.shuffle.partitions", old)


SPLIT = {
    # Joins whose hot side adaptive execution has to split, by the frame that is joined.
    "lineup_members": lambda spark, d: N.lineup_members(
        B.raw_matches(spark, d), B.all_teams(spark, d), B.squad(spark, d)
    ),
    "squad_membership": lambda spark, d: B.membership(spark, d),
    "rating_sums": lambda spark, d: R.rating_vs_goals_plain(
        B.membership(spark, d),
        B.attributes(spark, d, metrics=["overall_rating"]),
        B.matches(spark, d),
        B.all_teams(spark, d),
    ),
}


@pytest.mark.parametrize("name", list(SPLIT))
def test_no_task_gets_a_third_of_the_rows(shuffling, skewed, name):
    """The largest partition of the result's last join stays near the others under skew."""
    df = SPLIT[name](shuffling, skewed)
    df.collect()
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= max(3 * sum(sizes) / len(sizes), 50)
