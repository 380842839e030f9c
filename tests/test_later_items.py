"""Filters before a shuffle, counts while writing, keys in buckets, merged sets and SQL questions."""

from __future__ import annotations

import pytest

from feeds import feed
from touchline import bindings as B
from touchline.operators.checks import duplicate_keys
from touchline.operators.filters import may_be_known
from touchline.operators.set_counts import member_sets, merged_counts
from touchline.plans import normalize as N
from touchline.plans import questions as Q
from touchline.plans.sql_questions import QUESTIONS, ask
from touchline.sources.tables import register_views, save_bucketed, write_tables


def test_few_rows_pass_and_every_known_one_does(spark, plan_of):
    rows = spark.range(200_000).selectExpr("if(id % 50 = 0, NULL, id) AS player_id", "id AS reading")
    keys = spark.range(0, 200_000, 400).selectExpr("id + 1 AS player_id")
    passed = may_be_known(rows, keys, "player_id")
    assert passed.columns == rows.columns
    exact = rows.join(keys, "player_id", "left_semi").count()
    assert passed.join(keys, "player_id", "left_semi").count() == exact == 500
    assert passed.count() < 200_000 / 8
    assert "BroadcastExchange" in plan_of(passed) and plan_of(passed).count("Exchange hashpartitioning") <= 1
    assert may_be_known(rows, keys, "player_id", most=499).count() == 196_000
    assert may_be_known(rows, keys.limit(0), "player_id").count() == 0


def test_measurements_are_cut_down_before_the_first_shuffle(spark, small, plan_of):
    """With one known player in a thousand few measurements are moved, and the result is exact."""
    measured = B.player_attributes(spark, small)
    ids = [r.player_api_id for r in measured.select("player_api_id").distinct().limit(3).collect()]
    players = spark.createDataFrame([(i,) for i in ids], "player_id long")
    passed = may_be_known(measured.withColumnRenamed("player_api_id", "player_id"), players, "player_id")
    assert passed.count() < measured.count() / 8
    wanted = measured.where(measured.player_api_id.isin(ids)).distinct().count()
    assert N.dated_attributes(measured, players).count() == wanted


def test_writes_count_what_they_write(spark, tmp_path):
    tables = N.normalize(feed(spark))
    seen = write_tables(tables, str(tmp_path))
    assert seen.keys() == tables.keys()
    for name, counts in seen.items():
        stored = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert counts["rows"] == stored.count(), name
        if "season_id" in stored.columns:
            assert counts["without_season"] == stored.where("season_id IS NULL").count()
    assert seen["matches"]["without_season"] == 2 and seen["goal_rejects"] == {"rows": 0}


def test_keys_are_checked_within_buckets(spark, plan_of):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    good = spark.range(2_000).selectExpr("id AS match_id", "id % 7 AS x")
    save_bucketed({"fixtures": good}, "bucketed", buckets=4)
    stored = spark.table("bucketed.fixtures")
    assert "Exchange" not in plan_of(duplicate_keys(stored, ["match_id"]))
    # Repeats at the ends of buckets, one of them in another file of its bucket.
    ends = stored.groupBy("x").agg({"match_id": "max"}).selectExpr("`max(match_id)` AS match_id", "x")
    ends.repartition(4, "match_id").write.bucketBy(4, "match_id").sortBy("match_id").mode("append").saveAsTable(
        "bucketed.fixtures"
    )
    found = duplicate_keys(spark.table("bucketed.fixtures"), ["match_id"])
    assert sorted(r.match_id for r in found.collect()) == [*range(1993, 2000)]
    with pytest.raises(ValueError, match="not unique"):
        save_bucketed({"fixtures": good.union(good.limit(1))}, "bucketed", buckets=4)


def test_sets_merge_into_every_period(spark):
    rows = spark.range(5_000).selectExpr(
        "id % 11 AS player_id", "CAST(id * 7 % 5 AS INT) AS season_id",
        "if(id % 13 = 0, NULL, xxhash64(id) % 150) AS team_id",
    )
    sets = member_sets(rows, "team_id", ["player_id", "season_id"]).cache()
    for first in range(5):
        for last in range(first, 5):
            inside = rows.where(f"season_id BETWEEN {first} AND {last}")
            wanted = {
                r.player_id: r.n
                for r in inside.groupBy("player_id").agg({"team_id": "count"}).selectExpr("player_id", "0 AS n").collect()
            }
            exact = inside.selectExpr("player_id", "team_id").distinct().where("team_id IS NOT NULL")
            wanted = {r.player_id: r["count"] for r in exact.groupBy("player_id").count().collect()}
            got = merged_counts(sets.where(f"season_id BETWEEN {first} AND {last}"), ["player_id"], "n")
            assert {r.player_id: r.n for r in got.collect()} == wanted


def test_sql_answers_any_period_and_prefix(spark, rows):
    tables = N.normalize(feed(spark))
    register_views(tables, "spain_")
    for first, last in ((1, 9), (2, 2), (7, 8)):
        inside = Q.season_matches(tables["matches"], tables["seasons"], tables["fixtures"], first, last)
        goals = ask(spark, "goals", first, last, "spain_")
        assert rows(goals.drop("difference")) == rows(Q.team_goals(inside, tables["teams"]))
        assert {r.team_id for r in ask(spark, "wins", first, last, "spain_").collect()} <= {
            r.team_id for r in tables["teams"].collect()
        }
        assert ask(spark, "outcomes_by_season", first, last, "spain_").count() >= 0
    assert all("{" not in text and "%" not in text for text in QUESTIONS.values())
