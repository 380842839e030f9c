from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.functions.seasons import label_year, season_label
from touchline.operators.checks import assert_unique, duplicate_keys
from touchline.operators.joins import keep_known, salted_join
from touchline.operators.keys import contiguous_ids, label_ids
from touchline.operators.ranking import argmax_with_ties, top_k
from touchline.operators.reshape import pivot_mean, pivot_strict
from touchline.operators.sides import match_sides, outcome_rows, team_matches
from touchline.operators.updates import update_from
from touchline.plans.charts import period_labels


@pytest.mark.parametrize(
    "date, label",
    [
        ("2009-02-01", "2009/2010"),
        ("2008-12-31 00:00:00", "2008/2009"),
        ("1999-12-31", "2099/20100"),
        ("2007-01-01", "2007/2008"),
        (None, None),
    ],
)
def test_season_label(spark, date, label):
    df = spark.createDataFrame([(date,)], "date string")
    assert df.selectExpr(season_label("date")).first()[0] == label


def test_label_year_reads_only_labels(spark):
    df = spark.createDataFrame([("2008/2009",), ("08/09",), (None,)], "s string")
    assert [r[0] for r in df.selectExpr(label_year("s")).collect()] == [2008, None, None]


def test_salted_join_equals_plain_join_with_a_hot_key(spark, rows):
    fact = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) AS k")
    dim = spark.range(40).selectExpr("id AS k", "id * 10 AS v")
    assert rows(salted_join(fact, dim, ["k"])) == rows(fact.join(dim, ["k"]))
    left = salted_join(fact, dim, ["k"], how="left")
    assert rows(left) == rows(fact.join(dim, ["k"], "left"))


def test_salted_join_spreads_the_hot_key(spark, plan_of):
    fact = spark.range(1000).selectExpr("id", "7 AS k")
    dim = spark.range(10).withColumnRenamed("id", "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(fact, dim, ["k"])
        assert "_salt" in plan_of(joined).split("Exchange hashpartitioning(")[1].split("\n")[0]
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_repeats_of_a_table_are_not_broadcast_beyond_the_threshold(spark, plan_of):
    """Keys that fit the threshold once, but not once per salt, are not gathered on the driver."""
    fact = spark.range(100_000).selectExpr("id", "id % 5000 AS k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        for keys, broadcast in ((4000, False), (100, True)):
            dim = spark.range(keys).withColumnRenamed("id", "k")
            joined, known = salted_join(fact, dim, ["k"]), keep_known(fact, dim, "k", "k", distinct=True)
            for df in (joined, known):
                assert len(df.collect()) == 20 * keys
                assert ("BroadcastExchange" in plan_of(df)) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_salted_join_keeps_the_columns_of_both_sides(spark):
    fact = spark.range(3).selectExpr("id AS k", "id AS `a.b`")
    dim = spark.createDataFrame([(1, None, {"x": 2})], "k long, `c d` int, m map<string,int>")
    joined = salted_join(fact, dim, ["k"])
    assert joined.schema.simpleString() == fact.join(dim, ["k"]).schema.simpleString()
    assert [tuple(r) for r in joined.collect()] == [(1, 1, None, {"x": 2})]
    assert salted_join(fact, dim.limit(0), ["k"], "left").count() == 3


def test_salted_join_refuses_joins_that_would_repeat_rows(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        salted_join(df, df, ["id"], how="right")
    with pytest.raises(ValueError):
        salted_join(df, df, ["id"], salts=12)


def test_keep_known_is_exists(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "other int")
    assert rows(keep_known(df, keys, "k", "other")) == [(1, "a"), (1, "a")]


def test_contiguous_ids_follow_the_order(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 3 = 0, 1, id % 11) AS g", "if(id = 17, NULL, id) AS x", "hash(id) AS payload"
    )
    numbered = contiguous_ids(df.repartition(7), ["g", "x"], "n").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, 5001))
    keys = [(r["g"], r["x"] is None, r["x"] or 0) for r in numbered]
    assert keys == sorted(keys)
    assert numbered[0].asDict().keys() == {"n", "g", "x", "payload"}


def test_contiguous_ids_without_an_order(spark, plan_of):
    df = spark.range(1000).repartition(5).selectExpr("id", "id * 2 AS x")
    numbered = contiguous_ids(df, None, "n")
    found = numbered.collect()
    assert sorted(r["n"] for r in found) == list(range(1, 1001))
    assert sorted(found) == sorted(numbered.collect())
    assert all(r["x"] == 2 * r["id"] for r in found)


def test_contiguous_ids_of_nothing(spark):
    assert contiguous_ids(spark.range(0), ["id"], "n").count() == 0


def test_label_ids_leave_null_out(spark, rows):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "s string")
    assert rows(label_ids(df, "s", "n")) == [(1, "a"), (2, "b")]


def test_update_from_keeps_unmatched_and_writes_matched_null(spark, rows):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "k int, v string, w int")
    source = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (9, "z")], "k int, v string")
    assert rows(update_from(target, source, ["k"], ["v"])) == [
        (1, "x", 5),
        (2, None, 6),
        (3, "c", 7),
    ]


def test_update_from_ambiguous_keys(spark, rows):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "y"), (1, "x")], "k int, v string")
    with pytest.raises(PySparkException, match="ambiguous update"):
        update_from(target, source, ["k"], ["v"]).collect()
    assert rows(update_from(target, source, ["k"], ["v"], ambiguous="min")) == [(1, "x")]
    unused = spark.createDataFrame([(2, "y"), (2, "x")], "k int, v string")
    assert rows(update_from(target, unused, ["k"], ["v"])) == [(1, "a")]


def test_top_k_breaks_ties_by_key(spark, rows):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", None)], "name string, n int")
    assert rows(top_k(df, "n", ["name"])) == [("a", 5)]


def test_argmax_keeps_ties(spark, rows):
    df = spark.createDataFrame(
        [("x", 1, 5), ("y", 1, 5), ("z", 1, 4), ("w", 2, 1)], "name string, g int, n int"
    )
    assert rows(argmax_with_ties(df, "n"), "name") == [("x",), ("y",)]


def test_pivot_mean(spark, rows):
    df = spark.createDataFrame(
        [("a", "s1", 2), ("a", "s1", 4), ("b", "s2", 1), (None, "s1", 9)], "i string, c string, v int"
    )
    assert rows(pivot_mean(df, "i", "c", "v", ["s1", "s2"])) == [("a", 3.0, None), ("b", None, 1.0)]
    assert pivot_mean(df, "i", "c", "v").columns == ["i", "s1", "s2"]


def test_pivot_strict_fails_on_a_duplicate_cell(spark, rows):
    df = spark.createDataFrame([("a", "s1", 2), ("b", "s2", None)], "i string, c string, v int")
    assert rows(pivot_strict(df, "i", "c", "v", ["s1", "s2"])) == [("a", 2, None), ("b", None, None)]
    twice = df.union(df)
    with pytest.raises(PySparkException, match="duplicate cell"):
        pivot_strict(twice, "i", "c", "v", ["s1", "s2"]).collect()


def test_unique_keys(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1), (2, 1)], "a int, b int")
    assert rows(duplicate_keys(df, ["a", "b"])) == [(1, 1, 2)]
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(df, ["a", "b"])
    assert_unique(df.where("a = 2"), ["a"])


MATCHES = (
    "match_id int, season_id int, home_team_id int, away_team_id int, home_goals int, away_goals int"
)


def test_sides_of_a_team_facing_itself(spark, rows):
    df = spark.createDataFrame([(1, 2, 7, 7, 3, 1), (2, 2, 7, 8, 0, 0)], MATCHES)
    assert match_sides(df).count() == 4
    once = team_matches(df).where("match_id = 1")
    assert rows(once, "side", "goals_for", "goals_against") == [("H", 3, 1)]


def test_outcomes(spark, rows):
    df = spark.createDataFrame(
        [(1, 2, 7, 8, 3, 1), (2, 2, 7, 8, 1, 1), (3, 2, 7, 8, None, 2), (4, 2, 7, 8, 0, 4)], MATCHES
    )
    assert rows(outcome_rows(df, "win"), "match_id", "team_id") == [(1, 7), (4, 8)]
    assert rows(outcome_rows(df, "loss"), "match_id", "team_id") == [(1, 8), (4, 7)]
    assert rows(outcome_rows(df, "draw"), "match_id", "team_id") == [(2, 7), (2, 8)]
    with pytest.raises(ValueError):
        outcome_rows(df, "walkover")


def test_rank_is_stable_when_every_row_ties(spark):
    df = spark.range(2000).withColumn("n", F.lit(1))
    assert argmax_with_ties(df, "n").count() == 2000


def test_period_labels_fail_instead_of_dropping_seasons(spark):
    seasons = spark.range(1, 102).selectExpr("id AS season_id", "CAST(id AS STRING) AS season")
    assert len(period_labels(seasons, 1, 100)) == 100
    with pytest.raises(ValueError):
        period_labels(seasons, 1, 101)
