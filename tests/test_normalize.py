from __future__ import annotations

import pytest

import feeds
from feeds import GOALS, feed
from touchline import __main__ as command
from touchline.plans import normalize as N
from touchline.plans import report
from touchline.plans.report import answers
from touchline.schemas import METRICS, NORMALIZED, UNUSED_MATCH_COLUMNS
from touchline.sources.headings import RESULTS, published_result, published_tables
from touchline.sources.tables import (
    describe_tables,
    read_chart,
    read_csv,
    read_feed,
    read_tables,
    register_views,
    save_bucketed,
    write_csv,
    write_tables,
)


@pytest.fixture(scope="module")
def spain(spark):
    return N.normalize(feed(spark), country="Spain")


@pytest.fixture(scope="module")
def everywhere(spark):
    return N.normalize(feed(spark))


def test_twelve_tables_with_their_columns(spain):
    assert spain.keys() == {*NORMALIZED, "goal_rejects"}
    for name, schema in NORMALIZED.items():
        kinds = {f.name: f.dataType for f in spain[name].schema}
        assert kinds == {f.name: f.dataType for f in schema}, name


def test_country_scope(spain, everywhere, rows):
    assert rows(spain["countries"]) == [(10, "Spain")]
    assert rows(spain["leagues"], "name", "id") == [("Liga", 10)]
    assert rows(spain["matches"], "match_id") == [(i,) for i in range(1, 7)]
    assert rows(everywhere["matches"], "match_id") == [(i,) for i in range(1, 8)]
    assert rows(everywhere["leagues"], "name", "id") == [("Liga", 10), ("Serie A", 20)]


def test_unused_columns_are_gone(spark):
    kept = N.league_matches(feed(spark)["matches"]).columns
    assert not set(kept) & set(UNUSED_MATCH_COLUMNS)


def test_teams_need_a_home_match(spain, everywhere, rows):
    assert rows(spain["teams"], "team_id") == [(1,), (2,)]
    assert rows(everywhere["teams"], "team_id") == [(1,), (2,), (50,)]


def test_fixtures(spain, rows):
    assert rows(spain["fixtures"])[:3] == [(1, 1, 2), (2, 2, 1), (3, 1, 3)]


def test_seasons_come_from_measurements_of_squad_players(spain, everywhere, rows):
    assert rows(spain["seasons"], "season_id", "season") == [
        (1, "2007/2008"),
        (2, "2008/2009"),
        (3, "2009/2010"),
        (4, "2010/2011"),
    ]
    # 2011/2012 is known only through player 502, whose team 51 never hosted.
    assert everywhere["seasons"].count() == 4


def test_match_seasons_without_id_keep_their_label(spain, rows):
    found = rows(spain["matches"], "match_id", "season", "season_id")
    assert found == [
        (1, "2008/2009", 2),
        (2, "2009/2010", 3),
        (3, "2008/2009", 2),
        (4, "2015/2016", None),
        (5, None, None),
        (6, "2010/2011", 4),
    ]


def test_squads(spain, rows):
    members = spain["squad_members"].join(spain["squad_seasons"], "member_id")
    assert rows(members, "member_id", "team_id", "player_id", "season") == [
        (1, 1, 101, "2008/2009"),
        (2, 1, 101, "2009/2010"),
        (3, 1, 102, "2008/2009"),
        (4, 1, 102, "2015/2016"),
        (5, 2, 201, "2008/2009"),
        (6, 2, 201, "2009/2010"),
        (7, 2, 201, "2015/2016"),
        (8, 2, 202, "2008/2009"),
    ]
    # A membership without a season has no id.
    nameless = spain["squad_members"].where("member_id IS NULL")
    assert rows(nameless, "team_id", "player_id") == [(1, 103), (2, 201)]


def test_lineups_take_the_membership_of_the_season(spain, rows):
    columns = ["match_id", "home_member_1", "home_member_2", "away_member_1", "away_member_3"]
    assert rows(spain["lineups"], *columns) == [
        (1, 1, 3, 5, 8),
        (2, 6, None, 2, None),
        (4, 7, None, 4, None),
        (5, None, None, None, None),
        (6, None, None, None, None),
    ]


def test_lineups_with_any_membership(spark, rows):
    tables = N.normalize(feed(spark), country="Spain", member_of="any")
    found = rows(tables["lineups"], "match_id", "home_member_1", "away_member_1")
    assert found == [(1, 1, 5), (2, 5, 1), (4, 5, 3), (5, None, 5), (6, None, None)]
    with pytest.raises(ValueError):
        N.normalize(feed(spark), member_of="last")


def test_unordered_ids_name_the_same_rows(spark, spain, rows):
    loose = N.normalize(feed(spark), country="Spain", ordered_ids=False)
    for name, key in (("squad_members", "member_id"), ("player_attributes", "attribute_id")):
        columns = [c for c in spain[name].columns if c != key]
        assert rows(loose[name], *columns) == rows(spain[name], *columns)
        ids = [i for (i,) in rows(loose[name], key) if i is not None]
        assert len(ids) == len(set(ids))
    resolved = loose["goals"].join(loose["squad_members"], "member_id")
    assert rows(resolved, "goal_id", "team_id", "player_id") == [
        (1, 1, 101),
        (4, 2, 201),
        (9, 2, 201),
    ]


def test_players_of_squads_only(spain, rows):
    assert rows(spain["players"], "player_id") == [(101,), (102,), (103,), (201,), (202,)]


def test_attributes_are_distinct_numbered_and_labelled(spain, rows):
    columns = ["attribute_id", "player_id", "season", "season_id", "overall_rating", "marking"]
    assert rows(spain["player_attributes"], *columns) == [
        (1, 101, "2008/2009", 2, 50, 69),
        (2, 101, "2008/2009", 2, 60, 79),
        (3, 101, "2009/2010", 3, 61, 80),
        (4, 201, "2007/2008", 1, 40, 59),
        (5, 201, "2010/2011", 4, 41, 60),
    ]
    assert spain["player_attributes"].columns[4:] == METRICS


def test_goals_resolve_against_the_squad_of_the_season(spain, rows):
    # 2: player 999 unknown, 3: no player. 9: season without id still matches by label.
    assert rows(spain["goals"]) == [(1, 5, 1, 1), (4, 80, 1, 5), (9, 1, 4, 7)]


def test_wide_lineups_and_squad_input(spark, rows):
    wide = N.wide_lineups(feed(spark)["matches"])
    assert len(wide.columns) == 23
    assert wide.count() == 7


def test_csv_round_trip_of_feed_and_tables(spark, spain, rows, tmp_path):
    write_tables(feed(spark), str(tmp_path / "raw"), fmt="csv")
    again = read_feed(spark, str(tmp_path / "raw"))
    assert rows(again["matches"], "goal")[0] == ("<goal/>",)
    assert (GOALS,) in rows(again["matches"], "goal")
    tables = N.normalize(again, country="Spain")
    for name in ("squad_members", "player_attributes", "goals", "lineups"):
        assert rows(tables[name], *spain[name].columns) == rows(spain[name]), name
    for fmt in ("csv", "parquet"):
        folder = str(tmp_path / fmt)
        ordered = {n: tables[n].select(schema.names) for n, schema in NORMALIZED.items()}
        write_tables(ordered, folder, fmt=fmt)
        back = read_tables(spark, folder, fmt=fmt)
        for name in NORMALIZED:
            assert rows(back[name]) == rows(ordered[name]), (fmt, name)
    with pytest.raises(ValueError):
        write_tables(tables, str(tmp_path / "x"), fmt="xls")


def _scan_of(column, plan):
    return next(x for x in plan.splitlines() if "FileScan" in x and f"{column}#" in x)


def test_season_layout_is_pruned(spark, spain, rows, plan_of, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "stage", lambda df, label: df)  # shows what is staged
    folder = str(tmp_path / "laid out")
    ordered = {n: spain[n].select(schema.names) for n, schema in NORMALIZED.items()}
    write_tables(ordered, folder, by_season=True)
    back = read_tables(spark, folder)
    for name in NORMALIZED:
        assert rows(back[name]) == rows(ordered[name]), name
    found = answers(back)
    assert rows(found["most_wins"]) == [(1, "Team 1")]
    for name, column in (("most_wins", "home_goals"), ("stable_players", "potential")):
        scan = _scan_of(column, plan_of(found[name]))
        filters = scan.split("PartitionFilters: [")[1].split("]")[0]
        assert "season_id" in filters


def test_season_filter_reaches_the_files(spark, spain, plan_of, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "stage", lambda df, label: df)
    ordered = {n: spain[n].select(schema.names) for n, schema in NORMALIZED.items()}
    write_tables(ordered, str(tmp_path))
    plan = plan_of(answers(read_tables(spark, str(tmp_path)))["team_season_goals"])
    scan = _scan_of("home_goals", plan)
    assert "GreaterThanOrEqual(season_id,2)" in scan
    read = scan.split("ReadSchema: struct<")[1]
    assert "goal_xml" not in read and "league_id" not in read


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, rows, tmp_path):
    df = spark.createDataFrame(
        [(1, ""), (2, None), (3, " a "), (4, 'q "q", \\ \n end')], "id int, text string"
    )
    write_csv(df, str(tmp_path / "t"))
    again = read_csv(spark, str(tmp_path / "t"), df.schema, multiline=True)
    assert rows(again) == rows(df.replace("", None, subset=["text"]))


def test_csv_columns_are_found_by_name(spark, rows, tmp_path):
    text = "extra,name,id\nx,Spain,10.0\ny,,\n"
    (tmp_path / "t.csv").write_text(text)
    found = read_csv(spark, str(tmp_path / "t.csv"), NORMALIZED["countries"])
    assert found.dtypes == [("id", "bigint"), ("name", "string"), ("extra", "string")]
    assert rows(found) == [(10, "Spain", "x"), (None, None, "y")]


@pytest.mark.parametrize("text", ["id,other\n1,x\n", "id,name\n1.5,x\n", "id,name\n1,x,3\n"])
def test_csv_that_does_not_fit_is_refused(spark, tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "t.csv"), NORMALIZED["countries"]).collect()


def test_extra_feed_columns_pass_through(spark, rows):
    raw = feed(spark)
    raw["matches"] = raw["matches"].selectExpr("*", "'1.73' AS `B365 H`", "match_api_id AS `order`")
    raw["player_attributes"] = raw["player_attributes"].selectExpr("*", "'high' AS `work rate`")
    tables = N.normalize(raw, country="Spain")
    assert rows(tables["matches"], "`B365 H`")[0] == ("1.73",)
    assert rows(tables["player_attributes"], "`work rate`") == [("high",)] * 5


def test_published_names(spark, spain, rows):
    register_views(published_tables(spain, "_spain"))
    wins = spark.sql(
        """
        SELECT count(*) AS n FROM partidos_spain p
        JOIN juega_spain j ON j.match_api_id = p.match_api_id
        JOIN equipos_spain e ON e.team_api_id = j.home_team_api_id
        WHERE p.home_team_goal > p.away_team_goal AND p.id_temporada BETWEEN 2 AND 5
        """
    )
    assert wins.first()[0] == 1
    assert spark.table("participan_spain").columns[1:3] == ["home_J_plantel_1", "away_J_plantel_1"]


def test_all_answers_over_normalized_tables(spark, spain, rows):
    found = answers(spain, team=1)
    assert rows(found["most_wins"]) == [(1, "Team 1")]
    assert rows(found["most_goals_for"]) == [("Team 1", 3)]
    assert rows(found["top_scorer"]) == [(1, "P101")]
    assert rows(found["most_clubs"], "player_id") == [(101,), (102,), (103,), (201,), (202,)]
    for name in RESULTS:
        published_result(name, found[name])
    for name, df in found.items():
        assert df.schema is not None, name
    heading = published_result("most_losses_by_season", found["most_losses_by_season"])
    assert rows(heading, "`Cantidad de partidos perdidos`", "Temporada") == [(1, "2008/2009")] * 2


def test_views_and_descriptions(spark, spain):
    register_views(spain, prefix="spain_")
    assert spark.sql("SELECT count(*) FROM spain_matches").first()[0] == 6
    assert ("season", "string") in describe_tables(spark)["spain_seasons"]


def test_bucketed_tables_join_without_a_shuffle(spark, spain, plan_of, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS league")
    save_bucketed(spain, "league", buckets=4)
    matches, fixtures = spark.table("league.matches"), spark.table("league.fixtures")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = matches.join(fixtures, "match_id")
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _moved(rows_, column, years):
    def ahead(text):
        if text is None:
            return None
        if "/" in text:
            return "/".join(str(int(year) + years) for year in text.split("/"))
        return f"{int(text[:4]) + years}{text[4:]}"

    return [{**row, column: ahead(row[column])} for row in rows_]


def test_tables_of_other_years_are_filled(spark, monkeypatch):
    """The whole feed four years ahead gives the same answers under its own season labels."""
    now = answers(N.normalize(feed(spark), country="Spain"))
    monkeypatch.setitem(feeds.TABLES, "matches", _moved(feeds.MATCHES, "season", 4))
    monkeypatch.setitem(feeds.TABLES, "player_attributes", _moved(feeds.ATTRIBUTES, "date", 4))
    later = answers(N.normalize(feed(spark), country="Spain"))
    for name in [n for n in now if n.startswith("pivot_")]:
        labels = now[name].columns[1:]
        assert later[name].columns[1:] == [
            "/".join(str(int(year) + 4) for year in label.split("/")) for label in labels
        ]
        cells = [tuple(r) for r in now[name].collect()]
        assert [tuple(r) for r in later[name].collect()] == cells
        if name != "pivot_home_away_diff":  # no team plays on both sides of a season here
            assert any(value is not None for row in cells for value in row[1:])
        assert [row[0] for row in cells] == sorted(row[0] for row in cells)
    losses = [r.season for r in later["most_losses_by_season"].collect()]
    assert losses == ["2012/2013"] * 2


def test_sorted_answers_put_null_last(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "team_name string")
    assert [r.team_name for r in report._sorted(df, "team_name").collect()] == ["a", "b", None]


def test_chart_tables_come_back_typed(spark, spain, rows, tmp_path):
    found = answers(spain)
    for name in ("team_season_goals", "home_away_goals", "rating_vs_goals"):
        path = str(tmp_path / name)
        write_csv(published_result(name, found[name]), path)
        again = read_chart(spark, path, name)
        assert rows(again.select(*again.columns)) == rows(
            found[name].selectExpr(*[f"CAST({c} AS {k}) AS {c}" for c, k in again.dtypes])
        )
        assert dict(again.dtypes)["team_id"] == "bigint"


def test_command_line_writes_published_names_and_rejects(spark, rows, tmp_path):
    raw, tables, results = (str(tmp_path / n) for n in ("raw", "tables", "results"))
    write_tables(feed(spark), raw)
    command.main(["normalize", raw, tables, "--country", "Spain", "--member-of", "any"])
    assert rows(spark.read.parquet(f"{tables}/goal_rejects.parquet")) == []
    command.main(["answer", tables, results, "--published", "--team", "1", "--write", "csv"])
    header = spark.read.option("header", True).csv(f"{results}/most_wins.csv").columns
    assert header == ["Cantidad de partidos ganados", "Equipos"]
    assert spark.read.option("header", True).csv(f"{results}/team_series.csv").count() == 3
    command.main(
        ["normalize", raw, tables + "2", "--country", "Spain", "--published", "--suffix", "_spain"]
    )
    assert spark.read.parquet(f"{tables}2/partidos_spain.parquet").count() == 6


def test_maps_and_slots_give_the_same_lineups(spark, plan_of, rows):
    """Squads of up to three members in maps, larger ones slot by slot, for both member rules."""
    matches = feed(spark)["matches"]
    teams = N.home_teams(feed(spark)["teams"], N.fixtures(matches))
    squad = N.squad_ids(N.squad_membership(matches, teams))
    for rule in ("season_exact", "any"):
        wanted = rows(N.lineup_members(matches, teams, squad, rule, in_map=0))
        assert wanted
        for in_map in (2, 3, 512):
            assert rows(N.lineup_members(matches, teams, squad, rule, in_map=in_map)) == wanted
    mapped = plan_of(N.lineup_members(matches, teams, squad, in_map=512))
    assert "stack(" not in mapped and "Expand" not in mapped
    assert "stack(" in plan_of(N.lineup_members(matches, teams, squad, in_map=0))


def test_documents_are_parsed_once(spark, monkeypatch):
    """Goals and rejects of one run come from one staged parse."""
    parses = []

    def counted(df, label):
        parses.append(df._jdf.queryExecution().optimizedPlan().toString().count("from_xml("))
        return stage(df, label)

    stage = N.stage
    monkeypatch.setattr(N, "stage", counted)
    tables = N.normalize(feed(spark), country="Spain")
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in tables.values()]
    assert sum(parses) + sum(plan.count("from_xml(") for plan in plans) == 1
