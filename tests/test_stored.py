"""Stored tables under repeated, moved and cut-off changes, and ids over several feeds."""

from __future__ import annotations

import pytest

from touchline.sources import stored
from touchline.sources.stored import append_stored, kept_ids, read_stored, update_stored

SCHEMA = "id long, season_id int, goals int, note string"


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")

    def frame(*rows):
        return spark.createDataFrame(list(rows), SCHEMA)

    append_stored(path, frame((1, 1, 5, "a"), (2, 1, 6, None), (3, 2, 7, "c"), (4, None, 8, "d")), ["id"])
    return path, frame


def content(spark, path, frame):
    return sorted((tuple(r) for r in read_stored(spark, path, frame().schema).collect()), key=str)


FIRST = [(1, 1, 5, "a"), (2, 1, 6, None), (3, 2, 7, "c"), (4, None, 8, "d")]


def test_append_replaces_and_moves(spark, table):
    path, frame = table
    assert content(spark, path, frame) == sorted(FIRST, key=str)
    feed = frame((3, 1, 70, "moved"), (4, 2, 8, "found"), (5, 3, 1, "new"))
    for _ in range(2):  # the second time changes nothing
        append_stored(path, feed, ["id"])
        assert content(spark, path, frame) == sorted(
            [(1, 1, 5, "a"), (2, 1, 6, None), (3, 1, 70, "moved"), (4, 2, 8, "found"), (5, 3, 1, "new")], key=str
        )


def test_other_seasons_are_not_rewritten(spark, table, tmp_path):
    path, frame = table
    before = {p.name for p in tmp_path.glob("table/season_id=2/part-*")}
    append_stored(path, frame((9, 1, 0, "x")), ["id"])
    assert {p.name for p in tmp_path.glob("table/season_id=2/part-*")} == before
    assert content(spark, path, frame) == sorted([*FIRST, (9, 1, 0, "x")], key=str)


def test_update(spark, table):
    path, frame = table
    source = spark.createDataFrame([(2, 60), (4, None), (77, 1)], "id long, goals int")
    for _ in range(2):
        update_stored(path, frame().schema, source, ["id"], ["goals"])
        wanted = [(1, 1, 5, "a"), (2, 1, 60, None), (3, 2, 7, "c"), (4, None, None, "d")]
        assert content(spark, path, frame) == sorted(wanted, key=str)
    with pytest.raises(ValueError):
        update_stored(path, frame().schema, source, ["id"], ["season_id"])


def test_empty_feed_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    frame = spark.createDataFrame([], SCHEMA)
    append_stored(path, frame, ["id"])
    assert read_stored(spark, path, frame.schema).count() == 0


@pytest.mark.parametrize("dies", ["before the rows are complete", "before the swap", "within the swap"])
def test_a_killed_write_is_repeated(spark, table, monkeypatch, dies):
    """Whatever was done when the run died, the same call again ends in the same table."""
    path, frame = table
    feed = frame((2, 2, 61, "moved"), (3, 2, 71, "again"), (6, 4, 1, "new"))
    finish = stored.finish

    def killed(spark_, path_, schema):
        aside = stored.Folder(spark, stored._aside(path))
        if not aside.has("touched"):
            return finish(spark_, path_, schema)
        if dies == "before the rows are complete":
            aside.delete("touched")
        if dies == "within the swap":
            stored.Folder(spark, path).delete("season_id=2")
        raise RuntimeError("killed")

    monkeypatch.setattr(stored, "finish", killed)
    with pytest.raises(RuntimeError):
        append_stored(path, feed, ["id"])
    monkeypatch.setattr(stored, "finish", finish)
    if dies == "before the rows are complete":
        assert content(spark, path, frame) == sorted(FIRST, key=str)
    append_stored(path, feed, ["id"])
    wanted = [(1, 1, 5, "a"), (2, 2, 61, "moved"), (3, 2, 71, "again"), (4, None, 8, "d"), (6, 4, 1, "new")]
    assert content(spark, path, frame) == sorted(wanted, key=str)


def test_ids_stay_over_feeds(spark, tmp_path):
    folder = str(tmp_path / "ids")

    def keys(*rows):
        return spark.createDataFrame(list(rows), "team long, name string")

    def ids(df, feed):
        return {(r.team, r["name"]): r.member for r in kept_ids(df, folder, feed, "member").collect()}

    first = ids(keys((2, "b"), (1, "a"), (1, None)), "one")
    assert sorted(first.values()) == [1, 2, 3]
    second = ids(keys((0, "z"), (2, "b"), (1, None), (0, "z")), "two")
    assert second == {(0, "z"): 4, (2, "b"): first[2, "b"], (1, None): first[1, None]}
    # A feed that died is numbered anew, a complete one is not.
    (tmp_path / "ids/feed=two/_SUCCESS").unlink()
    assert ids(keys((0, "y"), (0, "z")), "two") == {(0, "y"): 4, (0, "z"): 5}
    assert ids(keys((0, "z"), (1, "a")), "two") == {(0, "z"): 5, (1, "a"): first[1, "a"]}
