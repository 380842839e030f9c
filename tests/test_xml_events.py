from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from touchline.operators.xml_events import xml_events, xml_rejects

SCHEMA = "match_id int, doc string"


def goal(*values: str) -> str:
    return "<goal>" + "".join(f"<value>{v}</value>" for v in values) + "</goal>"


FULL = "<id>1</id><elapsed>22</elapsed><player1>10</player1><team>7</team>"


def events(spark, rows, doc, strict=False):
    df = spark.createDataFrame([(5, doc)], SCHEMA)
    return rows(xml_events(df, "doc", ["match_id"], strict))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(
    "doc, expected",
    [
        (None, []),
        ("<goal/>", []),
        (goal(FULL), [(5, 1, 22, 10, 7)]),
        (goal("<id>2</id><elapsed>80</elapsed>"), [(5, 2, 80, None, None)]),
        (goal(FULL, "<id>2</id><elapsed>80</elapsed>"), [(5, 1, 22, 10, 7), (5, 2, 80, None, None)]),
        (goal(FULL + "<team>9</team>"), [(5, 1, 22, 10, 9)]),
        (goal(FULL + "<stats><goals>1</goals></stats>"), [(5, 1, 22, 10, 7)]),
        (goal("\n <id> 3 </id>\n<elapsed>4</elapsed>"), [(5, 3, 4, None, None)]),
    ],
)
def test_documents(spark, rows, doc, expected, strict):
    assert events(spark, rows, doc, strict) == expected


BAD = [
    (goal("<elapsed>22</elapsed>"), "missing id or minute"),
    (goal("<id>1</id>"), "missing id or minute"),
    (goal("<id>x</id><elapsed>22</elapsed>"), "non-numeric field"),
    ("<goal><value><id>1</id>", "malformed document"),
]


@pytest.mark.parametrize("doc, reason", BAD)
def test_lenient_leaves_bad_input_to_the_rejects(spark, rows, doc, reason):
    df = spark.createDataFrame([(5, doc)], SCHEMA)
    assert rows(xml_events(df, "doc", ["match_id"])) == []
    assert rows(xml_rejects(df, "doc", ["match_id"]), "match_id", "reason") == [(5, reason)]


@pytest.mark.parametrize("doc, reason", BAD)
def test_strict_fails(spark, doc, reason):
    df = spark.createDataFrame([(5, doc)], SCHEMA)
    with pytest.raises((PySparkException, Py4JJavaError)):
        xml_events(df, "doc", ["match_id"], strict=True).collect()


def test_one_bad_event_does_not_lose_the_document(spark, rows):
    doc = goal(FULL, "<id>x</id><elapsed>1</elapsed>")
    assert events(spark, rows, doc) == [(5, 1, 22, 10, 7)]


def test_unreadable_player_is_reported_and_null(spark, rows):
    doc = goal("<id>1</id><elapsed>2</elapsed><player1>?</player1><team>7</team>")
    assert events(spark, rows, doc) == [(5, 1, 2, None, 7)]
    df = spark.createDataFrame([(5, doc)], SCHEMA)
    assert rows(xml_rejects(df, "doc", ["match_id"]), "reason") == [("non-numeric field",)]


def test_long_document(spark):
    doc = goal(*[f"<id>{i}</id><elapsed>{i % 90}</elapsed>" for i in range(5000)])
    df = spark.createDataFrame([(5, doc)], SCHEMA)
    assert xml_events(df, "doc", ["match_id"]).count() == 5000


def test_each_document_is_parsed_once(spark, tmp_path):
    rows_ = [(i, goal(FULL) if i % 3 else None) for i in range(20)]
    spark.createDataFrame(rows_, SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for df in (
        xml_events(docs, "doc", ["match_id"]),
        xml_events(docs, "doc", ["match_id"], strict=True),
        xml_rejects(docs, "doc", ["match_id"]),
        xml_events(docs, "doc", ["match_id"]).join(docs, "match_id").where("team_id = 7"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_xml(") == 1, plan
