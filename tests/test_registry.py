"""Every registered query against its SQL, and what its plan must not contain."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, connect
from touchline import bindings as B
from touchline.operators import keys
from touchline.plans import normalize
from touchline.plans import questions as Q
from touchline.registry.oracle import all_sql
from touchline.registry.queries import QUERIES
from touchline.session import stage

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert QUERIES.keys() == all_sql().keys()
    assert QUERIES.keys() <= queries().keys() and oracle_sql().keys() <= queries().keys()


def _refuse(plan):
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas", "InArrow"):
        assert bad not in plan


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, small, plan_of, monkeypatch, name):
    def watched(df, label):
        _refuse(plan_of(df))  # the half of a plan that is staged
        return stage(df, label)

    for module in (keys, normalize):
        monkeypatch.setattr(module, "stage", watched)
    df = QUERIES[name](spark, small)
    _refuse(plan_of(df))
    assert compare(df, con, name) in ("", "empty on both sides")


def test_entry(spark):
    assert entry(spark).count() > 0


def test_played_lines_all_have_a_slot(spark, small):
    played = B.table(spark, small, "lineitem").where("l_returnflag IN ('A', 'R')").count()
    assert normalize.lineup_slots(B.raw_matches(spark, small)).count() == played


def test_scan_reads_only_what_a_question_needs(spark, small, plan_of):
    plan = plan_of(Q.most_wins(Q.season_matches(B.matches(spark, small)), B.all_teams(spark, small)))
    read = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan)
    columns = {re.sub(r"#.*", "", c) for scan in read for c in scan.split(",")}
    assert columns == {"l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate"}
