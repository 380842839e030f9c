"""Neighbours against brute force: the same scores, and recall where the graph does not hold all."""

from __future__ import annotations

import math

import numpy as np
import pytest

from touchline.llm import neighbours
from touchline.llm.frames import table

SCHEMA = "vec_id long, embedding array<double>, label int, node long, id string"


def brute(rows: list[tuple], every: int, k: int) -> dict[int, list[tuple]]:
    usable = {
        i: np.array(v, dtype=float)
        for i, v in rows
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    }
    out = {}
    for q, own in usable.items():
        if q % every:
            continue
        scored = [
            (-(own @ v) / (math.sqrt(own @ own) * math.sqrt(v @ v)), i)
            for i, v in usable.items()
            if i != q
        ]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def found(spark, rows: list[tuple], every: int, k: int) -> dict[int, list[tuple]]:
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    out: dict[int, list[tuple]] = {}
    for r in sorted(neighbours.nearest(df, every, k).collect(), key=lambda r: (r["query"], r["rank"])):
        own = out.setdefault(r["query"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["id"], round(r["score"], 12)))
    return out


def _mixed() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)]  # one hot vector
    rows += [(300, None), (302, []), (304, [0.0] * 6), (306, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(308, [math.nan] * 6), (310, [math.inf] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(312, [1e300] * 6)]
    return rows


CASES = {"empty": [], "alone": [(0, [1.0])], "few": [(i, [1.0, float(i)]) for i in range(4)], "mixed": _mixed()}


@pytest.mark.parametrize("case", list(CASES))
def test_small_tables_are_searched_whole(spark, case):
    rows = CASES[case]
    safe = [(i, [1.0] * 6 if i == 312 else v) for i, v in rows]  # squares of 1e300 overflow
    wanted = {q: own for q, own in brute(safe, 2, 5).items() if own}
    assert found(spark, rows, 2, 5) == wanted


def test_shared_ids_and_lengths(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 2.0]), (6, [1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    assert found(spark, rows, 2, 1) == {2: [(4, 1.0)], 4: [(2, 1.0)], 6: [(2, round(0.5**0.5, 12))]}


def test_recall_on_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    wanted = brute(rows, 50, 5)
    got = neighbours.nearest(vectors, 50, 5).collect()
    assert len(got) == 5 * len(wanted)
    exact = {q: dict(own) for q, own in wanted.items()}
    hits = [(r["id"] in exact[r["query"]], r) for r in got]
    assert sum(hit for hit, _ in hits) >= 0.95 * len(got)
    assert all(abs(exact[r["query"]][r["id"]] - r["score"]) < 1e-9 for hit, r in hits if hit)
