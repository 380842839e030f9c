"""Manifests against a plain fold over sorted lists."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from touchline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, `row` int, idx long, tree string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    own = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]]
    return digest("".join(own))


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The top, and for each node its siblings level by level."""
    sides: list[list[str]] = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                rest = "".join(nodes[k] for k in run if k != i)
                for owner in owners[i]:
                    sides[owner].append(rest)
        nodes, owners = (
            [digest("".join(nodes[i] for i in run)) for run in runs],
            [sum((owners[i] for i in run), []) for run in runs],
        )
    return nodes[0], sides


def wanted(rows: list[tuple]) -> list[tuple]:
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    subroots, found = [], []
    for lang in langs:
        own = [(r[0], leaf(r)) for r in rows if r[2] == lang]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, sides = tree([d for _, d in own])
        subroots.append(top)
        found.append((own, sides))
    root, upper = tree(subroots)
    return [
        (doc, lang, d, top, root, digest("".join(side + above)), root)
        for lang, top, (own, sides), above in zip(langs, subroots, found, upper)
        for (doc, d), side in zip(own, sides)
    ]


def made(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], SCHEMA).repartition(3)
    out = merkle.manifest(docs, carry={"idx": F.col("idx"), "leaf2": F.lit("y")})
    assert out.columns == ["doc", "group", "leaf", "path", "subroot", "root", "idx", "leaf2"]
    chosen = out.select(
        "doc", "group", "leaf", "subroot", "root",
        merkle.proof_digest("path"), merkle.folded("path", F.col("leaf")),
    )
    return [tuple(r) for r in chosen.collect()]


CASES = {
    "empty": [],
    "alone": [(1, "s", "en", 1, "a")],
    "two groups": [(1, "s", "en", 1, "a"), (2, "s", None, 1, None)],
    "dense": [(i, "s", "en", i, f"t{i}") for i in range(700)],
    "negative and far": [(i, "s", "en", 1, "t") for i in (-(1 << 63), -65, -1, 0, 63, 64, (1 << 63) - 1)],
    "nulls and ties": [
        *[(None, None, None, None, f"{i % 5}") for i in range(40)],
        *[(5, "s", "en", 3, "same")] * 30,
        *[(5, "s", "en", 3, f"other {i}") for i in range(9)],
        *[(i, "", "é", 0, "") for i in range(70)],
    ],
    "many groups": [(i, "s", f"l{i % 23}", 1, "t" * (i % 3)) for i in range(200)],
}


@pytest.mark.parametrize("case", list(CASES))
def test_manifest_equals_plain_fold(spark, case):
    rows = CASES[case][:]
    random.Random(1).shuffle(rows)
    assert sorted(made(spark, rows), key=str) == sorted(wanted(rows), key=str)


def test_changed_row_leads_elsewhere(spark):
    rows = [(i, "s", "en", 1, "Ab") for i in range(20)]
    docs = spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)
    lowered = [merkle.ascii_lower(c) if c == "text" else F.col(c) for c in merkle.FIELDS]
    found = merkle.manifest(docs, carry={"changed": merkle.leaf(lowered)})
    folded = found.select((merkle.folded("path", F.col("changed")) == F.col("root")).alias("same"))
    assert {r.same for r in folded.collect()} == {False}
