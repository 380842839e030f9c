from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash
from touchline.llm.components import components
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(values)):
        near = np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)[0] + i + 1
        for j in near:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, doc in enumerate(ids):
        groups.setdefault(root(i), []).append(doc)
    return {doc: min(docs) for docs in groups.values() for doc in docs}


def test_query_equals_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    wanted = brute_components([r.doc_id for r in docs], prints, 2)
    found = QUERIES["op1_simhash"](spark, small).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == {
        r.doc_id: p for r, p in zip(docs, prints)
    }


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for value in list(prints):  # chains and bushes of one to three flips
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(1, 4)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    signed = sorted(simhash._signed(p) for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    unsigned = [p % (1 << 64) for p in signed]
    wanted = brute_components(signed, unsigned, radius)
    assert {p: found.get(p, p) for p in signed} == wanted


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        for i in range(64):
            for j in range(64):
                spots = 1 << i | (1 << j if radius == 2 else 0)
                assert any(not mask & spots for mask in masks)


def test_odd_rows(spark):
    rows = [
        (5, None, "x"),
        (2, "", "y"),
        (None, " \n", "z"),
        (7, "One two  three", "a"),
        (8, "one TWO three", "b"),
        (8, "one TWO three", "b"),
        (9, "solo", None),
        (10, "word " * 50_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc or -1, r.component) for r in found) == [
        (-1, 2), (2, 2), (5, 2), (7, 7), (8, 7), (8, 7), (9, 9), (10, 10),
    ]
    assert next(r.fp for r in found if r.doc == 5) == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [2, 7, 9, 10]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_id_keeps_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 1


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(3, "A"), (5, "A"), (5, "B"), (7, "B")], [(3, "A"), (5, "B")]),
        ([(3, "A"), (3, "B")], [(3, "A"), (3, "B")]),
        ([(None, "A"), (None, "A"), (4, "B"), (None, "B")], [(None, "A"), (4, "B")]),
        ([(1, "A"), (1, "A"), (2, None), (2, "")], [(1, "A"), (2, None)]),
    ],
)
def test_rows_are_judged_and_not_ids(spark, rows, wanted):
    texts = {"A": "one two three four", "B": "quite another text than that", None: None, "": ""}
    docs = spark.createDataFrame(
        [(i, texts[t], "r", 1) for i, t in rows], "doc_id long, text string, row string, mark int"
    )
    kept = simhash.keep_one(docs.repartition(3))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted(((i, texts[t] or "") for i, t in wanted), key=str)
