from __future__ import annotations

import random

import pytest

from touchline.llm import decontaminate as D


def brute(docs, items, window):
    grams = {}
    for item, text in items:
        ws = D.words((text or "").encode())
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            grams.setdefault(tuple(ws[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        ws = D.words((text or "").encode())
        hit, owners = set(), set()
        for gram, own in grams.items():
            for i in range(len(ws) - len(gram) + 1):
                if tuple(ws[i : i + len(gram)]) == gram:
                    hit.update(range(i, i + len(gram)))
                    owners |= own
        out.append((doc, len(ws), len(hit), sorted(owners)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rng = random.Random(3)
    vocabulary = ["ab", "b", "c1", "Dé", "e", "中文"]

    def text(low, high):
        return ", ".join(rng.choice(vocabulary) for _ in range(rng.randrange(low, high)))

    items = [(i, text(1, 12)) for i in range(12)] + [(3, "zz yy ab"), (90, None), (91, "--")]
    docs = [(i, text(0, 60)) for i in range(60)] + [(60, None), (61, ""), (5, "ab b"), (5, "ab b")]
    docs.append((70, "zz " * 20_000 + "yy AB zz Yy ab"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id int, text string")
    found = D.benchmark_hits(frame, tests, window=5).collect()
    got = sorted(((r.doc, r.n_words, r.n_hit, r["items"]) for r in found), key=str)
    assert got == brute(docs, items, 5)
    for r in found:
        ws = D.words(next((t or "").encode() for d, t in docs if d == r.doc))
        for m in r.matches:
            texts = [D.words((t or "").encode()) for i, t in items if str(i) == m.item_id]
            piece = ws[m.doc_word : m.doc_word + m.n_words]
            assert any(t[m.item_word : m.item_word + m.n_words] == piece for t in texts)


def test_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "x"), (None, None, None)], "doc_id long, text string, item_id string"
    )
    tests = spark.createDataFrame([(None, "a b c"), ("t", "b c")], "item_id string, text string")
    found = {r.doc: (r.n_words, r.n_hit, r["items"]) for r in D.benchmark_hits(docs, tests).collect()}
    assert found == {1: (3, 2, ["t"]), None: (0, 0, [])}
    none = {r.n_hit for r in D.benchmark_hits(docs, tests.limit(0)).collect()}
    assert none == {0}
    assert D.benchmark_hits(docs.limit(0), tests).count() == 0
    clean = D.decontaminate(docs, tests)
    assert clean.columns == docs.columns
    assert [r.doc_id for r in clean.collect()] == [None]


def test_matches_are_verbatim_and_name_every_place(spark):
    item = [f"w{i}" for i in range(100)]
    changed = [*item[:50], "other", *item[51:]]
    shared = [f"s{i}" for i in range(20)]
    items = [
        ("long", " ".join(item)),
        ("a", " ".join(["a0", *shared])),
        ("b", " ".join([*shared, "b0", *shared])),
    ]
    docs = spark.createDataFrame(
        [(1, " ".join(changed)), (2, " ".join(["x", *shared, "y"]))], "doc_id long, text string"
    )
    tests = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc: sorted(map(tuple, r.matches)) for r in D.benchmark_hits(docs, tests).collect()}
    assert found[1] == [("long", 0, 0, 50), ("long", 51, 51, 49)]
    assert found[2] == [("a", 1, 1, 20), ("b", 0, 1, 20), ("b", 21, 1, 20)]


def test_rows_are_judged_by_their_own_text(spark):
    bad, good = "a b c", "d e f"
    rows = [(None, bad), (None, good), (1, bad), (1, good), (2, good), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([("t", bad)], "item_id string, text string")
    clean = D.decontaminate(docs, tests)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(
        (row for row in rows if row[1] != bad), key=str
    )
