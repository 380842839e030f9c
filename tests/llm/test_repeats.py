from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import repeats
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES
from touchline.llm.suffixes import suffix_ranks


def brute(rows, span=100):
    """(bytes, removed, runs, kept) by id; rows are (order, text) in order."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - span + 1):
            piece = data[p : p + span]
            if piece in seen:
                gone[p : p + span] = True
            else:
                seen.add(piece)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), runs, kept))
    return out


def test_query_equals_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in QUERIES["op9_suffix_dedup"](spark, small).collect()}
    assert len(found) == len(docs)
    for doc, (size, removed, runs, kept) in zip(docs, brute(docs)):
        r = found[doc.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, removed, runs), doc.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def odd_texts():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(700))
    texts = ["", None, "x" * 99, "x" * 100, "y" * 700, "ab" * 400, passage]
    for _ in range(25):  # pieces of the passage between noise, with edits
        noise = "".join(rng.choice("stuvw ") for _ in range(rng.randrange(150)))
        a = rng.randrange(500)
        piece = passage[a : a + rng.randrange(60, 400)]
        cut = rng.randrange(len(piece))
        texts.append(noise + piece[:cut] + rng.choice(["", "Z", "中"]) + piece[cut:] + noise)
    return texts + [texts[9], texts[9], passage + passage]


@pytest.mark.parametrize("chunk, apart", [(1 << 20, 4_096), (150, 100)])
def test_odd_texts_equal_brute_force(spark, monkeypatch, chunk, apart):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "APART", apart)
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame([(i * 3, t, "d") for i, t in rows], "doc_id long, text string, d string")
    found = {r.doc: r for r in repeats.remove_repeats(docs.repartition(3)).collect()}
    assert len(found) == len(rows)
    for (i, _), (size, removed, runs, kept) in zip(rows, brute(rows)):
        r = found[i * 3]
        got = r.n_bytes, sum(x.stop - x.start for x in r.runs), len(r.runs), bytes(r.kept)
        assert got == (size, removed, runs, kept), i


def test_repeated_and_missing_ids(spark):
    text = "".join(random.Random(2).choices("abcdef", k=300))
    docs = spark.createDataFrame(
        [(4, text), (4, text), (None, text), (9, text + "tail")], "doc_id long, text string"
    )
    found = sorted((r.doc or 0, bytes(r.kept).decode()) for r in repeats.remove_repeats(docs).collect())
    assert found == [(0, text), (4, ""), (4, ""), (9, "tail")]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_ranks_equal_sorting(spark):
    rng = random.Random(8)
    strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    strings += [strings[0], [0] * 20, [1, 2] * 9]
    rows = [(7, s, i, c) for s, string in enumerate(strings) for i, c in enumerate(string)]
    df = spark.createDataFrame(rows, "d long, r long, i int, sym long")
    found = {(r.r, r.i): r["rank"] for r in suffix_ranks(df, 4, []).collect()}
    suffixes = {(s, i): strings[s][i:] for _, s, i, _ in rows}
    ordered = sorted(suffixes.values())
    assert found == {place: ordered.index(suffix) for place, suffix in suffixes.items()}


@pytest.mark.parametrize("ids", [range(40), range(-20, 20), range((1 << 31) - 20, (1 << 31) + 20)])
def test_ids_of_any_size_equal_brute_force(spark, ids):
    """The first of equal strings is the same whether an id and a place fit into one long or not."""
    rows = list(zip(ids, odd_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: r for r in repeats.remove_repeats(docs.repartition(3)).collect()}
    for (i, _), (size, _, runs, kept) in zip(rows, brute(rows)):
        assert (found[i].n_bytes, len(found[i].runs), bytes(found[i].kept)) == (size, runs, kept), i


def test_first_places_need_no_sorting(spark, plan_of):
    rows = spark.range(100).selectExpr("id AS d", "CAST(id AS INT) AS first", "id % 7 AS h1")
    low = rows.groupBy("h1").agg(F.min(repeats._place(rows)).alias("low"))
    assert "SortAggregate" not in plan_of(low)
    assert "shiftleft" not in str(repeats._place(rows.withColumn("d", F.col("d") - 1)))


def test_texts_lie_packed(spark):
    texts = repeats._bucketed(spark.createDataFrame([(1, "a" * 200)], "d long, text string"))
    assert all(".zstd." in name for name in texts.inputFiles())
