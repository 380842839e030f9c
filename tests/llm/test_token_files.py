from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import token_files as T
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, rows):
    start = 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_query_equals_the_library(spark, small, library):
    docs = table(spark, small, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    found = QUERIES["op5_token_files"](spark, small).collect()
    assert sorted(map(tuple, found)) == list(wanted(library, docs))


def test_pieces_equal_whole_texts(library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 40)
    rng = random.Random(4)
    letters = "abc dhij AB.,!?\n\t  éüß中文字😀'sdont0129\x1c\x85   \r"
    texts = ["", " ", "\n" * 50, "a<|endoftext|>b <|endoftext|>", "x" * 900]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(800)]
    tool, whole = T.Encoder(PATH, public_tokenizers.PATTERN), T.Encoder(PATH)
    for start in range(0, len(texts), 90):
        part = texts[start : start + 90]
        for text, ids in zip(part, tool.encode(part)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert whole.encode(texts[:3])[2].tolist() == library.encode(texts[2]).ids


def test_grammar_gives_back_every_range(monkeypatch):
    monkeypatch.setattr(T, "FREQUENT", 2)
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 6, n).astype("<u4") for n in (0, 1, 2, 300, 77)]
    documents += [np.zeros(201, dtype="<u4"), np.tile(np.arange(3, dtype="<u4"), 60)]
    row = dict(zip(T._NAMES, T._row(0, 0, [*range(7)], documents, 10)))
    assert len(row["sequence"]) < sum(map(len, documents))
    shard = T.Shard(row)
    for k, (ids, found) in enumerate(zip(documents, shard.documents())):
        assert ids.tolist() == found.tolist()
        for start in range(0, len(ids), 7):
            for stop in range(start + 1, len(ids) + 1, 31):
                assert shard.tokens(k, start, stop).tolist() == ids[start:stop].tolist()


def test_odd_rows_and_small_shards(spark, tmp_path, library):
    rows = [(7, "seven " * 40), (None, "no id"), (3, None), (-2, ""), (5, "five"), (5, "five")]
    rows += [(100 + i, f"text number {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start")
    path = str(tmp_path / "tokens")
    T.write_tokens(docs.repartition(3), path, PATH, shard_tokens=30)
    found = T.read_tokens(spark, path).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((r.start, r.doc, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found)
    assert got == [(s, d, n, c) for d, s, n, c in wanted(library, rows)]
    assert spark.read.parquet(path).count() > 5


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    T.write_tokens(docs, str(tmp_path / "none"), PATH)
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_copies_of_a_passage_fold_into_few_symbols():
    passage = np.arange(1_000, dtype="<u4")
    symbols, rules, _ = T.compress([passage] * 200, 50_000)
    assert max(map(len, symbols)) <= 2 and len(rules) < 1_100
