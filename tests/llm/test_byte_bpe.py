from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from touchline.llm import byte_bpe
from touchline.llm.frames import map_rows, slices, table
from touchline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(PATH),
        special_tokens={},
    )


def wanted(library, text):
    return np.array(library.encode_ordinary(text), dtype="<u4").tobytes()


def test_query_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    found = QUERIES["op4_byte_bpe"](spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = wanted(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts(library, monkeypatch):
    rng = random.Random(1)
    letters = "abc dhij AB.,!?\n\t  éüß中文字😀'sdont0129\x1c\x85  \r"
    texts = ["", " ", "a" * 900, "ab" * 800, "中文字" * 200, "😀" * 90, " " * 400 + "x"]
    texts += ["<|endoftext|>", "".join(rng.choice("etaoinshrdlu") for _ in range(2500))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(400)]
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "_DECODED", 100)
    tool = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        encoded = tool.encode(part)
        assert encoded == [wanted(library, text) for text in part]
        assert tool.decode(encoded) == [text.encode() for text in part]
    with pytest.raises(ValueError):
        tool.decode([np.array([50_300], "<u4").tobytes()])


def test_odd_rows(spark):
    rows = [(1, None, 3), (None, "some text", 4), (2, "", 5), (3, "some text", 6), (3, "some text", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = byte_bpe.encode_and_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc or 0, bytes(r.decoded)) for r in found) == sorted(
        (i or 0, (t or "").encode()) for i, t, _ in rows
    )
    empty = docs.limit(0)
    assert byte_bpe.encode_and_decode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_far_pieces_equal_the_library(library, monkeypatch):
    """Every piece by its changed places: runs, ties and pieces of one and two tokens."""
    monkeypatch.setattr(byte_bpe, "_FAR", 0)
    rng = random.Random(6)
    tool = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["a", "aa", "aaa", "a" * 4_097, "ab" * 501 + "b" * 77, "é" * 300 + "中" * 200]
    for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyzéß中", " -=\n"):
        texts += ["".join(rng.choices(letters, k=rng.randrange(1, 400))) for _ in range(60)]
    for text, ids in zip(texts, tool.encode(texts)):
        assert ids == wanted(library, text), repr(text[:40])


def test_pieces_of_a_megabyte_end_within_seconds(library):
    tool = byte_bpe.Codec(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(7)
    for text in ("a" * 1_000_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))):
        began = time.process_time()
        ids = tool.encode([text])[0]
        assert time.process_time() - began < 30
        assert ids == wanted(library, text)
        assert tool.decode([ids]) == [text.encode()]


class _Worker:
    """Takes what a stage would send to workers."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_worker_forgets_the_vocabulary_when_another_operator_works():
    """Idle workers would hold it beside the memory of later stages."""

    def own(batch):
        yield byte_bpe.codec(PATH, public_tokenizers.PATTERN) and batch

    def other(batch):
        yield batch

    own.__module__, other.__module__ = byte_bpe.__name__, "touchline.llm.simhash"
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
    for work, kept in ((own, 1), (own, 1), (other, 0)):
        assert list(map_rows(_Worker(), "n long", work)(iter([batch]))) == [batch]
        assert byte_bpe.codec.cache_info().currsize == kept


def test_texts_leave_arrow_a_few_at_a_time():
    column = pa.array(["ab", None, "cde", "f" * 9, "", "g"])
    assert list(slices(column, 5)) == [slice(0, 3), slice(3, 4), slice(4, 6)]
    assert list(slices(column[2:4], 100)) == [slice(0, 2)] and list(slices(column[:0], 5)) == []
