from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import lm
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_and_held_out_gain(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs}
    counts = Counter(t for r in docs if not held[r.doc_id] for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in QUERIES["op6_language_model"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    gains = []
    for doc in docs:
        r, own = found[doc.doc_id], tokens(doc.text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        assert r.held_out == held[doc.doc_id]
        assert (r.n_tokens, r.train_tokens) == (len(own), total)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            gains.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gains) > 0.01


def small_vocabulary(words=300, rest=50):
    counts = {b"w%d" % i: 1000 // (i + 1) + 1 for i in range(words)}
    ids = {w: i + 2 for i, w in enumerate(counts)}
    own = np.zeros(lm.WORDS)
    own[1], own[2 : 2 + words] = 20, list(counts.values())
    unigram = own + 0.5
    unigram[2 + words :] = 1e-9
    unigram[0] = rest + 0.5 * 11
    total = int(own.sum()) + rest
    return lm.Vocabulary(
        ids, counts | {b"": 20}, total, words + 11, rest, 10, unigram / unigram.sum()
    )


def test_probabilities_sum_to_one_and_begin_at_the_unigram():
    vocab = small_vocabulary()
    model = lm.Model(vocab.unigram)
    model.parts["mix"] *= 0
    every = np.arange(lm.WORDS)
    before = np.tile(np.array([[5, 1, 0]]), (lm.WORDS, 1))
    assert np.allclose(10 ** model.log_probabilities(every, before), vocab.unigram, rtol=1e-4)
    model = lm.Model(vocab.unigram)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 302, 20_000)
    lm.Trainer(model, 0.1, 1).run(ids, rng.integers(0, 302, (20_000, lm.CONTEXT)))
    assert (10 ** model.log_probabilities(every, before)).sum() == pytest.approx(1, abs=1e-4)


def test_learns_what_follows():
    vocab = small_vocabulary()
    ids = np.tile(np.array([5, 9, 40, 7]), 20_000)
    before = np.stack([np.roll(ids, k + 1) for k in range(lm.CONTEXT)], axis=1)
    model = lm.Model(vocab.unigram)
    trainer = lm.Trainer(model, 0.1, 1)
    for _ in range(3):
        trainer.run(ids, before)
    assert model.log_probabilities(ids[10:14], before[10:14]).mean() > -0.3


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 5)
    rows = [(i, f"the cat {'rare' + str(i % 7)} sat on THE mat") for i in range(40)]
    rows += [(50, None), (51, ""), (None, "the unseen"), (52, "word " * 30_000), (52, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n")
    train = docs.where("doc_id < 45")
    found = lm.scores(docs, train).collect()
    counts = Counter(t for i, text in rows if i is not None and i < 45 for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    wanted = sorted(
        (
            i or -1,
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            round(sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1)))
                      for t in tokens(text)), 4),
        )
        for i, text in rows
    )
    assert sorted((r.doc or -1, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == wanted


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.scores(docs.limit(0), docs).count() == 0
    r = lm.scores(docs, docs.limit(0)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.base_score == pytest.approx(3 * math.log10(0.5 / 0.5))
    assert r.score < 0


def test_places_grow_and_every_word_has_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3_000)
    n = {b"w%d" % i: 1 + 40_000 // (i + 1) for i in range(20_000)}
    rows = [(bytearray(w), k) for w, k in [*n.items(), (b"", 700)]]
    vocab = lm.vocabulary(spark.createDataFrame(rows, "word binary, n long"))
    size = len(vocab.unigram)
    assert lm.WORDS < size == lm.places(20_001) < lm.places(10**6) < lm.places(10**8)
    at = {w: vocab.ids[w] for w in n}
    assert len(vocab.ids) < len(set(at.values())) > lm.WORDS  # looking up adds nothing
    members = {}
    for w, i in at.items():
        members.setdefault(i, []).append(n[w] + 0.5)
    for i, own in members.items():
        alone = 2 <= i < 2 + len(vocab.ids)
        assert vocab.sums[i] == (1 if alone else pytest.approx(sum(own) + 0.5))
        assert not alone or len(own) == 1
    weights = vocab.unigram / vocab.unigram[1] * 700.5
    shared = size - 1 - len(vocab.ids)
    assert weights.sum() == pytest.approx(sum(n.values()) + 700 + 0.5 * (20_001 + shared))


def test_words_share_their_place_by_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 300)
    kept = []

    def untrained(docs, vocab):
        model = lm.Model(vocab.unigram)
        model.parts["mix"] *= 0
        kept.append(vocab)
        return model

    monkeypatch.setattr(lm, "train", untrained)
    rows = [(i, " ".join(f"w{j * j % (i + 2)}x{i % 90}" for j in range(60))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, "unseen w1x1 words")], "doc_id long, text string")
    found = lm.scores(docs, docs.where("doc_id < 900")).collect()
    counts = Counter(t for _, text in rows for t in tokens(text))
    vocab = kept[0]
    shared = len(vocab.unigram) - 1 - len(vocab.ids)
    assert len(vocab.ids) < len(counts) - 1 and shared > 1
    mass = sum(counts.values()) + 0.5 * (len(counts) + shared)
    texts = dict([*rows, (900, "unseen w1x1 words")])
    for r in found:
        wanted = sum(math.log10((counts[t] + 0.5) / mass) for t in tokens(texts[r.doc]))
        assert r.score == pytest.approx(wanted, rel=1e-4)
