from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from touchline.llm import quality
from touchline.llm.frames import table
from touchline.llm.queries import QUERIES


def test_query_tells_good_from_bad_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality"](spark, sf_dir).collect()
    assert len(found) == table(spark, sf_dir, "documents").count()
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good, bad = [], []
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            (good if labels[r.doc_id] else bad).append(r.score)
    ranked = (np.array(good)[:, None] > np.array(bad)[None, :]).mean()
    assert ranked > 0.97
    assert (np.array(good) >= 0.7).mean() > 0.9 and (np.array(bad) < 0.7).mean() > 0.8


def test_held_out_labels_change_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    held = quality.held_out()
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 0, quality) AS quality"
    )
    models = [quality.learn(docs.where(~held), x.where(~held)) for x in (labels, flipped)]
    assert np.array_equal(models[0].weights, models[1].weights)


def test_prior_without_negative_labels():
    rng = np.random.default_rng(0)
    plus = rng.normal(1, 1, (2000, 5)).astype(np.float32)
    mixed = np.concatenate([rng.normal(1, 1, (2100, 5)), rng.normal(-3, 1, (900, 5))])
    model = quality.fit(plus, mixed.astype(np.float32))
    assert model.prior == pytest.approx(0.7, abs=0.08)
    assert (model.score(mixed[:2100]) >= 0.5).mean() > 0.9
    assert (model.score(mixed[2100:]) < 0.5).mean() > 0.9


def test_odd_rows(spark):
    rows = [(1, None, 3), (None, "text", 4), (2, "", 5), (3, "a\x00 b" * 20_000, 6), (3, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame(
        [(3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int"
    )
    assert quality.learn(docs, labels.limit(0)) is None
    model = quality.learn(docs, labels)
    found = quality.scores(docs, model).collect()
    assert sorted(r.doc or 0 for r in found) == [0, 1, 2, 3, 3]
    assert {r.score for r in quality.scores(docs, None).collect()} == {0.5}
    assert quality.scores(docs.limit(0), model).count() == 0
    assert quality.learn(docs.limit(0), labels) is None


def test_risk_equals_its_definition():
    """Both parts by plain loops, their gradients by small steps."""
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(0.5, 1, (40, 4)), rng.normal(0, 1, (60, 4))
    loss = lambda z: math.log(1 + math.exp(-z))

    def parts(w):
        plus = [sum(a * b for a, b in zip(row, w)) for row in xp]
        free = [sum(a * b for a, b in zip(row, w)) for row in xu]
        missed = 0.6 * sum(map(loss, plus)) / len(plus)
        wrong = sum(loss(-z) for z in free) / len(free) - 0.6 * sum(loss(-z) for z in plus) / len(plus)
        return missed, wrong

    for scale in (0.1, 1, 5):
        w = rng.normal(0, scale, 4)
        missed, negative, up, down = quality.risk(w, xp, xu, 0.6)
        assert (missed, negative) == pytest.approx(parts(w))
        for k in range(4):
            step = np.eye(4)[k] * 1e-6
            after, before = parts(w + step), parts(w - step)
            assert up[k] == pytest.approx((after[0] - before[0]) / 2e-6, abs=1e-5)
            assert down[k] == pytest.approx((after[1] - before[1]) / 2e-6, abs=1e-5)


def test_trusted_negatives_teach_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    bad = labels.where("quality = 0").select("doc_id")
    without = docs.join(bad, "doc_id", "left_anti")
    models = [quality.learn(docs, labels), quality.learn(without, labels.where("quality = 1"))]
    assert np.allclose(models[0].weights, models[1].weights)
    assert models[0].prior == pytest.approx(models[1].prior)


def test_samples_are_bounded(spark, monkeypatch):
    """An id that very many rows share brings no more than twice the sample to the driver."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior, steps=9))
    docs = spark.range(3_000).selectExpr("if(id < 2500, 1, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1), (2_600, 1)], "doc_id long, quality int")
    quality.learn(docs, labels, positives=100, unlabelled=50)
    assert seen[0][0] == 200 and 20 <= seen[0][1] <= 100
