"""Quality scores by positive-unlabelled learning with a non-negative risk estimate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import fold, map_rows, raw
from touchline.session import stage

#: Labelled positives, about, that the classifier is fitted on at most, and unlabelled rows: so
#: many at up to a hundred thousand documents, and more with the cube root of their number.
POSITIVES = 8_000
UNLABELLED, UNLABELLED_OF = 16_000, 100_000
#: Score from which a text is predicted to be good.
THRESHOLD = 0.7

_CLASSES = np.full(256, 7, dtype=np.uint8)  # bytes above ASCII
for _kind, _members in enumerate(
    (b" \t\v\f\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"-()")
):
    _CLASSES[list(_members)] = _kind
_CLASSES[[c for c in range(128) if _CLASSES[c] == 7]] = 6  # other marks and controls
_N_CLASSES = 8
_SHAPE = 9  # features of words and lines
FEATURES = 256 + _N_CLASSES**2 + _SHAPE


def features(text: bytes) -> np.ndarray:
    """Shares of bytes and of neighbouring byte classes, and a few shares of words and lines."""
    out = np.zeros(FEATURES, dtype=np.float32)
    if not text:
        return out
    data = np.frombuffer(text, dtype=np.uint8)
    out[:256] = np.bincount(data, minlength=256) / len(data)
    kinds = _CLASSES[data].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * _N_CLASSES + kinds[1:], minlength=_N_CLASSES**2)
    out[256 : 256 + _N_CLASSES**2] = pairs / len(data)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n, m = max(1, len(words)), max(1, len(lines))
    out[-_SHAPE:] = (
        np.log1p(len(data)),
        np.log1p(len(words)),
        sizes.sum() / n,
        np.sqrt(sizes.var()) if len(words) else 0.0,
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(lines)) / m,
        np.log1p(len(data) / m),
        1.0,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return _sigmoid(z)


def mass_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores alone: no set can be rarer among all than its share of positives.

    The least ratio of unlabelled to positive mass above a score, over scores that three tenths
    of the positives exceed.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.7, 36))
    above = lambda values: (values[None, :] >= cuts[:, None]).mean(axis=1)
    return float(np.clip((above(unlabelled) / above(positive)).min(), 0.05, 0.99))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float | None = None,
    steps: int = 1_500,
    batch: int = 1_024,
    rate: float = 0.02,
    decay: float = 1e-3,
    seed: int = 7,
) -> Model:
    """Minimises the non-negative positive-unlabelled risk of a linear model by Adam.

    Where the second part of the risk of a batch (see ``risk``) is negative, its gradient is
    reversed. Without a ``prior`` a model that tells positives from unlabelled rows is fitted first,
    and the prior comes from the masses of its scores.
    """
    everything = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = ((rows - mean) / scale for rows in (positive, unlabelled))
    p, u = (np.clip(rows, -8, 8).astype(np.float32) for rows in (p, u))
    rng = np.random.default_rng(seed)
    if prior is None:
        # Fitted on one half and measured on the other, or the masses would favour positives.
        half = _descend(p[::2], u[::2], None, steps // 5, batch, rate, 50 * decay, rng)
        prior = mass_prior(*(rows[1::2] @ half[0] + half[1] for rows in (p, u)))
    weights, bias = _descend(p, u, prior, steps, batch, rate, decay, rng)
    return Model(mean, scale, weights, bias, prior)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(weights: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple:
    """The two parts of the non-negative risk and their gradients, for rows that end with a one.

    ``prior * E+[loss(z)]`` and ``Eu[loss(-z)] - prior * E+[loss(-z)]`` with the logistic loss; the
    risk is the first and what the second exceeds zero by.
    """
    zp, zu = xp @ weights, xu @ weights
    # Gradients of loss(z) are -sigmoid(-z), of loss(-z) sigmoid(z).
    missed = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    slope = _sigmoid(zu) @ xu / len(xu) - prior * (_sigmoid(zp) @ xp) / len(xp)
    return missed, negative, -prior * (_sigmoid(-zp) @ xp) / len(xp), slope


def _descend(p, u, prior, steps, batch, rate, decay, rng) -> tuple[np.ndarray, float]:
    weights = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    mean = np.zeros_like(weights)
    for step in range(1, steps + 1):
        xp = p[rng.integers(0, len(p), min(batch, len(p)))]
        xu = u[rng.integers(0, len(u), min(batch, len(u)))]
        xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (xp, xu))
        if prior is None:
            gradient = -_sigmoid(-(xp @ weights)) @ xp / len(xp) + _sigmoid(xu @ weights) @ xu / len(xu)
        else:
            _, negative, up, down = risk(weights, xp, xu, prior)
            gradient = up + down if negative >= 0 else -down
        gradient[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        unbiased = first / (1 - 0.9**step), second / (1 - 0.999**step)
        weights -= rate * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-8)
        if step > steps // 2:
            mean += weights / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def _vectors(rows: DataFrame) -> np.ndarray:
    """Features of the bounded sample ``rows`` (text), on the driver."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [features(text).tobytes() for text in raw(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["v"])

    found = [bytes(r.v) for r in map_rows(rows, "v binary", work).collect()]
    return np.frombuffer(b"".join(found), dtype=np.float32).reshape(-1, FEATURES)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> Model | None:
    """A model from labelled positives and rows without a label; ``None`` if either is missing.

    Labelled negatives teach nothing: the class prior is estimated from the positives and the
    unlabelled rows too, unless it is given. Both are samples of ids, drawn where a hash of the id falls below
    their share, so that each task sends its part of them; rows that repeat an id count as they come, up
    to twice the sample. Without unlabelled rows the labelled ones stand in, their labels unread.
    """
    marks = (
        labels.select(F.col(id_col).alias("doc"), F.col(quality_col).cast("double").alias("good"))
        .where("doc IS NOT NULL AND good IS NOT NULL")
        .groupBy("doc")
        .agg(F.avg("good").alias("good"))
    )
    ids = docs.select(F.col(id_col).alias("doc")).where("doc IS NOT NULL").distinct()
    known = stage(ids.join(marks, "doc", "left"), "known")
    plus_n, free_n, all_n = known.agg(
        F.count_if(F.col("good") >= 0.5), F.count_if(F.col("good").isNull()), F.count("*")
    ).first()
    unlabelled = round(unlabelled * max(1.0, all_n / UNLABELLED_OF) ** (1 / 3))

    def sample(rows: DataFrame, count: int, most: int) -> np.ndarray:
        share = min(1.0, most / max(1, count))
        place = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
        drawn = rows.where(place < round(share * (1 << 30))).select(F.col("doc").alias(id_col))
        texts = docs.join(F.broadcast(drawn), id_col, "left_semi")  # about ``most`` ids
        return _vectors(texts.select(F.col(text_col).alias("text")).limit(2 * most))

    plus = sample(known.where("good >= 0.5"), plus_n, positives)
    if free_n:
        rest = sample(known.where("good IS NULL"), free_n, unlabelled)
    else:
        rest = sample(known, all_n, unlabelled)
    if not len(plus) or not len(rest):
        return None
    return fit(plus, rest, prior)


def scores(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, score) for every row of ``docs``: the chance that its whole text is good.

    NULL and empty texts get the score of a text without any features; without a model every
    score is 0.5. A NULL id stays, repeated rows give repeated results, an empty table no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = raw(batch.column(1))
        if shared.value is None:
            found = np.full(len(texts), 0.5)
        else:
            rows = np.stack([features(text) for text in texts])
            found = shared.value.score(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc long, score double", work)


def held_out(column: str = "doc_id"):
    """The quarter of the ids whose labels are only for measuring."""
    return F.coalesce(fold(column, 4) == 2, F.lit(False))
