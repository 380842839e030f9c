"""Text scores from a log-bilinear language model trained by noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import fold, map_rows, raw
from touchline.session import stage

#: Places of the smallest vocabulary, and places per square root of the distinct words of others.
WORDS = 16**3
GROWTH = 64
#: Words before a token that predict it, and the size of their vectors.
CONTEXT = 3
DIM = 16
#: Most frequent words whose counts travel to the tasks; the counts of others are joined.
KNOWN = 200_000
#: Documents, about, and tokens, at most, the model is first fitted on, on the driver, before every shard trains on
#: all of its tokens. Documents of more than so many bytes wait for the shards.
FIRST_DOCS = 1_500
FIRST_TOKENS = 400_000
FIRST_BYTES = 200_000
_BINS = 50  # of counts, per natural logarithm
_REST, _END = 0, 1
_BATCH = 8_192
_NOISE = 16  # noise classes of a batch
_NOISE_WORDS = 2  # noise groups and noise words of a token
_DRAWS = 512  # entries of a class or group, at least, from which its noise is drawn
_FAN = 64  # models averaged by one task
_PART = 4_096  # rows of a table that travel together
#: Tokens of a shard for each place of the model, so that models stay smaller than the texts;
#: and shards that a small input may have all the same.
_SHARD_WORDS, _LEAST_SHARDS = 32, 8


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs`` (text); the end of a text is the empty word."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for text in raw(batch.column(0)):
            found.update(tokens(text))
            found[b""] += 1
        columns = [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    return map_rows(docs.select("text"), "word binary, n long", work).groupBy("word").agg(
        F.sum("n").alias("n")
    )


class Places(dict):
    """Place of each word in the model: frequent words have their own, every other word one of
    ``shared``, by its hash. Place 0 is the first of the shared ones, place 1 the end of a text."""

    shared = 1

    def __missing__(self, word: bytes) -> int:
        slot = zlib.crc32(word) % self.shared
        return slot and slot + 1 + len(self)


@dataclass
class Vocabulary:
    """Places of words, counts of the known words, and totals over all words."""

    ids: dict[bytes, int]
    counts: dict[bytes, int]
    total: int
    distinct: int
    rest_total: int
    rest_distinct: int
    unigram: np.ndarray
    #: Of each place: counts plus one half of the words that share it, one of them unseen; an own
    #: place has one.
    sums: np.ndarray | None = None

    @property
    def base_sum(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def places(distinct: int) -> int:
    """Places of the model, a cube that grows with the distinct words."""
    side = 16
    while side**3 < max(WORDS, GROWTH * distinct**0.5):
        side += 1
    return side**3


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects ``KNOWN`` words at most; of the rest only sums by shared place.

    A histogram of counts tells from which count on all words fit, so that tasks send these words
    and no others: sorting with a limit would send that many words from every task.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where("word <> X''").withColumn("bin", F.floor(F.log("n") * _BINS))
    bins = words.groupBy("bin").count().orderBy(F.desc("bin")).collect()
    sizes = np.cumsum([r["count"] for r in bins])
    fitting = int((sizes <= KNOWN).sum())
    lowest = bins[fitting - 1].bin if fitting else None
    frequent = words.where(F.col("bin") >= lowest).collect() if fitting else []
    known = {bytes(r.word): r.n for r in sorted(frequent, key=lambda r: (-r.n, bytes(r.word)))}
    end = (counts.where("word = X''").first() or (b"", 0))[1]
    size = places(distinct)
    whole = distinct - (end > 0) == len(known) <= size - 2
    ids = Places((w, i) for i, w in enumerate(list(known)[: None if whole else size // 2], start=2))
    ids.shared = 1 if whole else size - 1 - len(ids)
    own = np.zeros(size)
    own[_END] = end
    for word, i in ids.items():
        own[i] = known[word]
    named = len(ids) + (end > 0)
    rest = total - int(own.sum()), distinct - named
    # All words by their hash, less those with a place of their own.
    hashed = words.groupBy(F.pmod(F.crc32("word"), F.lit(ids.shared)).alias("slot")).agg(
        F.sum("n").alias("n"), F.count("*").alias("words")
    )
    table = hashed.toArrow()
    masses = np.full(ids.shared, 0.5)
    masses[table["slot"].to_numpy()] += table["n"].to_numpy() + 0.5 * table["words"].to_numpy()
    for word in ids:
        masses[zlib.crc32(word) % ids.shared] -= known[word] + 0.5
    shared = np.concatenate([[_REST], np.arange(ids.shared - 1) + 2 + len(ids)])
    unigram = own + 0.5
    unigram[2 + len(ids) :] = 1e-9  # places without a word
    unigram[shared] = masses
    sums = np.ones(size)
    sums[shared] = masses
    return Vocabulary(
        ids, known | {b"": end}, total, distinct, *rest, unigram / unigram.sum(), sums
    )


class Model:
    """Class, group within class and word within group from a linear prediction of the next
    word's vector; each has as many members as there are classes."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        near, size = 0.1, len(unigram)
        self.side = side = round(size ** (1 / 3))
        assert side**3 == size
        self.parts = {
            "context": rng.normal(0, near, (size, DIM)),
            "mix": np.stack([np.eye(DIM) / (k + 1) for k in range(CONTEXT)]),
            "classes": rng.normal(0, near, (side, DIM)),
            "groups": rng.normal(0, near, (side**2, DIM)),
            "words": rng.normal(0, near, (size, DIM)),
        }
        # Logarithms of shares within the parent, as the estimates of each factor expect them.
        for name, width in (("classes", side**2), ("groups", side), ("words", 1)):
            share = unigram.reshape(-1, side, width).sum(axis=2)
            self.parts[name + "_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).ravel()
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}
        self.parts["mix"] *= 0.1  # near the unigram at first
        self.unigram = unigram

    def copy(self) -> Model:
        other = object.__new__(Model)
        other.side, other.unigram = self.side, self.unigram
        other.parts = {k: v.copy() for k, v in self.parts.items()}
        return other

    def log_probabilities(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each id after its ``before`` (n, CONTEXT) ids."""
        p, side = self.parts, self.side
        # Tokens in the order of their places, so that one product serves all of a class or group.
        order = np.argsort(ids, kind="stable")
        own, past = ids[order], before[order]
        guess = np.empty((DIM, len(own)), dtype=np.float32)
        for start in range(0, len(own), 8_192):
            part = slice(start, start + 8_192)
            guess[:, part] = sum(p["context"][past[part, k]] @ p["mix"][k] for k in range(CONTEXT)).T
        found = np.zeros(len(own))
        for name, width in (("classes", side**2), ("groups", side), ("words", 1)):
            table, bias = p[name], p[name + "_bias"][:, None]
            nodes = own // width
            parents = nodes // side
            starts = np.flatnonzero(np.diff(parents, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
                first = int(parents[a]) * side
                members = slice(first, first + side)
                for start in range(a, b, 8_192):
                    part = slice(start, min(start + 8_192, b))
                    scores = table[members] @ guess[:, part] + bias[members]
                    found[part] += _log_softmax(scores, nodes[part] - first)
        out = np.empty(len(ids))
        out[order] = found / np.log(10)
        return out


def _log_softmax(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log probability of the row ``at`` of each column."""
    scores -= scores.max(axis=0)
    chosen = scores[at, np.arange(len(at))].astype(np.float64)
    return chosen - np.log(np.exp(scores, out=scores).sum(axis=0).astype(np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, where each begins in sorted order, and that order."""
    keys = np.sort(ids.astype(np.int64) << 32 | np.arange(len(ids)))
    own, order = keys >> 32, keys & 0xFFFFFFFF
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    return own[starts], starts, order


class Trainer:
    """Adagrad on noise-contrastive estimates of the three factors, a batch of tokens at a time."""

    def __init__(self, model: Model, rate: float, seed: int):
        self.model, self.rate = model, rate
        self.squares = {k: np.full_like(v, 1e-2) for k, v in model.parts.items()}
        self.rng = np.random.default_rng(seed)
        side = model.side
        self.class_share = model.unigram.reshape(side, -1).sum(axis=1)
        self.class_odds = np.log(_NOISE * self.class_share).astype(np.float32)
        # Noise comes from a row of entries per class or group; each member has one or more.
        self.drawn, self.odds = {}, {}
        draws = max(_DRAWS, 8 * side)
        members = np.arange(side, dtype=np.uint16)
        for name, table in (
            ("groups", model.unigram.reshape(-1, side).sum(axis=1).reshape(side, side)),
            ("words", model.unigram.reshape(-1, side)),
        ):
            share = table / table.sum(axis=1, keepdims=True)
            entries = 1 + np.floor(share * (draws - side)).astype(np.int64)
            entries[np.arange(len(share)), share.argmax(axis=1)] += draws - entries.sum(axis=1)
            self.drawn[name] = np.stack([np.repeat(members, own) for own in entries])
            self.odds[name] = np.log(_NOISE_WORDS * entries.ravel() / draws).astype(np.float32)

    def step(self, ids: np.ndarray, before: np.ndarray) -> None:
        p, n, side = self.model.parts, len(ids), self.model.side
        past = [p["context"][before[:, k]] for k in range(CONTEXT)]
        guess = sum(past[k] @ p["mix"][k] for k in range(CONTEXT))
        groups = ids // side
        kinds = groups // side
        # Which class: the true one against noise classes that the batch shares.
        noise = self.rng.choice(side, _NOISE, p=self.class_share)
        odds = p["classes_bias"] - self.class_odds
        true = np.einsum("nd,nd->n", guess, p["classes"][kinds]) + odds[kinds]
        fake = guess @ p["classes"][noise].T + odds[noise]
        g_true, g_fake = _sigmoid(true) - 1, _sigmoid(fake)
        d_guess = g_true[:, None] * p["classes"][kinds] + g_fake @ p["classes"][noise]
        moved = np.zeros((side, DIM + 1), dtype=np.float32)
        chosen = np.zeros((side, n), dtype=np.float32)
        chosen[kinds, np.arange(n)] = g_true
        np.add.at(chosen, noise, g_fake.T)
        moved[:, :DIM], moved[:, DIM] = chosen @ guess, chosen.sum(axis=1)
        # Which group of the class and word of the group: the true one against noise of the same.
        found = []
        for name, own in (("groups", groups), ("words", ids)):
            parents = own // side
            drawn = self.drawn[name]
            draws = self.rng.integers(0, drawn.shape[1], (n, _NOISE_WORDS))
            members = parents[:, None] * side + drawn[parents[:, None], draws]
            nodes = np.column_stack([own, members])
            vectors = p[name][nodes]
            odds = p[name + "_bias"][nodes] - self.odds[name][nodes]
            g = _sigmoid(np.einsum("nkd,nd->nk", vectors, guess) + odds)
            g[:, 0] -= 1
            d_guess += np.einsum("nk,nkd->nd", g, vectors)
            found.append((name, nodes.ravel(), g.ravel()))
        d_mix = np.stack([past[k].T @ d_guess for k in range(CONTEXT)])
        back = [d_guess @ p["mix"][k].T for k in range(CONTEXT)]
        every = np.arange(side)
        self._move(every, n, classes=moved[:, :DIM], classes_bias=moved[:, DIM])
        for name, nodes, weights in found:
            rows, starts, order = _runs(nodes)
            weights = weights[order]
            vectors = guess[order // (_NOISE_WORDS + 1)] * weights[:, None]
            vectors, biases = np.add.reduceat(vectors, starts), np.add.reduceat(weights, starts)
            self._move(rows, n, **{name: vectors, name + "_bias": biases})
        rows, starts, order = _runs(before.T.ravel())
        self._move(rows, n, context=np.add.reduceat(np.concatenate(back)[order], starts))
        self._move(np.arange(CONTEXT), n, mix=d_mix)

    def _move(self, rows: np.ndarray, n: int, **gradients: np.ndarray) -> None:
        """Moves the rows of tables by their gradients; others stay."""
        for name, values in gradients.items():
            gradient = values * np.float32(_BATCH**0.5 / n)
            squares = self.squares[name][rows] + gradient**2
            self.squares[name][rows] = squares
            self.model.parts[name][rows] -= np.float32(self.rate) * gradient / np.sqrt(squares)

    def run(self, ids: np.ndarray, before: np.ndarray) -> None:
        for start in range(0, len(ids), _BATCH):
            self.step(ids[start : start + _BATCH], before[start : start + _BATCH])


def _sequences(texts: list[list[bytes]], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, ends included, and the ids before each; a text begins after ends."""
    get, flat = ids.__getitem__, []
    for words in texts:
        flat += [_END] * CONTEXT
        flat += map(get, words)
        flat.append(_END)
    whole = np.array(flat, dtype=np.int32)
    sizes = np.array([CONTEXT + len(words) + 1 for words in texts])
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(whole), dtype=bool)
    for k in range(CONTEXT):
        real[starts + k] = False
    at = np.flatnonzero(real)
    return whole[at], np.stack([whole[at - k - 1] for k in range(CONTEXT)], axis=1)


def _groups(column: pa.Array, size: int = 100_000) -> Iterator[list[list[bytes]]]:
    """Tokens of texts in groups of about ``size`` tokens; few texts leave Arrow at a time."""
    held, count = [], 0
    for start in range(0, len(column), 100):
        for text in raw(column[start : start + 100]):
            words = tokens(text)
            held.append(words)
            count += len(words)
            if count >= size:
                yield held
                held, count = [], 0
    if held:
        yield held


def _first_fit(docs: DataFrame, vocab: Vocabulary) -> Model:
    """A model fitted on a sample of about ``FIRST_DOCS`` of ``docs`` (doc, text).

    A row is drawn if the hash of its id and text falls below the share that the sample is of all
    rows, so that no task sends more than its part.
    """
    model = Model(vocab.unigram)
    share = min(1.0, FIRST_DOCS / max(1, vocab.counts[b""]))
    drawn = (
        docs.where(F.octet_length("text") <= FIRST_BYTES)
        .where(F.pmod(F.xxhash64("doc", "text"), F.lit(1 << 30)) < round(share * (1 << 30)))
        .select("text")
        .collect()
    )
    drawn.sort(key=lambda r: zlib.crc32(r.text.encode()))  # whatever the order of partitions
    texts = [tokens(r.text.encode()) for r in drawn]
    if not texts:
        return model
    ids, before = (column[:FIRST_TOKENS] for column in _sequences(texts, vocab.ids))
    trainer = Trainer(model, rate=0.1, seed=11)
    rng = np.random.default_rng(12)
    for _ in range(6):
        order = rng.permutation(len(ids))
        trainer.run(ids[order], before[order])
    return model


def _moved(old: Model, new: Model) -> Iterator[tuple]:
    """(table, part, rows, values) of the rows in which the models differ."""
    for k, (name, before) in enumerate(old.parts.items()):
        before = before.reshape(len(before), -1)
        after = new.parts[name].reshape(before.shape)
        rows = np.flatnonzero((before != after).any(axis=1))
        cuts = np.searchsorted(rows, np.arange(0, len(before) + _PART, _PART))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            own = rows[cuts[part] : cuts[part + 1]]
            yield k, part, own, after[own]


def _average(key: tuple, table: pa.Table) -> pa.Table:
    """Each row of a part as the mean of the shards that moved it, by their tokens."""
    read = lambda name, kind: [np.frombuffer(v, kind) for v in table[name].to_pylist()]
    rows, weights = read("ids", np.int32), read("n", np.float64)
    every = np.unique(np.concatenate(rows))
    values = read("v", np.float32)
    sums = np.zeros((len(every), len(values[0]) // len(rows[0])))
    total = np.zeros(len(every))
    for own, n, v in zip(rows, weights, values):
        at = np.searchsorted(every, own)
        sums[at] += n[:, None] * v.reshape(len(own), -1)
        total[at] += n
    mean = (sums / total[:, None]).astype(np.float32)
    return pa.table(
        {
            "shard": [key[0].as_py()],
            "tab": pa.array([key[1].as_py()], pa.int32()),
            "part": pa.array([key[2].as_py()], pa.int32()),
            "ids": pa.array([every.astype(np.int32).tobytes()], pa.binary()),
            "n": pa.array([total.tobytes()], pa.binary()),
            "v": pa.array([mean.tobytes()], pa.binary()),
        }
    )


def train(docs: DataFrame, vocab: Vocabulary) -> Model:
    """Every shard of ``docs`` (doc, text), one or more partitions, trains the first model on all
    its tokens; the rows they moved are averaged by their tokens, ``_FAN`` models at a time, until
    one is left."""
    model = _first_fit(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab.ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        first, ids = shared.value
        own = first.copy()
        trainer, count = Trainer(own, rate=0.03, seed=shard), 0
        for batch in batches:
            for texts in _groups(batch.column(0)):
                found, before = _sequences(texts, ids)
                order = trainer.rng.permutation(len(found))
                trainer.run(found[order], before[order])
                count += len(found)
        for k, part, rows, values in _moved(first, own) if count else ():
            columns = [
                pa.array([shard], pa.int64()),
                pa.array([k], pa.int32()),
                pa.array([part], pa.int32()),
                pa.array([rows.astype(np.int32).tobytes()], pa.binary()),
                pa.array([np.full(len(rows), count, dtype=np.float64).tobytes()], pa.binary()),
                pa.array([values.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "tab", "part", "ids", "n", "v"])

    schema = "shard long, tab int, part int, ids binary, n binary, v binary"
    shards = max(_LEAST_SHARDS, vocab.total // (_SHARD_WORDS * len(vocab.unigram)))
    models = stage(docs.select("text").coalesce(shards).mapInArrow(run, schema), "models")
    shared.destroy()  # workers drop it before they take the trained model
    last = models.agg(F.max("shard")).first()[0]
    while last:  # shards fold into groups, and groups into one
        grouped = models.withColumn("shard", F.expr(f"shard DIV {_FAN}"))
        models = stage(
            grouped.groupBy("shard", "tab", "part").applyInArrow(_average, schema), "models"
        )
        last //= _FAN
    names = list(model.parts)
    for r in models.select("tab", "ids", "v").toArrow().to_pylist():
        whole = model.parts[names[r["tab"]]]
        rows = np.frombuffer(r["ids"], np.int32)
        whole[rows] = np.frombuffer(r["v"], np.float32).reshape(len(rows), *whole.shape[1:])
    return model


def scores(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are lower-cased words and an end. ``base_score`` is the log10 probability of the text
    under counts of all tokens of ``training`` plus one half, ``score`` that of the model: words
    without a place of their own share that of their hash by their counts, and a word that
    training lacks counts as one unseen word of its place, so probabilities sum to one.

    NULL and empty texts are an end alone; a NULL id stays; repeated rows give repeated results;
    an empty table gives no rows, and without training every token has probability one or the
    model's of the rest; other columns are not read.
    """
    learn = training.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counts = stage(word_counts(learn), "counts")
    vocab = vocabulary(counts)
    model = train(learn, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))
    kinds = "doc long, key long, n_tokens long, n_known long, base double, score double"
    schema = f"{kinds}, words array<binary>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            done = 0
            for texts in _groups(batch.column(1)):
                out = _score(texts, model, vocab)
                n = len(texts)
                keys = pa.array(np.arange(key, key + n))
                columns = [batch.column(0)[done : done + n], keys, *out]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                done, key = done + n, key + n

    chosen = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    partial = stage(chosen.mapInArrow(run, schema), "partial")
    # Words beyond the known ones: none is frequent, so no word gathers many rows.
    rare = partial.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "key", F.col("w.words").alias("word"), F.col("w.times").alias("times")
    )
    counted = rare.join(counts, "word", "left").select(
        "key", "times", F.coalesce("n", F.lit(0)).alias("n")
    )
    half = F.log10(F.col("n") + 0.5)
    added = counted.groupBy("key").agg(
        F.sum(F.expr("if(n > 0, times, 0)")).alias("known"),
        F.sum(F.col("times") * (half - float(np.log10(vocab.base_sum)))).alias("more_base"),
        F.sum(F.col("times") * half).alias("more_score"),
    )
    none = F.lit(0.0)
    return partial.drop("words", "times").join(added, "key", "left").select(
        "doc",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )


def _score(texts: list[list[bytes]], model: Model, vocab: Vocabulary) -> list[pa.Array]:
    """What can be said of each text without the counts of its rare words, and those words."""
    ids, before = _sequences(texts, vocab.ids)
    sizes = np.array([len(words) + 1 for words in texts])
    starts = np.cumsum(sizes) - sizes
    get = vocab.counts.get
    every = [word for words in texts for word in (*words, b"")]
    flat = [get(word, 0) for word in every]
    # Known words have a positive count; the end may have none.
    count = np.array(flat, dtype=np.float64)
    known = count > 0
    listed = known | (ids == _END)
    base = np.where(listed, np.log10(count + 0.5) - np.log10(vocab.base_sum), 0)
    score = model.log_probabilities(ids, before)
    # The share of a word in its place; that of a rare word lacks its count.
    alone = (ids == _END) | ((ids > _END) & (ids < 2 + len(vocab.ids)))
    score += np.where(alone, 0, np.where(known, np.log10(count + 0.5), 0) - np.log10(vocab.sums[ids]))
    unknown = np.flatnonzero(~listed)
    cuts = np.searchsorted(unknown, np.append(starts, len(every))).tolist()
    unknown = unknown.tolist()
    rare = [Counter([every[i] for i in unknown[a:b]]) for a, b in zip(cuts, cuts[1:])]
    total = lambda values: np.add.reduceat(values, starts)
    return [
        pa.array(sizes, pa.int64()),
        pa.array(total(known.astype(np.int64)), pa.int64()),
        pa.array(total(base)),
        pa.array(total(score)),
        pa.array([list(c) for c in rare], pa.list_(pa.binary())),
        pa.array([list(c.values()) for c in rare], pa.list_(pa.int64())),
    ]


def held_out(column: str = "doc_id"):
    """The fifth of the ids that training leaves out."""
    return F.coalesce(fold(column, 5) == 1, F.lit(False))
