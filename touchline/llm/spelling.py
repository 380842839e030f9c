"""Groups of spelling variants: words one insertion, deletion or replacement apart.

The words form a trie whose edges are a table: a node is a prefix, with the characters that follow it.
A frontier of states (a, b) says that two words that begin with ``a`` and ``b`` differ by one edit so
far. All words with the same beginning share its states, and two words part in one place only, the
end of the beginning they share: there every node starts a state for each pair of its children (a
replaced character) and for each child beside itself (an inserted one). Level by level the states join
the edge table on both sides and step along the characters that follow both. A node with one word
below holds the rest of that word; a state that comes to one names the only candidate left, which
is looked up among the words. A node has a bounded number of children and a state two nodes, so no
key gathers many rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import raw
from touchline.session import stage, stage_path, unstage

#: Runs of letters, as UTF-8: ASCII letters and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: One run in so many (by crc32 of id and run) loses a character.
LOSES = 97
LETTERS, TIMES = 5, 3
#: Levels of the trie. Longer words are joined by what surrounds each of their characters.
LEVELS = 64
_HELD = 400_000  # distinct runs a task counts before it hands them on


def runs(text: bytes, prefix: int, loses: int) -> Iterator[tuple[bytes, int]]:
    """(run, times) of a text, A to Z lower-cased; some runs lose a character.

    ``prefix`` is the crc32 of what stands before the run in the hashed text.
    """
    for run, times in Counter(RUN.findall(text.lower())).items():
        h = zlib.crc32(run, prefix)
        if h % loses == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, times


def run_counts(docs: DataFrame, id_col: str, text_col: str, loses: int) -> DataFrame:
    """(word, n) over all texts."""

    def out(found: Counter) -> pa.RecordBatch:
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, times in runs(text, prefix, loses):
                    found[word] += times
                if len(found) > _HELD:
                    yield out(found)
                    found = Counter()
        if found:
            yield out(found)

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    counted = chosen.mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _nodes(words: DataFrame) -> tuple[DataFrame, int]:
    """The trie (depth, node, ends, tail, chars) and the depth of its last node that words share.

    ``ends``: the node is a word; ``tail``: what follows in the only word below, NULL where
    there are several; ``chars``: the characters that follow.
    """
    beginnings = words.select(
        "word", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("depth")
    ).select(
        "depth",
        F.expr("substring(word, 1, depth)").alias("node"),
        F.expr("substring(word, depth + 1)").alias("tail"),
    )
    folded = beginnings.groupBy("depth", "node").agg(
        F.count("*").alias("n"),
        F.min("tail").alias("tail"),
        F.collect_set(F.expr("substring(tail, 1, 1)")).alias("chars"),
    )
    nodes = folded.select(
        "depth",
        "node",
        F.array_contains("chars", "").alias("ends"),
        F.when(F.col("n") == 1, F.col("tail")).alias("tail"),
        F.array_remove("chars", "").alias("chars"),
    )
    path = stage_path(words.sparkSession, "trie")
    nodes.hint("rebalance", "depth").write.partitionBy("depth").parquet(path)
    trie = words.sparkSession.read.schema(nodes.schema).parquet(path)
    trie._staged_at = path
    deepest = trie.where("tail IS NULL").agg(F.max("depth")).first()[0]
    return trie, -1 if deepest is None else deepest


def _starts(nodes: DataFrame) -> DataFrame:
    """(depth, a, b, skip): the states in which two words have just parted.

    Both children of a node, one character replaced by the other; or the node itself beside a
    child, a character inserted. Words that go on alike part later, so that the character that
    follows ``a`` may not be ``skip``, the inserted one.
    """
    shared = nodes.where("tail IS NULL").select("depth", "node", "chars")
    children = shared.select("depth", "node", "chars", F.explode("chars").alias("c"))
    replaced = children.select(
        "node", "depth", "c", F.explode(F.expr("filter(chars, x -> x > c)")).alias("other")
    ).selectExpr("depth + 1 AS depth", "concat(node, c) AS a", "concat(node, other) AS b", "'' AS skip")
    inserted = children.selectExpr("depth", "node AS a", "concat(node, c) AS b", "c AS skip")
    return replaced.union(inserted)


def _met(states: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``states`` with what the trie holds at both of their nodes."""
    left = nodes.where(F.col("depth") == depth).selectExpr(
        "node AS a", "ends AS a_ends", "tail AS a_tail", "chars AS a_chars"
    )
    right = nodes.where(F.col("depth").isin(depth, depth + 1)).selectExpr(
        "node AS b", "ends AS b_ends", "tail AS b_tail", "chars AS b_chars"
    )
    both = states.select("a", "b", "skip").join(left, "a").join(right, "b")
    return both.selectExpr(
        "a", "b", "skip", "a_ends AND b_ends AS ends", "a_tail", "b_tail",
        "if(a_tail IS NULL AND b_tail IS NULL, array_except(array_intersect(a_chars, b_chars),"
        " array(skip)), array()) AS chars",
    )


def _pairs(met: DataFrame) -> DataFrame:
    """(x, y): words one edit apart if both are words."""
    shared = "a_tail IS NULL AND b_tail IS NULL"
    alike = "a_tail IS NULL OR b_tail IS NULL OR a_tail = b_tail"
    tail = "coalesce(a_tail, b_tail, '')"
    # What follows the inserted character is what follows on the other side, and not that character.
    later = f"skip <> '' AND startswith({tail}, skip)"
    return met.where(f"if({shared}, ends, ({alike}) AND NOT ({later}))").selectExpr(
        f"concat(a, {tail}) AS x", f"concat(b, {tail}) AS y"
    )


def near_words(words: DataFrame) -> DataFrame:
    """(x, y): each pair of ``words`` (word) that differ by one edit, once."""
    short = words.where(F.char_length("word") <= LEVELS).select("word")
    nodes, deepest = _nodes(short)
    starts = stage(_starts(nodes).withColumn("at", F.col("depth")), "starts")
    found: list[DataFrame] = []
    for depth in range(deepest + 2):
        states = starts.where(F.col("at") == depth).select("a", "b", "skip")
        if found:
            stepped = found[-1].select("a", "b", F.explode("chars").alias("c"))
            states = states.union(stepped.selectExpr("concat(a, c)", "concat(b, c)", "''"))
        found.append(stage(_met(states, nodes, depth), "frontier"))
    pairs = words.sparkSession.createDataFrame([], "x string, y string")
    for met in found:
        pairs = pairs.union(_pairs(met))
    candidates = stage(pairs.union(_long_pairs(words)), "pairs")
    unstage(nodes, starts, *found)
    known = words.select("word")
    return candidates.join(known.withColumnRenamed("word", "x"), "x").join(
        known.withColumnRenamed("word", "y"), "y"
    ).select("x", "y")


def _around(word: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every beginning and of every ending, from none to the whole word."""
    letters = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        ups = np.full(len(letters) + 1, base, dtype=np.uint64)
        downs = np.full(len(letters) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        ups[0] = downs[0] = 1
        ups, downs = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * ups[:-1])])
        mix = np.uint64(0xD6E8FEB86659FD93)
        endings = (sums[-1] - sums) * downs
        return [(x ^ (x >> np.uint64(29))) * mix for x in (sums, endings)]


def _one_edit(x: str, y: str) -> bool:
    """Whether the longer word (or any, if equally long) becomes the other by one edit."""
    if len(x) < len(y):
        x, y = y, x
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(y))
    return x != y and x[at + 1 :] == y[at + (len(x) == len(y)) :]


def _long_pairs(words: DataFrame) -> DataFrame:
    """(x, y) with a word beyond the trie: each character is taken out, and what surrounds it is met
    with what surrounds a character or a gap of other words."""
    schema = "word string, before long, after long, cut boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                begins, ends = (part.view(np.int64) for part in _around(word))
                n = len(word)
                columns = [
                    pa.array([word] * (2 * n + 1), pa.string()),
                    pa.array(np.concatenate([begins[:-1], begins])),
                    pa.array(np.concatenate([ends[1:], ends])),
                    pa.array([True] * n + [False] * (n + 1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["word", "before", "after", "cut"])

    long = words.where(F.char_length("word") >= LEVELS).select("word")
    around = stage(long.mapInArrow(work, schema), "around")
    cut = around.where("cut").selectExpr("word AS x", "before", "after")
    other = around.selectExpr("word AS y", "before", "after", "cut")
    met = cut.join(other, ["before", "after"]).where(
        f"(x < y OR NOT cut) AND x <> y AND greatest(char_length(x), char_length(y)) > {LEVELS}"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield batch.filter(pa.array([_one_edit(x, y) for x, y in pairs], pa.bool_()))

    return met.select("x", "y").distinct().mapInArrow(check, "x string, y string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the chain. Each round doubles the steps.

    A form is met at least twice as often as its word, so chains are short and have an end.
    """
    reached = stage(forms.select("word", F.col("form").alias("root")), "reached")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = stage(reached.join(ahead, "root", "left"), "stepped")
        if stepped.where("further IS NOT NULL").isEmpty():
            unstage(stepped)
            return reached
        used, reached = reached, stage(
            stepped.select("word", F.coalesce("further", "root").alias("root")), "reached"
        )
        unstage(used, stepped)


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    times: int = TIMES,
    loses: int = LOSES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, its preferred spelling and the last one.

    Words are the runs of letters of whole texts with A to Z lower-cased, of at least ``letters``
    characters and ``times`` occurrences. A run whose crc32 with its document's id is a multiple of
    ``loses`` lacks a character. The form of a word is the near word that occurs most (ties: the
    smallest by code point), if that is at least twice as often; the root is where forms end.

    NULL and empty texts have no words; a NULL id is written as an empty text in the hash; repeated
    rows count again; an empty table or one without words gives no rows; other columns are not read.
    """
    counts = run_counts(docs, id_col, text_col, loses)
    chosen = counts.where((F.char_length("word") >= letters) & (F.col("n") >= times))
    words = stage(chosen, "words")
    pairs = stage(near_words(words), "near")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("near")).union(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("near"))
    )
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    rated = stage(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.expr("CASE WHEN -best.m >= 2 * n THEN best.near END").alias("form"),
            F.expr("CASE WHEN -best.m >= 2 * n THEN -best.m END").alias("form_n"),
        ),
        "rated",
    )
    roots = _roots(rated.where("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
