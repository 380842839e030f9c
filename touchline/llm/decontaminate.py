"""Benchmark passages in training text, found with suffix arrays of the training shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.frames import map_rows, raw
from touchline.session import stage

# Every ASCII character but letters and digits parts words; applied after lower-casing A-Z.
_SEPARATORS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_PAIR_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of test text that travel to the tasks at a time; a larger test set takes more passes.
BLOCK_BYTES = 4_000_000

_SCHEMA = (
    "n_words long, hits array<struct<start:long,stop:long>>, items array<string>,"
    " matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"
)


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_SEPARATORS).split()


@dataclass
class _Tests:
    """The test suffixes of one length, sorted, and the word pairs they can begin with."""

    length: int
    keys: np.ndarray  # sorted distinct windows, big-endian ids as bytes
    owners: list[frozenset[str]]  # items of each window
    places: list[list[tuple[str, int, int]]]  # items, their text's number, the window's place
    pairs: np.ndarray  # hashed set of beginnings


def _pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    code = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    return (code * _SPREAD) >> np.uint64(64 - _PAIR_BITS)


def _suffixes(sequence: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    grams = sequence[at[:, None] + np.arange(length)].astype(">u4")
    return np.ascontiguousarray(grams).view(f"S{4 * length}").ravel()


def _prepare(items: list[tuple[str, bytes]], window: int) -> tuple[dict[bytes, int], list[_Tests]]:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[bytes, tuple[set[str], list, tuple[int, ...]]]] = {}
    for number, (item, text) in enumerate(dict.fromkeys(items)):
        found = words(text)
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            gram = tuple(ids[i : i + size])
            key = np.array(gram, dtype=">u4").tobytes()
            entry = by_length.setdefault(size, {}).setdefault(key, (set(), [], gram))
            entry[0].add(item)
            entry[1].append((item, number, i))
    tests = []
    for length, grams in sorted(by_length.items()):
        ordered = sorted(grams.items())
        keys = np.array([key for key, _ in ordered], dtype=f"S{4 * length}")
        begin = np.array([(g[0], g[1] if length > 1 else 0) for _, (_, _, g) in ordered])
        pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        pairs[_pair_slots(begin[:, 0], begin[:, 1])] = True
        owners = [frozenset(own) for _, (own, _, _) in ordered]
        tests.append(_Tests(length, keys, owners, [p for _, (_, p, _) in ordered], pairs))
    return vocabulary, tests


def _search(sequence: np.ndarray, test: _Tests) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, test window) of every occurrence.

    The shard's suffix array leaves out suffixes that begin with no test's word or word pair.
    """
    begins = sequence > 0
    if test.length > 1:
        following = np.append(sequence[1:], 0)
        begins &= following > 0
        at = np.nonzero(begins)[0]
        at = at[test.pairs[_pair_slots(sequence[at], following[at])]]
    else:
        at = np.nonzero(begins)[0]
    at = at[at + test.length <= len(sequence)]
    keys = _suffixes(sequence, at, test.length)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    low = np.searchsorted(keys, test.keys, "left")
    high = np.searchsorted(keys, test.keys, "right")
    sizes = high - low
    which = np.repeat(np.arange(len(sizes)), sizes)
    offsets = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return array[low[which] + offsets], which


def _runs(places: np.ndarray, which: np.ndarray, test: _Tests, out: list) -> None:
    """Longest verbatim matches: windows that follow each other in document and item."""
    open_runs: dict[tuple[int, int], list] = {}  # the last of each text and diagonal
    for place, k in zip(places.tolist(), which.tolist()):
        for item, number, at in test.places[k]:
            run = open_runs.get((number, place - at))
            if run and place == run[2] + run[3] - test.length + 1:
                run[3] += 1
                continue
            open_runs[number, place - at] = run = [item, at, place, test.length]
            out.append(run)


def _document(n: int, found: list[tuple[np.ndarray, np.ndarray]], tests: list[_Tests]) -> dict:
    hits: list[list[int]] = []
    items: set[str] = set()
    matches: list[list] = []
    for (places, which), test in zip(found, tests):
        for k in np.unique(which):
            items |= test.owners[k]
        _runs(places, which, test, matches)
        for place in places.tolist():
            if hits and place <= hits[-1][1] and place >= hits[-1][0]:
                hits[-1][1] = max(hits[-1][1], place + test.length)
            else:
                hits.append([place, place + test.length])
    return {
        "n_words": n,
        "hits": [{"start": a, "stop": b} for a, b in hits],
        "items": sorted(items),
        "matches": [
            dict(zip(("item_id", "item_word", "doc_word", "n_words"), m))
            for m in dict.fromkeys(map(tuple, matches))
        ],
    }


def _search_pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_prepare(items, window))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocabulary, tests = shared.value
        parts, counts = [], []
        for text in raw(batch.column(batch.num_columns - 1)):
            found = words(text)
            counts.append(len(found))
            parts.append(
                np.fromiter(map(vocabulary.get, found, repeat(0)), np.uint32, len(found))
            )
            parts.append(np.zeros(1, np.uint32))  # matches end with their document
        sequence = np.concatenate(parts)
        starts = np.cumsum([0, *(n + 1 for n in counts)])
        found = []
        for test in tests:
            places, which = _search(sequence, test)
            order = np.argsort(places, kind="stable")
            places, which = places[order], which[order]
            found.append((places, which, np.searchsorted(places, starts)))
        out = []
        for i, n in enumerate(counts):
            own = [
                (places[cut[i] : cut[i + 1]] - starts[i], which[cut[i] : cut[i + 1]])
                for places, which, cut in found
            ]
            out.append(_document(n, own, tests))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ("items", pa.list_(pa.string())),
                (
                    "matches",
                    pa.list_(
                        pa.struct(
                            [
                                ("item_id", pa.string()),
                                ("item_word", pa.int64()),
                                ("doc_word", pa.int64()),
                                ("n_words", pa.int64()),
                            ]
                        )
                    ),
                ),
            ]
        )
        columns += pa.array(out, type=kind).flatten()
        names = [*batch.schema.names[:-1], "n_words", "hits", "items", "matches"]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_rows(docs, f"doc long, digest string, {_SCHEMA}", work)


def _covered(hits: str) -> Column:
    """Positions in the union of intervals sorted by their start."""
    return F.expr(
        f"""aggregate(sort_array({hits}), named_struct('n', 0L, 'stop', 0L),
        (s, h) -> named_struct(
            'n', s.n + greatest(0L, h.stop - greatest(h.start, s.stop)),
            'stop', greatest(s.stop, h.stop)),
        s -> s.n)"""
    )


def _blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str):
    """The test set in blocks of bounded size; only one block is on the driver at a time."""
    chosen = benchmark.select(
        F.col(item_col).cast("string").alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("item IS NOT NULL")
    size = chosen.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for k in range(count):
        part = chosen.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k) if count > 1 else chosen
        yield [(r.item, r.text.encode()) for r in part.collect()]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
) -> DataFrame:
    """(doc, n_words, n_hit, items, matches) for every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window.
    ``n_hit`` counts the words inside any occurrence, ``items`` has the ids of the items with
    occurring windows, sorted as text, and ``matches`` the longest verbatim matches with
    every item and place that has them. Every Arrow batch of documents is a shard with a suffix array of
    its own, in which all test suffixes are searched; results never leave their row, so no row is
    shuffled and a hot passage costs no more than a rare one.

    NULL and wordless texts have no words and no hits; NULL item ids are no items, a repeated id
    is one item; repeated rows give repeated results; an empty table on either side gives no hits;
    other columns are not read. A test set of more than ``BLOCK_BYTES`` is searched in blocks.
    """
    found = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    return found.drop("digest")


def _hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
) -> DataFrame:
    """:func:`benchmark_hits` with the digest of each text."""
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.sha2(F.col(text_col), 256).alias("digest"),
        F.col(text_col).alias("text"),
    )
    passes = []
    for items in _blocks(spark, benchmark, item_col, item_text_col):
        if passes:
            passes[-1] = stage(passes[-1], "hits")
        passes.append(_search_pass(chosen, items, window))
    found = passes[0]
    if len(passes) > 1:
        key = ["doc", "digest"]
        union = found.withColumn("row", F.lit(1))
        for more in passes[1:]:
            union = union.unionByName(more.withColumn("row", F.lit(0)))
        # Rows with the same id and text are alike: fold them, then give them back.
        found = (
            union.groupBy(key)
            .agg(
                F.max("n_words").alias("n_words"),
                F.flatten(F.collect_set("hits")).alias("hits"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                F.flatten(F.collect_set("matches")).alias("matches"),
                F.sum("row").cast("int").alias("rows"),
            )
            .withColumn("again", F.explode(F.sequence(F.lit(1), "rows")))
        )
    return found.select(
        "doc",
        "digest",
        "n_words",
        _covered("hits").alias("n_hit"),
        F.sort_array("items").alias("items"),
        "matches",
    )


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows of which a twentieth of the words or more is benchmark text.

    Every row is judged by its own text: one without an id goes as well, and a clean row stays
    whatever other rows have its id.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    affected = _hits(docs, benchmark, **options).where(CONTAMINATED).select("doc", "digest")
    same = f"CAST(docs.`{id_col}` AS BIGINT) <=> gone.doc AND sha2(docs.`{text_col}`, 256) = gone.digest"
    gone = stage(affected.distinct(), "affected").alias("gone")
    return docs.alias("docs").join(gone, F.expr(same), "left_anti")
