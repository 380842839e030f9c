"""Token ids in files compressed by a grammar of frequent pairs, readable at any place.

A file set is a Parquet table with one row per shard of documents in id order:

========== ============= ====================================================================
column     type          meaning
========== ============= ====================================================================
part, seq  long, int     order of the shards: all of part 0 by seq, then part 1, ...
docs       array<long>   ids of the shard's documents
lengths    array<long>   tokens of each document, its end included
symbols    array<long>   symbols of each document in ``sequence``
tokens     long          sum of ``lengths``
terminals  long          symbols below this are token ids, symbol ``terminals + r`` is rule r
rules      binary        two little-endian 32-bit symbols per rule; a rule uses earlier rules
expansions binary        tokens that each rule stands for, little-endian 32-bit
width      int           bytes of a symbol in ``sequence``: 2 or 4
sequence   binary        the documents' symbols, little-endian
========== ============= ====================================================================
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.frames import map_rows, raw, remembered

#: Tokens from which a shard is closed; a document is never split between shards.
SHARD_TOKENS = 1_000_000
#: Pairs replaced in a round, and occurrences that make a pair frequent.
PAIRS = 1_024
FREQUENT = 32
#: Pieces whose ids a worker remembers; beyond that those not met again are forgotten.
REMEMBERED = 300_000

#: The splitting pattern of byte-level vocabularies, and the same with its classes
#: written out for the characters up to U+024F. The control characters U+001C to U+001F, which
#: not every definition takes for white space, are far as well.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER = "A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_NUMBER = "0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"
_BLANK = "\\t-\\r \u0085\u00A0"
_NEAR = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
    f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_FAR = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")

_SCHEMA = (
    "part long, seq int, docs array<long>, lengths array<long>, symbols array<long>, tokens long,"
    " terminals long, rules binary, expansions binary, width int, sequence binary"
)
_NAMES = [column.split()[0] for column in _SCHEMA.split(", ")]


def _byte_characters() -> dict[int, str]:
    """The printable character a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [c for c in range(256) if c not in set(plain)]
    return {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(others)}


class Encoder:
    """The tokenizers library on whole texts, or its model on each distinct piece once.

    ``pattern`` splits text as a byte-level tokenizer without a prefix space does; pieces never
    influence each other, so that their ids in a row are those of the text. Texts that contain an
    added token are left to the library as a whole.
    """

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(pattern) if pattern else None
        self.split = self._latin if pattern == GPT2 else self.pattern and self.pattern.findall
        self.characters = _byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _latin(self, text: str) -> list[str]:
        """Pieces of a text; one without far characters is split by the faster standard module."""
        return self.pattern.findall(text) if _FAR.search(text) else _NEAR.findall(text)

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            written = piece.encode().decode("latin-1").translate(self.characters)
            found = [token.id for token in self.model.tokenize(written)]
            ids = struct.pack(f"<{len(found)}I", *found)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.pattern is None:
            return [self._whole(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        plain = [not any(token in text for token in self.added) for text in texts]
        cut = [self.split(t) if own else [] for t, own in zip(texts, plain)]
        for piece in set().union(*cut).difference(self.known):
            self.known[piece] = self._piece(piece)
        get = self.known.__getitem__
        return [
            np.frombuffer(b"".join(map(get, pieces)), dtype="<u4") if own else self._whole(text)
            for text, own, pieces in zip(texts, plain, cut)
        ]


@remembered
def encoder(path: str, pattern: str | None) -> Encoder:
    return Encoder(path, pattern)


def _codes(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint32 if bits == 16 else np.uint64
    return left.astype(kind) << kind(bits) | right.astype(kind)


def _frequent(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the most frequent pairs that can be replaced together, sorted.

    No symbol may end one pair and begin another, so their occurrences don't overlap.
    """
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(starts, len(codes)))
    often = np.flatnonzero(counts >= FREQUENT)
    often = often[np.argsort(-counts[often], kind="stable")][: 2 * PAIRS]
    begin, end, chosen = set(), set(), []
    for code in codes[starts[often]].tolist():
        a, b = code >> bits, code & ((1 << bits) - 1)
        if a in end or b in begin or (a == b and (a in begin or b in end)):
            continue
        begin.add(a)
        end.add(b)
        chosen.append(code)
        if len(chosen) == PAIRS:
            break
    return np.sort(np.array(chosen, dtype=codes.dtype))


def compress(
    documents: list[np.ndarray], terminals: int
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(symbols of each document, rules, expansions): frequent pairs become new symbols.

    Each round counts all neighbouring pairs and replaces the most frequent ones, until no
    pair is frequent, or symbols would need more than 16 bits where 16 bits could hold them so
    far. Pairs never cross documents.
    """
    most, bits = (1 << 16, 16) if terminals < 1 << 16 else (1 << 31, 32)
    gap = np.array([-1], dtype=np.int32)
    line = np.concatenate([x for ids in documents for x in (ids.astype(np.int32), gap)] or [gap])
    rules = np.empty((0, 2), dtype=np.int64)
    sizes = np.ones(terminals, dtype=np.int64)
    while True:
        inside = (line[:-1] >= 0) & (line[1:] >= 0)
        at = np.flatnonzero(inside)
        if not len(at):
            break
        every = _codes(line[at], line[at + 1], bits)
        codes = _frequent(every, bits)[: most - terminals - len(rules)]
        if not len(codes):
            break
        left = (codes >> codes.dtype.type(bits)).astype(np.int64)
        right = (codes & codes.dtype.type((1 << bits) - 1)).astype(np.int64)
        begins = np.zeros(len(sizes), dtype=bool)
        ends = np.zeros(len(sizes), dtype=bool)
        begins[left], ends[right] = True, True
        likely = begins[line[at]] & ends[line[at + 1]]
        at, own = at[likely], every[likely]
        which = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        hit = codes[which] == own
        at, which = at[hit], which[hit]
        # In a run of one symbol every second place is replaced.
        fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        even = (np.arange(len(at)) - first) % 2 == 0
        at, which = at[even], which[even]
        line[at] = len(sizes) + which
        keep = np.ones(len(line), dtype=bool)
        keep[at + 1] = False
        line = line[keep]
        rules = np.concatenate([rules, np.column_stack([left, right])])
        sizes = np.concatenate([sizes, sizes[left] + sizes[right]])
    cuts = np.flatnonzero(line < 0)
    starts = np.concatenate(([0], cuts[:-1] + 1)) if documents else []
    symbols = [line[a:b] for a, b in zip(starts, cuts)]
    return symbols, rules, sizes[terminals:]


class Shard:
    """One row of a file set; decodes whole documents or any range of their tokens."""

    def __init__(self, row: dict):
        self.terminals = row["terminals"]
        self.rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2).astype(np.int64)
        expansions = np.frombuffer(row["expansions"], dtype="<u4").astype(np.int64)
        self.sizes = np.concatenate([np.ones(self.terminals, dtype=np.int64), expansions])
        width = {2: "<u2", 4: "<u4"}[row["width"]]
        self.sequence = np.frombuffer(row["sequence"], dtype=width).astype(np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(row["symbols"])]).astype(np.int64)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while True:
            inner = np.flatnonzero(symbols >= self.terminals)
            if not len(inner):
                return symbols
            pairs = self.rules[symbols[inner] - self.terminals]
            times = np.ones(len(symbols), dtype=np.int64)
            times[inner] = 2
            places = np.cumsum(times) - times
            out = np.repeat(symbols, times)
            out[places[inner]], out[places[inner] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out

    def documents(self) -> list[np.ndarray]:
        whole = self._expand(self.sequence).astype("<u4")
        lengths = np.concatenate([[0], np.cumsum(self.sizes[self.sequence])])
        cuts = lengths[self.cuts]
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def tokens(self, document: int, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of one document; only symbols they touch are expanded."""
        symbols = self.sequence[self.cuts[document] : self.cuts[document + 1]]
        ends = np.cumsum(self.sizes[symbols])
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[max(0, start - before) : stop - before].astype("<u4")


def _row(part: int, seq: int, docs: list, ids: list[np.ndarray], terminals: int) -> list:
    symbols, rules, expansions = compress(ids, terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    sequence = np.concatenate(symbols).astype(f"<u{width}")
    lengths = [len(x) for x in ids]
    return [
        part, seq, docs, lengths, [len(x) for x in symbols], sum(lengths), terminals,
        rules.astype("<u4").tobytes(), expansions.astype("<u4").tobytes(), width,
        sequence.tobytes(),
    ]


_TYPES = [
    pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
    pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(),
]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encodes whole texts, ends each with ``end_id`` and writes them in ascending id order.

    NULL is an empty text and has its end only. Rows without an id come first, rows that share an
    id in the order of their text's hash; an empty table gives no shards; other columns are not
    read. The tokenizer's file must lie at ``tokenizer`` on every machine; ``pattern`` as in
    :class:`Encoder`.
    """
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = ["doc", F.xxhash64("text")]
    ordered = chosen.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, tool = TaskContext.get().partitionId(), 0, encoder(tokenizer, pattern)
        end = np.array([end_id], dtype="<u4")
        names, ids, count = [], [], 0

        def shard() -> pa.RecordBatch:
            row = _row(part, seq, names, ids, max(tool.size, end_id + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, _TYPES)], _NAMES
            )

        for batch in batches:
            texts = raw(batch.column(1))
            docs_ = batch.column(0).to_pylist()
            for start in range(0, len(texts), 500):
                some = [text.decode() for text in texts[start : start + 500]]
                for name, found in zip(docs_[start : start + 500], tool.encode(some)):
                    names.append(name)
                    ids.append(np.concatenate([found, end]))
                    count += len(found) + 1
                    if count >= shard_tokens:
                        yield shard()
                        names, ids, count, seq = [], [], 0, seq + 1
        if names:
            yield shard()

    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of a file set; ``start`` counts the tokens of all before.

    Tokens are summed by part, the parts' sums are offsets on the driver (one number per task of
    the writer), and a running sum within the part does the rest.
    """
    shards = spark.read.schema(_SCHEMA).parquet(path)
    offsets, total = [], 0
    for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        offsets.append((r.part, total))
        total += r.n
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("part", "seq", "tokens").join(
        F.broadcast(spark.createDataFrame(offsets, "part long, offset long")), "part"
    )
    firsts = firsts.select(
        "part", "seq", (F.col("offset") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("first")
    )
    placed = shards.join(firsts, ["part", "seq"]).select("first", *_NAMES[2:])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = Shard(row).documents()
            lengths = np.array(row["lengths"], dtype=np.int64)
            columns = [
                pa.array(row["docs"], pa.int64()),
                pa.array(row["first"] + np.cumsum(lengths) - lengths),
                pa.array(lengths),
                pa.array([x.tobytes() for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "n_tokens", "ids"])

    return map_rows(placed, "doc long, start long, n_tokens long, ids binary", work)
