"""Byte strings that occur earlier in the corpus, found with a distributed suffix array.

Texts that are copies as a whole go first. Any 100 bytes (``SPAN``) hold a least gram by hash, and equal strings hold the same one.
Neighbouring places whose strings hold the same gram form a block; a string can only repeat where
the gram of its block repeats, and that is where the suffix array is built: over strings of blocks,
with the blocks' bytes as symbols. Adjacent suffixes that agree over the whole reach of their first
block (its bytes and the 99 that follow) are copies, and the earliest of them stands for all. What
is left are blocks at the edges of repeats. They are cut into finer blocks by longer grams, whose
copies go the same way, and the places that still remain are compared string by string.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from touchline.llm.frames import map_rows
from touchline.llm.suffixes import ranks_of
from touchline.session import drop_shuffles, stage, stage_path, unstage

SPAN = 100
GRAM, FINE_GRAM = 32, 80
#: Places between edges from which the text between them is not hashed again.
APART = 4_096
#: Bytes hashed at a time; a longer text is cut, which costs nothing but a split block.
CHUNK = 1 << 20
#: Symbols of a suffix that the array orders, as a power of three.
LEVELS = 2

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=4)
def _constants(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number per byte, and the powers of a base and of its inverse modulo 2**64."""
    table = _mix(np.arange(1, 257, dtype=_U) * _U(_BASES[which])) | _U(1)
    powers = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        values = np.full(size, base, dtype=_U)
        values[0] = 1
        powers.append(np.multiply.accumulate(values))
    return table, *powers


class Hashes:
    """64-bit hashes of any substring of up to ``CHUNK`` + ``SPAN`` bytes, equal wherever it lies."""

    def __init__(self, data: np.ndarray, which: int = 0):
        table, powers, self.inverse = _constants(which, CHUNK + SPAN)
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        values = table.take(data)
        values *= powers[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of ``size`` bytes."""
        count = len(self.sums) - size
        values = self.sums[size:] - self.sums[:-size]
        values *= self.inverse[:count]
        return _mix(values)

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return _mix((self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


def _chunks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts in which every ``SPAN`` bytes begin in one part only."""
    for start in range(0, max(0, len(data) - SPAN + 1), CHUNK):
        yield start, data[start : start + CHUNK + SPAN - 1]


def blocks(
    data: np.ndarray, size: int, cuts: np.ndarray | None = None, reach: bool = False
) -> tuple[np.ndarray, ...]:
    """(first, last, gram, inner): ranges of places whose strings hold the same least gram.

    ``inner`` blocks have their gram in more than one place, so strings can repeat inside. Blocks
    also begin at the places ``cuts``. With ``reach`` the hash of all bytes of a block's strings
    comes as well.
    """
    found = [tuple(np.empty(0, kind) for kind in (np.int64, np.int64, _U, bool, *[_U] * reach))]
    for start, part in _chunks(data):
        tool = Hashes(part)
        grams = tool.every(size)
        least = _least(grams, SPAN - size + 1)
        same = least[1:] == least[:-1]
        begins = np.concatenate(([True], ~same))
        if cuts is not None:
            begins[cuts[(cuts >= start) & (cuts < start + len(least))] - start] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(least)) - 1
        # The gram's first place falls behind and the next string has it all the same.
        again = (grams[: len(least) - 1] == least[:-1]) & same
        inner = np.logical_or.reduceat(np.append(again, False), first)
        whole = [tool.of(first, last - first + SPAN)] if reach else []
        found.append((first + start, last + start, least[first], inner, *whole))
    return tuple(np.concatenate(column) for column in zip(*found))


def _hash_pieces(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int, less: int = 0
) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Hashes of pieces that begin in order, each of ``CHUNK`` bytes or fewer; with ``less`` also
    those of the pieces without their last ``less`` bytes."""
    out = np.empty((2, len(starts)), dtype=_U)
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = int(np.searchsorted(starts + lengths, begin + CHUNK + SPAN, "right"))
        j = max(j, i + 1)
        stop = int((starts[i:j] + lengths[i:j]).max())
        tool = Hashes(data[begin:stop], which)
        out[0, i:j] = tool.of(starts[i:j] - begin, lengths[i:j])
        if less:
            out[1, i:j] = tool.of(starts[i:j] - begin, lengths[i:j] - less)
        i = j
    return (out[0], out[1]) if less else out[0]


def _bytes(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    return map(_bytes, column.cast(pa.binary()))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _grams(texts: DataFrame) -> DataFrame:
    """(gram, d, first, last, inner): every block with its gram."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [blocks(data, GRAM) for data in _texts(batch.column(1))]
        first, last, grams, inner = (np.concatenate(column) for column in zip(*found))
        columns = [
            _signed(grams),
            np.repeat(_ids(batch.column(0)), [len(own[0]) for own in found]),
            first.astype(np.int32),
            last.astype(np.int32),
            inner,
        ]
        names = ["gram", "d", "first", "last", "inner"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "gram long, d long, first int, last int, inner boolean"
    return map_rows(texts.select("d", "text"), schema, work)


def _with_company(rows: DataFrame) -> DataFrame:
    """Rows whose gram other rows have as well, or whose own strings can repeat.

    The grams in question are a table of their own, so that a gram that very many rows share can
    be split in the join.
    """
    shared = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(shared.select("gram", F.lit(True).alias("shared")), "shared")
    return rows.join(shared, "gram", "left").where("shared OR inner").drop("shared")


def _block_strings(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks with a repeated gram, as strings of neighbours (d, r) with places i, each with the two
    symbols that follow it."""
    block = F.struct("first", "last", "gram", "inner")
    lists = repeated.groupBy("d").agg(F.collect_list(block).alias("blocks"))
    schema = (
        "d long, r long, i int, sym long, sym1 long, sym2 long, gram long, inner boolean,"
        " reach1 long, reach2 long, first int, last int"
    )

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for d, data, own in zip(_ids(batch.column(0)), _texts(batch.column(1)), batch.column(2)):
            rows = own.values
            first = rows.field("first").to_numpy().astype(np.int64)
            order = np.argsort(first)
            first = first[order]
            last = rows.field("last").to_numpy().astype(np.int64)[order]
            new = np.concatenate(([True], first[1:] != last[:-1] + 1))
            run = np.cumsum(new) - 1
            size = last - first + SPAN
            reach, own_bytes = _hash_pieces(data, first, size, 0, less=SPAN - 1)
            # Symbols are ordered as numbers, and a symbol is never negative.
            symbol = _signed(own_bytes >> _U(1))
            after = [_next_in_run(symbol, run, k) for k in (1, 2)]
            out.append(
                (
                    np.full(len(first), d),
                    run,
                    (np.arange(len(first)) - np.flatnonzero(new)[run]).astype(np.int32),
                    symbol,
                    *after,
                    rows.field("gram").to_numpy()[order],
                    rows.field("inner").to_numpy(zero_copy_only=False)[order],
                    _signed(reach),
                    _signed(_hash_pieces(data, first, size, 1)),
                    first.astype(np.int32),
                    last.astype(np.int32),
                )
            )
        columns = [pa.array(np.concatenate(column)) for column in zip(*out)]
        names = [column.split()[0] for column in schema.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_rows(texts.select("d", "text").join(lists, "d"), schema, work)


def _next_in_run(symbols: np.ndarray, run: np.ndarray, steps: int) -> np.ndarray:
    """The symbols ``steps`` further in the same run, -1 beyond its end."""
    out = np.full(len(symbols), -1, dtype=np.int64)
    same = run[steps:] == run[:-steps]
    out[:-steps][same] = symbols[steps:][same]
    return out


def _copies(units: DataFrame) -> DataFrame:
    """``units`` in suffix order with ``copy``: an earlier neighbour has the same reach.

    Neighbours with the same reach form a group, whatever follows; the earliest of it in the corpus
    stands for all. A range of the array is read once, and no more than the group that is still
    open is held. Copies that a range boundary parts are left to the comparisons that follow.
    """
    ordered = units.repartitionByRange("rank", "d", "first").sortWithinPartitions(
        "rank", "d", "first"
    )
    names = ["d", "first", "last", "gram", "inner"]

    def marked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        d, first, reach1, reach2 = (
            table[name].to_numpy() for name in ("d", "first", "reach1", "reach2")
        )
        group = np.concatenate(
            ([0], np.cumsum((reach1[1:] != reach1[:-1]) | (reach2[1:] != reach2[:-1])))
        )
        order = np.lexsort((first, d, group))
        copy = np.ones(table.num_rows, dtype=bool)
        copy[order[np.concatenate(([True], group[order][1:] != group[order][:-1]))]] = False
        out = table.select(names).append_column("copy", pa.array(copy))
        yield from out.to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            reach = np.stack([_ids(batch.column(k)) for k in (5, 6)])
            begins = np.flatnonzero((reach[:, 1:] != reach[:, :-1]).any(axis=0)) + 1
            if len(begins):  # what comes before the last group is whole
                last = int(begins[-1])
                yield from marked(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
                held = [batch.slice(last)]
        if held:
            yield from marked(pa.Table.from_batches(held))

    return ordered.select(*names, "reach1", "reach2").mapInArrow(
        run, "d long, first int, last int, gram long, inner boolean, copy boolean"
    )


def _spans(rows: DataFrame) -> DataFrame:
    """(d, spans): first and last places as the halves of a long."""
    packed = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    return rows.groupBy("d").agg(F.collect_list(packed).alias("spans"))


def _unpack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values >> 32, values & 0xFFFFFFFF


def _regions(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places, with ranges that follow each other put together."""
    first, last = _unpack(np.sort(spans))
    new = np.flatnonzero(np.concatenate(([True], first[1:] != last[:-1] + 1)))
    return first[new], last[np.append(new[1:], len(first)) - 1]


def _fine_blocks(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks by longer grams at the places of ``edges``."""
    schema = "d long, first int, last int, gram long, inner boolean, reach1 long, reach2 long"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for d, data, own in zip(_ids(batch.column(0)), _texts(batch.column(1)), batch.column(2)):
            begin, end = _regions(own.values.to_numpy())
            parts = []
            near = np.flatnonzero(begin[1:] - end[:-1] > APART) + 1
            for some in np.split(np.arange(len(begin)), near):
                low, high = begin[some[0]], end[some[-1]]
                cuts = np.concatenate([begin[some], end[some] + 1]) - low
                found = blocks(data[low : high + SPAN], FINE_GRAM, cuts, reach=True)
                parts.append((found[0] + low, found[1] + low, *found[2:]))
            found = [np.concatenate(column) for column in zip(*parts)]
            region = np.searchsorted(begin, found[0], "right") - 1
            inside = (region >= 0) & (found[0] <= end[region])
            first, last, gram, inner, reach = (column[inside] for column in found)
            more = _hash_pieces(data, first, last - first + SPAN, 1)
            places = first.astype(np.int32), last.astype(np.int32)
            hashes = _signed(reach), _signed(more)
            out.append((np.full(len(first), d), *places, _signed(gram), inner, *hashes))
        columns = [pa.array(np.concatenate(column)) for column in zip(*out)]
        names = [column.split()[0] for column in schema.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_rows(texts.select("d", "text").join(_spans(edges), "d"), schema, work)


def _places(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(d, first, h1, h2): 96 bits of hash of the strings at the places of ``edges``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for d, data, own in zip(_ids(batch.column(0)), _texts(batch.column(1)), batch.column(2)):
            first, last = _unpack(np.sort(own.values.to_numpy()))
            sizes = last - first + 1
            offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            places = np.repeat(first, sizes) + offsets
            lengths = np.full(len(places), SPAN)
            more = (_hash_pieces(data, places, lengths, 1) >> _U(32)).astype(np.uint32)
            out.append(
                (
                    np.full(len(places), d),
                    places.astype(np.int32),
                    _signed(_hash_pieces(data, places, lengths, 0)),
                    more.view(np.int32),
                )
            )
        columns = [pa.array(np.concatenate(column)) for column in zip(*out)]
        yield pa.RecordBatch.from_arrays(columns, ["d", "first", "h1", "h2"])

    joined = texts.select("d", "text").join(_spans(edges), "d")
    return map_rows(joined, "d long, first int, h1 long, h2 int", work)


def _place(texts: DataFrame) -> Column:
    """What orders rows (d, first) of ``texts``: one long where every id leaves room for a place,
    which Spark aggregates without sorting, else both."""
    if texts.where(~F.col("d").between(0, (1 << 31) - 1)).isEmpty():
        return F.shiftleft(F.col("d"), 32).bitwiseOR(F.col("first").cast("long"))
    return F.struct("d", "first")


def _marked(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """``rows`` with ``copy``: another row has the same keys and a smaller ``place``.

    The first of each group is found by partial aggregation and joined back; a string that a third
    of the rows share is one row there, and the other side of the join can be split.
    """
    low = rows.groupBy(*keys).agg(F.min(place).alias("low"), F.count("*").alias("n"))
    low = stage(low.where("n > 1").drop("n"), "lowest")
    drop_shuffles(rows.sparkSession)  # all keys went through it
    copy = F.col("low").isNotNull() & (place != F.col("low"))
    return rows.join(low, keys, "left").withColumn("copy", copy).drop("low")


def _cut(data: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data`` and the maximal removed runs."""
    first, last = _unpack(np.sort(spans))
    runs: list[tuple[int, int]] = []
    if len(first):
        stop = np.maximum.accumulate(last + SPAN)
        new = np.concatenate(([True], first[1:] > stop[:-1]))
        begins = first[new]
        ends = stop[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]
        runs = list(zip(begins.tolist(), ends.tolist()))
    kept, at = [], 0
    for begin, end in runs:
        kept.append(data[at:begin])
        at = end
    return b"".join([*kept, data[at:]]), runs


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, doc, text, others) with a unique d in the order of ids; the id itself if it can be."""
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("others")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text, carried)
    ids = chosen.groupBy("doc").agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc IS NULL").isEmpty():
        return chosen.withColumn("d", F.col("doc"))
    sorted_ = chosen.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions(
        "doc", F.xxhash64("text")
    )
    return stage(sorted_.withColumn("d", F.monotonically_increasing_id()), "numbered")


def _bucketed(texts: DataFrame) -> DataFrame:
    """``texts`` dealt by ``d`` once, so that the passes over them need not shuffle them again."""
    spark = texts.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"touchline_texts_{uuid.uuid4().hex}"
    writer = texts.repartition(count, "d").write.bucketBy(count, "d").sortBy("d")
    # The texts lie there to the end, so they are packed as well as can be.
    writer = writer.option("compression", "zstd")
    writer.option("path", stage_path(spark, "texts")).saveAsTable(name)
    del writer
    drop_shuffles(spark)  # whole texts went through it
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, with what is staged
    return table


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(d, first, last): places of ``texts`` (d, text) where ``SPAN`` bytes begin that begin
    earlier as well, as ranges that may overlap."""
    long = texts.where(F.octet_length("text") >= SPAN)
    # A text that is the same as an earlier one goes as a whole and is no source for others.
    heads = long.select(
        "d",
        F.lit(0).alias("first"),
        (F.octet_length("text") - SPAN).alias("last"),
        F.sha2("text", 256).alias("digest"),
    )
    heads = stage(heads, "heads")
    place = _place(heads)
    whole = stage(_marked(heads, ["digest"], place).where("copy").select("d", "first", "last"), "whole")
    long = long.join(whole.select("d"), "d", "left_anti")
    grams = stage(_grams(long), "grams")
    repeated = stage(_with_company(grams), "repeated")
    unstage(grams)
    units = stage(_block_strings(long, repeated), "blocks")
    unstage(repeated)
    scratch: list[DataFrame] = []
    ranks = ranks_of(units.select("d", "r", "i", "sym", "sym1", "sym2"), LEVELS, scratch)
    ranks = stage(ranks, "ranks")
    unstage(*scratch)
    coarse = stage(_copies(units.join(ranks, ["d", "r", "i"])), "copies")
    unstage(units, ranks)
    edges = stage(_with_company(coarse.where("NOT copy")).select("d", "first", "last"), "edges")
    fine = stage(_fine_blocks(long, edges), "fine")
    marked = stage(_marked(fine, ["reach1", "reach2"], place), "marked")
    unstage(edges, fine)
    edges = stage(_with_company(marked.where("NOT copy")).select("d", "first", "last"), "edges")
    places = stage(_places(long, edges), "places")
    later = stage(_marked(places, ["h1", "h2"], place).where("copy").select("d", "first"), "later")
    unstage(edges, places)
    span = ["d", "first", "last"]
    return (
        whole.union(coarse.where("copy").select(span))
        .union(marked.where("copy").select(span))
        .union(later.select("d", "first", F.col("first").alias("last")))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_bytes, kept, runs) for every row of ``docs``.

    A byte goes if a string of ``SPAN`` bytes over it begins earlier as well, in a smaller id or
    earlier in the same text; overlapping occurrences count and the input decides, not what is
    left. ``kept`` has the remaining bytes, which may part a character of several bytes; ``runs``
    the maximal removed runs.

    NULL is an empty text and loses nothing, like any text shorter than ``SPAN``. Rows without an
    id come first; rows that share an id are ordered by their text. An empty table gives no rows;
    other columns are not read.
    """
    texts = _bucketed(_keyed(docs, id_col, text_col))
    spans = _spans(repeated_spans(texts))
    schema = (
        "doc long, n_bytes long, kept binary, runs array<struct<start:long,stop:long>>"
    )
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, kept, runs = [], [], []
        for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
            spans = own.values.to_numpy() if own.is_valid else np.empty(0, np.int64)
            left, removed = _cut(text, spans)
            sizes.append(len(text))
            kept.append(left)
            runs.append([{"start": a, "stop": b} for a, b in removed])
        columns = [
            batch.column(0),
            pa.array(sizes, pa.int64()),
            pa.array(kept, pa.binary()),
            pa.array(runs, run_type),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "kept", "runs"])

    joined = texts.join(spans, "d", "left").select("doc", "text", "spans")
    return map_rows(joined, schema, work)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what :func:`remove_repeats` leaves in the place of its texts.

    All rows and columns stay; a text that is a copy as a whole becomes empty, and of a character
    that a cut parts nothing is left. NULL becomes an empty text.
    """
    texts = _bucketed(_keyed(docs, id_col, text_col))
    spans = _spans(repeated_spans(texts))
    joined = texts.join(spans, "d", "left").select("text", "spans", "others")
    schema = StructType(
        [StructField("text", StringType()), StructField("others", joined.schema["others"].dataType)]
    )

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = []
        for text, own in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1)):
            left = _cut(text, own.values.to_numpy())[0] if own.is_valid else text
            kept.append(left.decode(errors="ignore"))
        columns = [pa.array(kept, pa.string()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, ["text", "others"])

    cut = map_rows(joined, schema, work)
    return cut.select(
        *(
            F.col("text").alias(text_col) if c == text_col else F.col(f"others.`{c}`").alias(c)
            for c in docs.columns
        )
    )
