"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.frames import map_rows, raw
from touchline.session import stage

BITS = 64
SEED = 42
_CHUNK = 1 << 18  # hashes unpacked into bits at a time


def shingle_hashes(text: bytes, length: int) -> list[int]:
    """XXH64 of every run of ``length`` lower-cased words; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= length:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(run), SEED) for run in zip(*(words[i:] for i in range(length)))]


def majority(hashes: list[int]) -> int:
    """Bit i is set where more than half of the hashes have it set."""
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(values), _CHUNK):
        octets = values[start : start + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, length: int, carry: Sequence[str] = ()
) -> DataFrame:
    """(doc, fp, ``carry``): one signed 64-bit fingerprint per row; NULL and wordless texts have
    zero."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [majority(shingle_hashes(text, length)) for text in raw(batch.column(1))]
        values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        columns = [batch.column(0), values, *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "fp", *carry])

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.col(text_col).alias("text"),
        *(F.col(f"`{c}`") for c in carry),
    )
    kinds = dict(docs.dtypes)
    schema = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return map_rows(chosen, "doc long, fp long" + schema, work)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(radius: int) -> list[int]:
    """``2**(radius + 1) - 1`` masks; any ``radius`` positions are all zero in one of them.

    Position i carries a non-zero vector m(i) of ``radius + 1`` bits and mask v selects the
    positions whose m(i) has odd inner product with v. At most ``radius`` vectors span a proper
    subspace, so some v is orthogonal to all of them: two values that differ in those positions
    only are equal under that mask.
    """
    count = (1 << (radius + 1)) - 1
    vectors = [i % count + 1 for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, count + 1)
    ]


def links(values: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at ``radius`` or fewer bits.

    A bucket is the set of values equal under one mask. Instead of comparing the pairs of a
    bucket, each value that has company is listed under itself and under every value one flip of
    an unmasked bit away. Two values differ in two bits or fewer exactly if they share such an
    entry, and at most 65 values can share one, whatever the size of a bucket. With ``radius`` 1
    only entries that are values themselves count.
    """
    if radius == 0:
        return values.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if radius not in (1, 2):
        raise ValueError("the distance may be 0, 1 or 2 bits")
    masks = covering_masks(radius)
    tables = [
        F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for v, mask in enumerate(masks)
    ]
    keys = values.select("fp", F.inline(F.array(*tables)))
    shared = keys.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    free = F.element_at(
        F.array(*(F.lit(_signed(~mask & ((1 << BITS) - 1))) for mask in masks)), F.col("v") + 1
    )
    company = (
        keys.join(shared.select("v", "key"), ["v", "key"])
        .groupBy("fp")
        .agg(F.bit_or(free).alias("free"))
    )
    flips = [
        F.when(F.col("free").bitwiseAND(F.lit(bit)) != 0, F.col("fp").bitwiseXOR(F.lit(bit)))
        for bit in (_signed(1 << i) for i in range(BITS))
    ]
    entries = company.select("fp", F.explode(F.array_compact(F.array("fp", *flips))).alias("at"))
    met = entries.groupBy("at").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    if radius == 1:
        met = met.where("array_contains(fps, at)")
    hub = F.col("at") if radius == 1 else F.array_min("fps")
    met = met.select(F.explode("fps").alias("a"), hub.alias("b"))
    return met.where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(doc, fp, component) for every row of ``docs``.

    The component is the smallest id reachable over links of ``radius`` or fewer differing bits.
    NULL and wordless texts have fingerprint zero and link like any other; rows with a NULL id
    join their group and take its smallest id, NULL if it has none; repeated rows give repeated
    results; an empty table gives no rows; other columns are not read.
    """
    marked = stage(fingerprints(docs, id_col, text_col, length), "fingerprints")
    values = stage(marked.groupBy("fp").agg(F.min("doc").alias("low")), "values")
    rooted = _rooted(values, radius)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = stage(rooted.join(lowest, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select("doc", "fp", "component")


def _rooted(values: DataFrame, radius: int) -> DataFrame:
    """(fp, low, root) for ``values`` (fp, low): the root is one fingerprint of the group."""
    roots = stage(components(links(values, radius)), "roots")
    return values.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )


def fingerprint_hex(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``docs`` without the near-duplicates: of each group the row with the smallest id stays.

    Rows are judged, not ids: of rows that share an id each goes or stays with the group of its own
    text. Within a group rows with an id come before those without, and rows that share the smallest
    id are told apart by a hash of their text; of equal rows one stays. An empty table gives no rows.
    """
    names = []
    for name in ("row", "none", "own", "mark"):
        while name in [c.lower() for c in docs.columns]:
            name = "_" + name
        names.append(name)
    row, none, own, mark = names
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    numbered = stage(numbered, "numbered", "zstd")  # a row keeps its number whatever is computed again
    id_ = F.col(f"`{id_col}`")
    chosen = numbered.select(
        f"`{text_col}`",
        F.col(row),
        id_.isNull().alias(none),
        id_.cast("long").alias(own),
        F.xxhash64(f"`{text_col}`").alias(mark),
    )
    marked = fingerprints(chosen, row, text_col, length, [none, own, mark])
    first = F.min(F.struct(none, own, mark, "doc")).alias("low")
    values = stage(marked.groupBy("fp").agg(first), "values")
    kept = _rooted(values, radius).groupBy("root").agg(F.min("low").alias("low"))
    kept = stage(kept.select(F.col("low.doc").alias(row)), "kept")
    return numbered.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
