"""Merkle manifests: one root over all rows, and a path from every row to it.

The rows of a group are ordered by id through bitmaps. A bitmap word holds 64 neighbouring ids, only
words that hold any are kept, and tasks merge theirs by OR. The directory gives each word the number
of rows before it, so that the coordinate of a row is that number and the bits set below its own; no
leaf is ever sorted. Rows that share an id, or have none, can't be told apart by bits: they are
numbered by id, leaf and place of reading. Levels are reduced from slots: the rows of 512
coordinates fill one array by their place in it, which gives three levels of eight at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.suffixes import counts_below
from touchline.operators.joins import salted_join
from touchline.operators.keys import contiguous_ids
from touchline.session import stage, unstage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that one array of slots reduces.
FANOUT = 8
LEVELS = 3
_SLOTS = FANOUT**LEVELS
#: Word of the rows without an id. Ids divided by 64 never reach it, and it comes before them.
_NO_ID = -(1 << 63)

_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text; ``-`` if NULL."""
    texts = [field.cast("string") for field in fields]
    written = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(w, F.lit("-")) for w in written)), 256)


def proof_digest(path: str) -> Column:
    """Digest of all siblings along a path, from the leaf up and from left to right."""
    pieces = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(pieces, ""), 256)


def folded(path: str, start: Column) -> Column:
    """The root that a leaf digest and the siblings along its path lead to."""
    return F.aggregate(
        path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256)
    )


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(size: int) -> int:
    """Levels that one array of slots reduces in a tree of ``size`` nodes."""
    height = 0
    while height < LEVELS and size > FANOUT**height:
        height += 1
    return height


def _levels(digests: list[str], height: int) -> list[list[str]]:
    levels = [digests]
    for _ in range(height):
        below = levels[-1]
        runs = range(0, len(below), FANOUT)
        levels.append([_digest("".join(below[i : i + FANOUT])) for i in runs])
    return levels


def _siblings(nodes: list[str]) -> list[tuple[str, str]]:
    out = []
    for start in range(0, len(nodes), FANOUT):
        run = nodes[start : start + FANOUT]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def _tops(blocks: DataFrame) -> DataFrame:
    """(tree, idx, n, digest): the node that a block of slots comes to, in a tree of n such."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for size, slots in zip(batch["n"].to_pylist(), batch["slots"]):
                digests = slots.values.field("digest").to_pylist()
                found.append(_levels(digests, _height(size))[-1][0])
            sizes = [-(-size // _SLOTS) for size in batch["n"].to_pylist()]
            columns = [batch["tree"], batch["idx"], pa.array(sizes, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "n", "digest"])

    return blocks.mapInArrow(work, "tree long, idx long, n long, digest string")


def _climb(nodes: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Paths of ``nodes`` (tree, idx, n, digest, ``carry``): (tree, ``carry``, digest, path, top)
    and, of each tree, (tree, top).

    A tree of n nodes has each idx below n once. One shuffle fills the slots of 512 nodes and
    gives three levels; what they come to is climbed the same way, so that there are few rounds.
    """
    kept = ["tree", *carry, "digest"]
    if nodes.where("n > 1").isEmpty():
        none = F.array().cast(_PATH).alias("path")
        top = F.col("digest").alias("top")
        return nodes.select(*kept, none, top), nodes.select("tree", top)
    slot = F.struct((F.col("idx") % _SLOTS).alias("slot"), "digest", *carry)
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / _SLOTS).alias("idx")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(slot)).alias("slots")
    )
    blocks = stage(grouped, "slots")
    tops = stage(_tops(blocks), "tops")
    above, roots = _climb(tops, ["idx"])
    joined = blocks.join(above.select("tree", "idx", "path", "top"), ["tree", "idx"])
    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", path {_PATH}, top string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, size, slots, path, top in zip(
                batch["tree"].to_pylist(), batch["n"].to_pylist(), batch["slots"],
                batch["path"].to_pylist(), batch["top"].to_pylist(),
            ):
                rows = slots.values
                digests = rows.field("digest").to_pylist()
                height, count = _height(size), len(digests)
                steps = [_siblings(level) for level in _levels(digests, height)[:height]]
                rest = [(step["left"], step["right"]) for step in path]
                flat = [
                    step
                    for i in range(count)
                    for step in (*(own[i // FANOUT**k] for k, own in enumerate(steps)), *rest)
                ]
                each = height + len(rest)
                pairs = pa.StructArray.from_arrays(
                    [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())],
                    ["left", "right"],
                )
                offsets = pa.array(range(0, (count + 1) * each, each) if each else [0] * (count + 1), pa.int32())
                columns = [
                    pa.array([tree] * count, pa.int64()),
                    *(rows.field(c) for c in carry),
                    rows.field("digest"),
                    pa.ListArray.from_arrays(offsets, pairs).cast(_PATH_TYPE),
                    pa.array([top] * count, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "path", "top"])

    return joined.mapInArrow(work, schema), roots


def _ordered(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (tree, doc, digest, row, ...) with idx, their place in the tree, and its size n.

    Every word of 64 ids is one row of the directory, which tells how many rows come before it;
    a range shuffle of the words makes these numbers. A row finds its own by a join and counts the
    bits below its own.
    """
    word = F.coalesce(F.shiftright("doc", 6), F.lit(_NO_ID))
    marked = rows.withColumn("word", word)
    bit = F.expr("if(doc IS NULL, 0L, shiftleft(1L, CAST(doc & 63 AS INT)))")
    merged = marked.groupBy("tree", "word").agg(
        F.bit_or(bit).alias("mask"), F.count("*").alias("rows")
    )
    merged = merged.withColumn("tied", F.expr("if(rows > bit_count(mask), rows, 0L)"))
    bitmaps = stage(merged, "bitmaps")
    scratch: list[DataFrame] = []
    before = counts_below(bitmaps, ["tree", "word"], ["rows", "tied"], scratch)
    words = bitmaps.join(before, ["tree", "word"]).join(groups.select("tree", "first", "n"), "tree")
    directory = stage(
        words.select(
            "tree", "word", "mask", "tied", "n", "below_tied",
            (F.col("below_rows") - F.col("first")).alias("before"),
        ),
        "directory",
    )
    unstage(bitmaps, *scratch)
    found = marked.join(directory, ["tree", "word"])
    below = F.expr("bit_count(mask & ~shiftleft(-1L, CAST(doc & 63 AS INT)))")
    plain = found.where("tied = 0").withColumn("idx", F.col("before") + below)
    kept = [*rows.columns, "idx", "n"]
    if directory.where("tied > 0").isEmpty():
        return plain.select(*kept)
    several = contiguous_ids(
        found.where("tied > 0"), ["tree", "word", "doc", "digest", "row"], "place"
    )
    several = several.withColumn("idx", F.expr("before + place - 1 - below_tied"))
    return plain.select(*kept).unionByName(several.select(*kept))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(doc, group, leaf, path, subroot, root and the columns of ``carry``) for every row of ``docs``.

    The leaf is the digest of ``fields``. Leaves of a group ascend by id; every eight neighbours
    become their digest, level by level, until one is left, the subroot; subroots, ordered by group,
    give the root the same way. ``path`` has the digests to the left and right of a row's node at
    every level up to the root.

    A NULL field is written as ``-``; NULL is a group of its own, the first, and a NULL id the
    first of its group. Rows that share an id are ordered by leaf; rows that are equal get
    neighbouring places. An empty table gives no rows; other columns are not read. ``carry`` names
    expressions over ``docs`` that travel with the row.
    """
    carried = dict(carry or {})
    names = [f"carried_{i}" for i in range(len(carried))]
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("group"),
        leaf([F.col(c) for c in fields]).alias("digest"),
        *(column.alias(name) for name, column in zip(names, carried.values())),
    )
    leaves = stage(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    scratch: list[DataFrame] = []
    counts = leaves.groupBy("group").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    counts = stage(counts, "counts")
    ranks = counts_below(counts, ["group"], ["n", "one"], scratch)
    groups = counts.join(ranks, "group").select(
        "group", "n", F.col("below_n").alias("first"), F.col("below_one").alias("tree")
    )
    groups = stage(groups, "groups")
    unstage(counts, *scratch)
    rows = salted_join(leaves, groups.select("group", "tree"), ["group"], spread_by=["row"])
    placed, roots = _climb(_ordered(rows, groups), ["doc", *names])
    trees = groups.count()
    subroots = roots.select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("idx"),
        F.lit(trees).cast("long").alias("n"),
        F.col("top").alias("digest"),
        F.col("tree").alias("own"),
    )
    upper, _ = _climb(stage(subroots, "subroots"), ["own"])
    upper = stage(
        upper.select(F.col("own").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root")).join(
            groups.select("tree", "group"), "tree"
        ),
        "upper",
    )
    found = salted_join(placed, upper, ["tree"], spread_by=["doc", "digest"])
    return found.select(
        "doc",
        F.expr("if(group = '0', NULL, substr(group, 2))").alias("group"),
        F.col("digest").alias("leaf"),
        F.concat("path", "upper").alias("path"),
        F.col("top").alias("subroot"),
        "root",
        *(F.col(name).alias(own) for name, own in zip(names, carried)),
    )


def ascii_lower(column: str) -> Column:
    """The text with A to Z lower-cased and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
