"""Chat logs collapsed to their longest snapshots and rendered, in DataFrame expressions only.

Logged conversations often repeat: every turn writes the conversation so far. A conversation that
is the beginning of another one adds nothing and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import stage

#: Turn numbers per block; a conversation is numbered and hashed block by block, in many tasks.
BLOCK = 256
_MARKERS = r"<\|im_(start|end)\|>"


def _before(value: str, kind: str) -> Column:
    """Sum or xor of the earlier blocks of the conversation."""
    window = "PARTITION BY conv ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return F.expr(f"coalesce({kind}({value}) OVER ({window}), 0L)")


def turn_prefixes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str):
    """(conv, place, role, text, p1, p2): turns numbered from 1, with rolling prefix hashes.

    The hash of a prefix is the exclusive or of hashes of its turns and their places, 128 bits in
    two halves, so blocks of turns can be hashed apart and put together.
    """
    rows = (
        turns.select(
            F.col(conv_col).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            F.col(role_col).cast("string").alias("role"),
            F.col(text_col).cast("string").alias("text"),
        )
        .where("conv IS NOT NULL")
        .distinct()
        .withColumn("block", F.expr(f"floor(turn / {BLOCK})"))
    )
    rows = rows.withColumn("block", F.coalesce("block", F.lit(-(1 << 62))))
    rows = stage(rows, "turns")
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv", "block", _before("n", "sum").alias("offset"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("own", F.row_number().over(order)).join(sizes, ["conv", "block"])
    placed = placed.withColumn("place", F.col("own") + F.col("offset"))
    content = "place, role IS NULL, coalesce(role, ''), text IS NULL, coalesce(text, '')"
    placed = placed.withColumns(
        {"h1": F.expr(f"xxhash64(1, {content})"), "h2": F.expr(f"xxhash64(2, {content})")}
    )
    placed = stage(
        placed.select("conv", "block", "place", "role", "text", "h1", "h2"), "placed"
    )
    blocks = placed.groupBy("conv", "block").agg(
        F.expr("bit_xor(h1)").alias("x1"), F.expr("bit_xor(h2)").alias("x2")
    )
    blocks = blocks.select(
        "conv", "block", *(_before(f"x{k}", "bit_xor").alias(f"x{k}") for k in (1, 2))
    )
    rolling = (
        "bit_xor({}) OVER (PARTITION BY conv, block ORDER BY place"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    prefixes = placed.select(
        "conv", "block", "place", *(F.expr(rolling.format(f"h{k}")).alias(f"r{k}") for k in (1, 2))
    )
    prefixes = prefixes.join(blocks, ["conv", "block"]).select(
        "conv", "place", *(F.expr(f"r{k} ^ x{k}").alias(f"p{k}") for k in (1, 2))
    )
    return placed.select("conv", "place", "role", "text"), stage(prefixes, "prefixes")


def render(role: str, text: str) -> Column:
    """One turn between markers; markers inside a text are taken out of it."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _MARKERS, "")
    who = F.regexp_replace(F.coalesce(F.col(role), F.lit("")), _MARKERS, "")
    return F.concat(
        F.lit("<|im_start|>"), who, F.lit("\n"), clean, F.lit("<|im_end|>\n")
    )


def maximal_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, n_turns, n_copies, text): conversations that begin no longer one, rendered.

    Of conversations with the same turns the smallest id stays and ``n_copies`` counts them.
    Turns follow their numbers, NULL first, then role and text; gaps between numbers don't matter
    and a row that is there twice counts once. NULL roles and texts are rendered as empty but
    differ from empty ones. Rows without a conversation id belong to none and are left out; an
    empty table gives no rows; other columns are not read.

    A prefix that many conversations share is folded before it is joined, and a conversation with
    very many turns is numbered and hashed in blocks; only its rendered text is one row.
    """
    placed, prefixes = turn_prefixes(turns, conv_col, turn_col, role_col, text_col)
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("place", "p1", "p2")).alias("e"))
    ends = stage(ends.select("conv", "e.*"), "ends")
    kinds = ends.groupBy("place", "p1", "p2").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_copies")
    )
    # Every prefix but the whole conversation.
    shorter = prefixes.join(
        ends.select("conv", F.col("place").alias("last")), "conv"
    ).where("place < last")
    shorter = shorter.groupBy("place", "p1", "p2").agg(F.count("*").alias("n")).drop("n")
    kept = stage(kinds.join(shorter, ["place", "p1", "p2"], "left_anti"), "maximal")
    told = placed.join(kept.select("conv"), "conv", "left_semi").select(
        "conv", F.struct("place", render("role", "text").alias("said")).alias("t")
    )
    texts = told.groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list("t"))["said"], "").alias("text")
    )
    return kept.join(texts, "conv").select(
        "conv", F.col("place").cast("long").alias("n_turns"), "n_copies", "text"
    )
