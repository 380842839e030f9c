"""Approximate nearest neighbours by cosine: NN-descent builds a graph, greedy search reads it.

Nodes are the distinct vectors; copies of a vector share its node. Every node starts with its
nearest among the 256 to 511 nodes beside it in an order of random-hyperplane signs. A round of the
descent brings each node's neighbours, and the nodes nearest to it that list it, together: all of
these are neighbours of neighbours, and whichever is nearer to another than what that one lists is
offered to it. Rounds end when few lists change. A query starts at its own node, and each round
scores the neighbours of all nodes among its nearest so far that were not expanded yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.joins import salted_join
from touchline.operators.keys import contiguous_ids
from touchline.session import stage, unstage

#: Neighbours a node lists, nodes of a first block at least, and orders that make first blocks.
LISTED, BLOCK, ORDERS = 32, 256, 2
#: The descent ends with a round that changes a smaller share of the listed neighbours.
CHANGED = 0.15
#: Nearest nodes that a query keeps and expands. It decides recall; see the README.
BEAM = 128
_PLANES = 24


def _units(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Unit vectors as the rows of a matrix, from packed floats."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32)
    return data.reshape(len(column), -1 if len(column) else width or 0)


def _scaled(vector: list[float]) -> np.ndarray:
    """The vector times a power of two, which changes no cosine and keeps squares in range."""
    values = np.array(vector, dtype=np.float64)
    return np.ldexp(values, -np.frexp(np.abs(values).max())[1])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the rows that take part, each id once."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")
    ).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.where(f"{finite} AND exists(vec, x -> x <> 0)")
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, copies, vec, unit) of the distinct vectors; a node has the smallest id of its copies."""
    schema = "node long, copies long, vec array<double>, unit binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = [_scaled(v) for v in batch.column(2).to_pylist()]
            units = [(v / np.linalg.norm(v)).astype(np.float32).tobytes() for v in scaled]
            columns = [*batch.columns, pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "copies", "vec", "unit"])

    folded = rows.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    return folded.select("node", "copies", "vec").mapInArrow(work, schema)


def _signs(nodes: DataFrame, seed: int) -> DataFrame:
    """``nodes`` with the sides of random hyperplanes on which they lie, as the bits of a number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch.column(1))
            planes = np.random.default_rng(seed).normal(size=(units.shape[1], _PLANES))
            bits = (units.astype(np.float64) @ planes > 0) @ (1 << np.arange(_PLANES)[::-1])
            columns = [*batch.columns, pa.array(bits.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "unit", "signs"])

    return nodes.select("node", "unit").mapInArrow(work, "node long, unit binary, signs long")


def _best(keys: np.ndarray, others: np.ndarray, sims: np.ndarray, most: int) -> tuple:
    """Rows of the ``most`` nearest others of each key, each once, nearest first."""
    order = np.lexsort((-sims, others, keys))
    keys, others, sims = keys[order], others[order], sims[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    keys, others, sims = keys[first], others[first], sims[first]
    order = np.lexsort((others, -sims, keys))
    keys, others, sims = keys[order], others[order], sims[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(keys)))
    chosen = np.arange(len(keys)) - np.repeat(starts, sizes) < most
    return keys[chosen], others[chosen], sims[chosen]


_OFFER = "node long, others array<long>, sims array<float>"


def _lists(keys: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, int)
    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
    columns = [
        pa.array(keys[starts].astype(np.int64)),
        pa.ListArray.from_arrays(offsets, pa.array(others.astype(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["node", "others", "sims"])


def _offers(groups: DataFrame, listed: int) -> DataFrame:
    """(node, others, sims): what the members of each group can better each other's lists by.

    ``groups`` has ``members`` (node, least, unit); ``least`` is the farthest similarity that a
    node lists. Offers of an Arrow batch are cut to the nearest of each node before they travel.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0):
                rows = members.values
                nodes, at = np.unique(rows.field("node").to_numpy(), return_index=True)
                if len(nodes) < 2:
                    continue
                units = _units(rows.field("unit"))[at]
                least = rows.field("least").to_numpy()[at]
                sims = units @ units.T
                np.fill_diagonal(sims, -9)
                if len(nodes) > 2 * listed:
                    bound = np.partition(sims, len(nodes) - listed, axis=1)[:, len(nodes) - listed]
                    least = np.maximum(least, np.nextafter(bound, np.float32(-9)))
                a, b = np.nonzero(sims > np.maximum(least, np.float32(-8))[:, None])
                found.append((nodes[a], nodes[b], sims[a, b]))
            if found:
                yield _lists(*_best(*(np.concatenate(c) for c in zip(*found)), listed))

    return groups.select("members").mapInArrow(work, _OFFER)


def _merged(graph: DataFrame, offers: DataFrame, listed: int) -> DataFrame:
    """``graph`` (node, unit, others, sims, least, changed) after the offers."""
    gathered = offers.groupBy("node").agg(
        F.flatten(F.collect_list("others")).alias("new"),
        F.flatten(F.collect_list("sims")).alias("new_sims"),
    )
    joined = graph.select("node", "unit", "others", "sims").join(gathered, "node", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, changed, lists, sims = batch.column(0), [], [], []
            for old, own, new, near in zip(*(batch.column(k) for k in (2, 3, 4, 5))):
                before = old.values.to_numpy()
                if not new.is_valid:
                    lists.append(before)
                    sims.append(own.values.to_numpy())
                    changed.append(0)
                    continue
                others = np.concatenate([before, new.values.to_numpy()])
                values = np.concatenate([own.values.to_numpy(), near.values.to_numpy()])
                _, others, values = _best(np.zeros(len(others), np.int64), others, values, listed)
                lists.append(others)
                sims.append(values)
                changed.append(len(np.setdiff1d(others, before)))
            least = [float(s[-1]) if len(s) == listed else -9.0 for s in sims]
            columns = [
                nodes,
                batch.column(1),
                pa.array(lists, pa.list_(pa.int64())),
                pa.array(sims, pa.list_(pa.float32())),
                pa.array(least, pa.float32()),
                pa.array(changed, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, _GRAPH.split(" ")[::2])

    return joined.mapInArrow(work, _GRAPH)


_GRAPH = "node long, unit binary, others array<long>, sims array<float>, least float, changed long"


def _first_offers(nodes: DataFrame, count: int, listed: int) -> DataFrame:
    """Offers within blocks of nodes that are neighbours in an order of signs."""
    blocks = max(1, count // BLOCK)
    offers: DataFrame | None = None
    for seed in range(ORDERS):
        placed = contiguous_ids(_signs(nodes, seed), ["signs", "xxhash64(node)", "node"], "place")
        member = F.struct("node", F.lit(-9.0).cast("float").alias("least"), "unit")
        block = F.expr(f"((place - 1) * {blocks}) DIV {count}").alias("block")
        groups = placed.groupBy(block).agg(F.collect_list(member).alias("members"))
        found = _offers(groups, listed)
        offers = found if offers is None else offers.union(found)
    return offers


def _circles(graph: DataFrame, listed: int) -> DataFrame:
    """``members`` of each node: what it lists, the nearest that list it, and itself."""
    ahead = graph.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e")).select(
        "node", F.col("e.others").alias("other"), F.col("e.sims").alias("sim")
    )
    nearest = Window.partitionBy("other").orderBy(F.desc("sim"), "node")
    back = (
        ahead.withColumn("place", F.row_number().over(nearest))
        .where(F.col("place") <= listed)
        .select(F.col("other").alias("centre"), "node")
    )
    # The nearest that list a node are cut before the shuffle too, so that a node that very many
    # list gathers few rows; where it is a member itself, the join can be split.
    pairs = ahead.select(F.col("node").alias("centre"), F.col("other").alias("node")).union(back)
    own = graph.select("node", "least", "unit")
    members = pairs.join(own, "node").union(
        own.select("node", F.col("node").alias("centre"), "least", "unit")
    )
    return members.groupBy("centre").agg(
        F.collect_list(F.struct("node", "least", "unit")).alias("members")
    )


def build_graph(nodes: DataFrame, listed: int = LISTED, changed: float = CHANGED) -> DataFrame:
    """The neighbour graph of ``nodes`` (node, unit), staged: every node is listed with its nearest
    found. Each round is written, so lost executors cost one round at most."""
    count = nodes.count()
    empty = nodes.select(
        "node",
        "unit",
        F.expr("CAST(array() AS array<bigint>)").alias("others"),
        F.expr("CAST(array() AS array<float>)").alias("sims"),
    )
    graph = stage(_merged(empty, _first_offers(nodes, count, listed), listed), "graph")
    listings = graph.agg(F.coalesce(F.sum(F.size("others")), F.lit(0))).first()[0]
    while listings:
        used = graph
        graph = stage(_merged(graph, _offers(_circles(graph, listed), listed), listed), "graph")
        unstage(used)
        if graph.agg(F.sum("changed")).first()[0] < changed * listings:
            break
    return graph


_STATE = (
    "node long, unit binary, pool array<long>, sims array<float>, open array<long>, seen array<long>"
)


def greedy_search(graph: DataFrame, starts: DataFrame, beam: int = BEAM) -> DataFrame:
    """(node, pool): the nearest nodes found of each of ``starts`` (node), itself among them.

    A round expands every node of a pool that was not expanded, and scores those it leads to
    which the query has not seen. A query ends when its pool has no such node.
    """
    kept = graph.select("node", "unit", "others")
    state = kept.join(starts, "node", "left_semi").selectExpr(
        "node", "unit", "array(node) AS pool", "array(float(1)) AS sims", "array(node) AS open",
        "array(node) AS seen",
    )
    state, ended = stage(state, "search"), []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for unit, pool, sims, opened, seen, met in zip(
                batch.column(1), *(batch.column(k) for k in range(2, 7))
            ):
                own = np.frombuffer(unit.as_buffer(), dtype=np.float32)
                places, values = pool.values.to_numpy(), sims.values.to_numpy()
                before = seen.values.to_numpy()
                if met.is_valid:
                    fresh = met.values.field("node").to_numpy()
                    near = _units(met.values.field("unit")) @ own
                    places, values = np.append(places, fresh), np.append(values, near)
                    before = np.append(before, fresh)
                    order = np.lexsort((places, -values))[:beam]
                    places, values = places[order], values[order]
                    fresh = np.intersect1d(places, fresh)
                else:
                    fresh = np.empty(0, np.int64)
                for column, value in zip(out, (places, values, fresh, before)):
                    column.append(value)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(out[0], pa.list_(pa.int64())),
                pa.array(out[1], pa.list_(pa.float32())),
                pa.array(out[2], pa.list_(pa.int64())),
                pa.array(out[3], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, _STATE.replace(",", "").split(" ")[::2])

    while not state.where("size(open) > 0").isEmpty():
        active = state.where("size(open) > 0")
        fronts = active.select(F.col("node").alias("query"), F.explode("open").alias("node"))
        led = fronts.join(kept.select("node", "others"), "node")
        led = led.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("led"))
        fresh = led.join(active.select(F.col("node").alias("query"), "seen"), "query").select(
            "query", F.explode(F.array_except("led", "seen")).alias("node")
        )
        met = fresh.join(kept.select("node", "unit"), "node").groupBy("query")
        met = met.agg(F.collect_list(F.struct("node", "unit")).alias("met"))
        stepped = active.join(met.withColumnRenamed("query", "node"), "node", "left")
        ended.append(state)
        state = stage(stepped.mapInArrow(work, _STATE), "search")
    found = state
    for earlier in ended:
        found = found.union(earlier.where("size(open) = 0"))
    return found.select("node", "pool")


def _scores(pools: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, score): cosines of the original vectors in double precision."""
    vectors = nodes.select("node", "vec")
    pairs = pools.select(F.col("node").alias("query"), F.explode("pool").alias("node"))
    met = pairs.join(vectors, "node").groupBy("query").agg(
        F.collect_list(F.struct("node", "vec")).alias("met")
    )
    joined = met.join(vectors.select(F.col("node").alias("query"), "vec"), "query")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, met, vector in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = _scaled(vector)
                size = np.sqrt(own @ own)
                others = [_scaled(v) for v in met.values.field("vec").to_pylist()]
                values = [(own @ v) / (size * np.sqrt(v @ v)) for v in others]
                columns = [
                    pa.array([query] * len(values), pa.int64()),
                    met.values.field("node"),
                    pa.array(values, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query", "node", "score"])

    return joined.mapInArrow(work, "query long, node long, score double")


def _first(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` nearest rows of each ``by``, ties by the smaller id, with their ``rank``."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest(
    vectors: DataFrame,
    every: int,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    listed: int = LISTED,
    beam: int = BEAM,
) -> DataFrame:
    """(query, rank, id, score): the ``k`` nearest found of every row whose id ``every`` divides.

    Candidates are all rows but the query's own; ``score`` is the cosine of the vectors, in double
    precision; ties go to the smaller id. With fewer candidates a query gets all of them.

    Rows without an id, and vectors that are NULL, empty, zero or hold a NULL or non-finite
    component, take no part; of rows that share an id the one with the smallest vector does, and so do the
    vectors of the most frequent length (ties: the shortest) only. Copies of a vector are one node
    of the graph and separate candidates. An empty table gives no rows; other columns are not read.
    """
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    widths = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width")
    width = (widths.first() or (0,))[0]
    rows = rows.where(F.size("vec") == width)
    nodes = stage(_nodes(rows), "nodes")
    graph = build_graph(nodes.select("node", "unit"), listed)
    # Copies: every other vector is its own and only member.
    several = nodes.where("copies > 1").select("vec", "node")
    copies = salted_join(rows, several, ["vec"], spread_by=["id"]).select("id", "node")
    alone = nodes.where("copies = 1").select(F.col("node").alias("id"), "node")
    places = stage(copies.union(alone), "places")
    queries = places.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "node")
    pools = greedy_search(graph, queries.select("node").distinct(), beam)
    scored = stage(_scores(pools, nodes).withColumnRenamed("node", "id"), "scores")
    # No more than k + 1 nodes, and members of a node, can be among the k + 1 nearest.
    best = _first(scored, "query", k + 1).withColumnRenamed("id", "node").drop("rank")
    smallest = Window.partitionBy("node").orderBy("id")
    members = places.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    lists = _first(best.join(members, "node").select("query", "id", "score"), "query", k + 1)
    lists = lists.groupBy(F.col("query").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found")
    )
    own = salted_join(queries, lists, ["node"], spread_by=["query"])
    others = own.withColumn("found", F.slice(F.expr("filter(found, x -> x.id <> query)"), 1, k))
    return others.select("query", F.posexplode("found").alias("at", "x")).select(
        "query", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score")
    )
