"""Byte-level BPE as recursive DuckDB queries inside Spark tasks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import map_rows, raw, remembered, slices

#: Pieces whose ids a worker remembers; beyond that those not met again are forgotten.
REMEMBERED = 250_000
#: Bytes of text, about, that a worker encodes at a time.
TEXT_BYTES = 3_000_000
_STEPS = 64  # contractions in one recursive query, whose steps all stay in memory
_LONG = 64  # tokens beyond which a step contracts every place of the pair
#: Bytes beyond which a piece is contracted by changed places alone; see ``_contract_far``.
_FAR = 1_024
_DECODED = 500_000  # ids decoded in one query

_CONTRACT = f"""
WITH RECURSIVE contract(word, toks, step, done) AS (
    SELECT word, toks, 0, false FROM words
    UNION ALL
    SELECT word,
        CASE WHEN place IS NULL THEN toks
            WHEN len(toks) <= {_LONG} OR toks[place] = toks[place + 1]
            THEN toks[: place - 1] || [merged] || toks[place + 2 :]
            ELSE list_filter([
                CASE WHEN toks[i] = toks[place] AND toks[i + 1] = toks[place + 1] THEN merged
                     WHEN toks[i - 1] = toks[place] AND toks[i] = toks[place + 1] THEN NULL
                     ELSE toks[i] END
                for i in range(1, len(toks) + 1)], lambda x : x IS NOT NULL) END,
        step + 1, place IS NULL
    FROM (
        SELECT c.word, toks, step,
            CAST(best // 4294967296 AS INTEGER) AS merged, best % 4294967296 AS place
        FROM contract c LEFT JOIN (
            SELECT word, min(id * 4294967296 + pos) AS best
            FROM (SELECT word, unnest(toks[: -2]) AS tok, unnest(toks[2 :]) AS following,
                      unnest(range(1, len(toks))) AS pos
                  FROM contract WHERE NOT done AND step < {_STEPS})
            JOIN merges ON a = tok AND b = following
            GROUP BY word) m ON c.word = m.word
        WHERE NOT done AND step < {_STEPS}))
SELECT word, toks, done FROM contract WHERE done OR step = {_STEPS}
"""

_DECODE = """
SELECT part, string_agg(chars, '' ORDER BY pos) AS chars, count(*) AS n
FROM ids JOIN vocabulary USING (id) GROUP BY part ORDER BY part
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Ids of texts and bytes of ids for one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.octets = np.array([ranks[bytes([c])] for c in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '300MB'; SET temp_directory = ''")
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None
            and (right := ranks.get(token[i:])) is not None
        ]
        a, b, ids = (np.array(column, dtype=np.int64) for column in zip(*pairs or [(-1, -1, -1)]))
        self._create("merges", {"a": a.astype(np.int32), "b": b.astype(np.int32), "id": ids})
        codes = a << 32 | b
        order = np.argsort(codes)
        self.codes, self.merged = codes[order], ids[order]
        # DuckDB's ordered text aggregation joins text, so bytes travel as the first 256 characters.
        chars = [token.decode("latin-1") for token in ranks]
        self._create("vocabulary", {"id": np.array([*ranks.values()], np.int64), "chars": chars})

    def _create(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.db.register(name, rows)
        found = self.db.sql(sql).to_arrow_table().combine_chunks()
        for name in tables:
            self.db.unregister(name)
        return found

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Contracts leftmost minimum-rank pairs until none is left.

        The recursion ends after ``_STEPS`` steps and goes on from the last one, which bounds the
        rows it holds. In a long piece one step contracts every place of the pair: the places
        don't overlap, and a pair that a contraction brings about never ranks before it.
        """
        done: list[bytes] = [b""] * len(pieces)
        octets = self.octets[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
        words = pa.table(
            {
                "word": np.arange(len(pieces)),
                "toks": pa.ListArray.from_arrays(offsets, pa.array(octets)),
            }
        )
        while words.num_rows:
            found = self._query(_CONTRACT, words=words)
            ended = found.filter(found["done"]).combine_chunks()
            if ended.num_rows:
                toks = ended["toks"].combine_chunks()
                ids = toks.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(toks.value_lengths().to_numpy())]) * 4
                for word, start, stop in zip(
                    ended["word"].to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()
                ):
                    done[word] = ids[start:stop]
            words = found.filter(pa.compute.invert(found["done"])).select(["word", "toks"])
        return done

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair contracts to, -1 where nothing does."""
        codes = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.merged[at], -1)

    def _contract_far(self, piece: bytes) -> bytes:
        """Contracts a very long piece, looking again only at places beside a contraction.

        The rows are the same (token, place), with the places before and after. Places wait by the
        rank of their pair; a step takes all places of the least rank, every second one of a run,
        and ranks the pairs that begin or end there anew.
        """
        toks = self.octets[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
        n = len(toks)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        current = np.append(self._ranks(toks[:-1], toks[1:]), -1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = current[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-2))
            for rank, part in zip(ranks[starts].tolist(), np.split(places, starts[1:])):
                if rank < 0:
                    continue
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(part)

        wait(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[current[at] == rank]
            if not len(at):
                continue
            fresh = np.concatenate(([True], at[1:] != after[at[:-1]]))
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            toks[at] = rank
            after[at] = further = after[gone]
            current[gone] = -1
            inside = further < n
            before[further[inside]] = at[inside]
            beside = before[at]
            near = np.unique(np.concatenate([at, beside[beside >= 0]]))
            follows = after[near]
            pairs = np.full(len(near), -1, dtype=np.int64)
            paired = follows < n
            pairs[paired] = self._ranks(toks[near[paired]], toks[follows[paired]])
            current[near] = pairs
            wait(near)
        places, place = [], 0
        whole = np.zeros(n, dtype=bool)
        steps = after.tolist()
        while place < n:
            places.append(place)
            place = steps[place]
        whole[places] = True
        return toks[whole].astype("<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Ids of the pieces that are not known."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        rest: list[str] = []
        for piece in pieces:
            ids = self.older.get(piece) or self.whole.get(piece.encode())
            if ids:
                self.known[piece] = ids
            else:
                rest.append(piece)
        far = [piece for piece in rest if len(piece) > _FAR or len(piece.encode()) > _FAR]
        self.known.update((piece, self._contract_far(piece.encode())) for piece in far)
        near = [piece for piece in rest if piece not in self.known] if far else rest
        if near:
            self.known.update(zip(near, self._contract([piece.encode() for piece in near])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.pattern.findall(text) for text in texts]
        pieces = set().union(*cut)
        if len(self.known) > REMEMBERED:
            self._learn(pieces)
        else:
            self._learn(pieces.difference(self.known))
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence; a long one is decoded in parts."""
        parts: list[tuple[int, np.ndarray]] = []
        for k, ids in enumerate(encoded):
            values = np.frombuffer(ids, dtype="<u4")
            parts += [(k, values[i : i + _DECODED]) for i in range(0, len(values), _DECODED)]
        out: list[list[bytes]] = [[] for _ in encoded]
        start = 0
        while start < len(parts):
            stop, total = start, 0
            while stop < len(parts) and (total == 0 or total + len(parts[stop][1]) <= _DECODED):
                total += len(parts[stop][1])
                stop += 1
            for (k, _), text in zip(parts[start:stop], self._decode([v for _, v in parts[start:stop]])):
                out[k].append(text)
            start = stop
        return [b"".join(pieces) for pieces in out]

    def _decode(self, parts: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(part) for part in parts])
        rows = pa.table(
            {
                "part": np.repeat(np.arange(len(parts), dtype=np.int32), sizes),
                "pos": np.arange(sizes.sum(), dtype=np.int32),
                "id": np.concatenate(parts).astype(np.int64),
            }
        )
        found = self._query(_DECODE, ids=rows)
        if found["n"].to_pylist() != sizes.tolist():
            raise ValueError("an id is not in the vocabulary")
        return [chars.encode("latin-1") for chars in found["chars"].to_pylist()]


@remembered
def codec(path: str, pattern: str) -> Codec:
    """One per worker and vocabulary; the file is read where the task runs."""
    return Codec(read_ranks(path), pattern)


def encode_and_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, n_tokens, ids, decoded) for every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand for.
    Strings of special tokens are ordinary text. NULL is an empty text, with no ids; a NULL id
    stays; repeated rows give repeated results; an empty table gives no rows; other columns are
    not read. The vocabulary file must lie at ``path`` on every machine.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for part in slices(batch.column(1), TEXT_BYTES):
            texts = raw(batch.column(1)[part])  # only these leave Arrow
            encoded = tool.encode([text.decode() for text in texts])
            columns = [
                batch.column(0)[part.start : part.stop],
                pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                pa.array(encoded, pa.binary()),
                pa.array(tool.decode(encoded), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_tokens", "ids", "decoded"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc long, n_tokens long, ids binary, decoded binary", work)
