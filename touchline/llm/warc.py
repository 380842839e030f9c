"""WARC archives of web pages, with repeated payloads as revisit records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.frames import map_rows
from touchline.session import stage

#: Payload bytes from which an equal payload becomes a revisit.
LEAST = 1000
#: Bytes and records of one archive file at most, beside a single longer record; one task reads
#: a file whole.
FILE_BYTES = 64 << 20
FILE_RECORDS = 5_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_BATCH = 8 << 20
_NAMES = ["page", "url", "record_type", "digest", "refers_to", "payload_bytes", "payload"]
_SCHEMA = (
    "page long, url string, record_type string, digest string, refers_to long,"
    " payload_bytes long, payload binary"
)


def _header(name: str, value: Column) -> Column:
    """A header line, empty without a value."""
    line = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    return F.coalesce(line, F.lit(""))


def _page_uri(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.col(column).cast("string"), F.lit(">"))


def _record(date: str) -> Column:
    """One record without its end: fresh headers, then the payload of a response."""
    response = F.col("refers_to").isNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        _header("WARC-Record-ID", _page_uri("page")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(~response, F.lit(_PROFILE))),
        _header("WARC-Refers-To", _page_uri("refers_to")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(response, F.col("size")).otherwise(F.lit(0))),
        F.lit("\r\n"),
        F.when(response, F.col("payload")).otherwise(F.lit("")),
    )


def originals(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, size, original) of the payloads that more than one row of ``heads`` has."""
    return (
        heads.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page").alias("original"), F.count("*").alias("n"))
        .where("n > 1 AND original IS NOT NULL")
        .select("digest", "size", "original")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST,
) -> None:
    """Gzipped WARC files with a record per row of ``pages``, long payloads once.

    Headers are folded by payload digest to the largest page, then joined back; a payload that a
    third of the pages share is one row on the folded side, and the other side can be split.
    Spark's text writer makes the files: its line end is the blank pair of lines that ends a WARC
    record, and its commit protocol leaves no half-written archive of a lost executor.

    NULL payloads are empty responses, a NULL url gives no target line. A row without an id gets a
    record without one, and is no original. Rows that repeat the id and payload of an original are
    responses as well. An empty table gives no records; other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns(
        {
            "digest": F.sha1(F.col("payload").cast("binary")),
            "size": F.octet_length("payload").cast("long"),
        }
    )
    heads = stage(rows.select("page", "digest", "size"), "heads")
    longest = heads.agg(F.max("size")).first()[0] or 1
    repeated = stage(originals(heads, least), "originals")
    refers = F.expr("if(page <=> original, NULL, original)").alias("refers_to")
    typed = rows.join(repeated, ["digest", "size"], "left").select(*rows.columns, refers)
    records = max(1, min(FILE_RECORDS, FILE_BYTES // longest))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    writer = typed.select(_record(date).alias("value")).write.option("lineSep", _END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _number(uri: bytes | None) -> int | None:
    return int(uri[len(b"<urn:page:") : -1]) if uri else None


def _parse(archive: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:stop].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        at = stop + 4 + int(head[b"content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong before byte {at}")
        payload, kind = archive[stop + 4 : at], head[b"warc-type"].decode()
        digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
        if kind == "response" and digest != hashlib.sha1(payload).hexdigest():
            raise ValueError(f"a payload differs from its digest before byte {at}")
        url = head.get(b"warc-target-uri")
        page = _number(head.get(b"warc-record-id"))
        refers = _number(head.get(b"warc-refers-to"))
        size = len(payload) if kind == "response" else None
        yield page, url.decode() if url is not None else None, kind, digest, refers, size, payload
        at += 4


def _unzip(content: bytes) -> bytes:
    """The bytes of all gzip members, one after the other."""
    parts = []
    while content:
        unzip = zlib.decompressobj(wbits=31)
        parts.append(unzip.decompress(content))
        if not unzip.eof:
            raise ValueError("the last gzip member of an archive is cut off")
        content = unzip.unused_data.lstrip(b"\0")  # padding between members
    return parts[0] if len(parts) == 1 else b"".join(parts)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path``; payloads are checked against their digests."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in _ARROW]
        for content in batch.column(0):
            archive, rows, size = _unzip(content.as_py()), [], 0
            for row in _parse(archive):
                rows.append(row if payloads else (*row[:-1], None))
                size += len(row[-1])
                if size > _BATCH:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return map_rows(files.select("content"), _SCHEMA, work)


_ARROW = pa.schema(
    [
        ("page", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with the payload bytes (and payload) of a revisit taken from its original."""
    known = records.where("record_type = 'response' AND page IS NOT NULL").select(
        F.col("page").alias("refers_to"), "digest", F.col("payload_bytes").alias("original_bytes")
    )
    # Only pages that revisits refer to, once each, in a table of their own so that the join
    # deals both sides and can split a page that many revisits name.
    asked = records.where("record_type = 'revisit'").select("refers_to", "digest").distinct()
    known = stage(known.join(asked, ["refers_to", "digest"]).distinct(), "responses")
    joined = records.join(known, ["refers_to", "digest"], "left")
    return joined.withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "original_bytes")
    ).select(*records.columns)
