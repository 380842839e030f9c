from __future__ import annotations

import gzip
import hashlib

import pytest

from touchline.llm import warc


def back(spark, pages, tmp_path, **options):
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, **options)
    return warc.resolve_revisits(warc.read_archives(spark, path))


def test_round_trip_of_odd_pages(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [
        (1, "http://a/ b", long, "x"),
        (9, None, long, "x"),
        (4, "http://c\r\nX: y", long, "x"),
        (2, "u", None, "x"),
        (3, "u", "", "x"),
        (5, "u", "short", None),
        (6, "u", "short", None),
        (None, "u", long, None),
        (7, "u", "w" * 3_000_000, None),
        (9, None, long, "again"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    found = back(spark, pages.repartition(3), tmp_path).collect()
    assert len(found) == len(rows)
    for r in found:
        text = {row[0]: row[2] for row in rows}[r.page] or ""
        repeat = text == long and r.page != 9
        assert r.record_type == ("revisit" if repeat else "response")
        assert r.refers_to == (9 if repeat else None)
        assert r.payload_bytes == len(text.encode())
        assert r.digest == hashlib.sha1(text.encode()).hexdigest()
        assert bytes(r.payload) == (b"" if repeat else text.encode())
    assert {r.url for r in found if r.page == 4} == {"http://cX:y"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert back(spark, pages, tmp_path).count() == 0


def test_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(id, 5000) AS html")
    found = back(spark, pages.coalesce(1), tmp_path)
    assert found.count() == 50
    assert len(list((tmp_path / "archives").glob("*.gz"))) > 10


def test_archives_of_many_members(spark, tmp_path):
    pages = spark.range(30).selectExpr("id AS page_id", "'u' AS url", "repeat(id, 700) AS html")
    path = str(tmp_path / "one")
    warc.write_archives(pages.coalesce(1), path)
    (file,) = (tmp_path / "one").glob("*.gz")
    records = gzip.decompress(file.read_bytes()).split(b"\r\n\r\nWARC/")
    whole = [records[0], *(b"WARC/" + r for r in records[1:])]
    whole = [r.removesuffix(b"\r\n\r\n") + b"\r\n\r\n" for r in whole]
    members = [gzip.compress(r) for r in whole]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.warc.gz").write_bytes(b"".join(members))
    found = warc.read_archives(spark, str(tmp_path / "many")).collect()
    assert sorted(found) == sorted(warc.read_archives(spark, path).collect())
    assert len(found) == 30
    with pytest.raises(ValueError):
        warc._unzip(b"".join(members)[:-20])
