"""Archives: exact round trips, and directories of classic and ZIP64 files."""

import gzip
import hashlib
import json
import random
import zipfile

import pytest

from plumbline.llm import warc
from plumbline.session import fresh_path


def pages():
    rng = random.Random(4)
    big = "<p>" + "déjà vu " * 300
    rows = [(k, f"http://h.org/{k}", "".join(rng.choice("ab<é\r\n\r\n>") for _ in range(rng.randint(0, 3000)))) for k in range(40)]
    rows += [(100, "http://a/1", big), (103, "http://a/2", big), (101, None, big)]
    rows += [(200, "u", "short"), (201, "u", "short"), (300, None, None), (301, "", "")]
    rows += [(400, "http://a b/\r\nX: y%41", "x" * 999), (401, "é", "x" * 999), (402, "q", "z" * 1000), (403, "q", "z" * 1000)]
    rows += [(500, "d", "same " * 400)] * 2 + [(None, "n", "w" * 2000), (501, "long", "0123456789" * 300_000)]
    return rows


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        keeper = max(equal) if len(payload) >= 1000 and equal else None
        revisit = keeper is not None and keeper != page
        out.append(
            (page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)
        )
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, payload int")
    records = warc.write_and_read(docs)
    assert sorted([tuple(r) for r in warc.digest(records).collect()], key=repr) == expected(rows)
    urls = sorted([(r.page_id, r.target_uri) for r in records.collect()], key=repr)
    assert urls == sorted([(p, u) for p, u, _ in rows], key=repr)
    held = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
    html = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(payload) == html[p] for p, payload in held.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_and_read(docs).count() == 0


def test_archives_roll_and_other_tools_read_them(spark):
    docs = spark.createDataFrame(pages()[:40], "page_id bigint, url string, html string")
    folder = fresh_path(spark, "small")
    archives = warc.write_archives(docs.coalesce(1), folder, limit=5000)
    paths = [r.archive for r in archives.collect()]
    assert len(paths) > 1
    for path in paths:
        with zipfile.ZipFile(path.removeprefix("file:")) as archive:
            assert archive.namelist() == [warc.DATA, warc.INDEX] and archive.testzip() is None
    assert warc.read_archives(archives).count() == 40


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end" * 3])
def test_zip64_directory(tmp_path, monkeypatch, comment):
    path = str(tmp_path / "many.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        for k in range(66_000):  # more than a classic directory can count
            archive.writestr(f"m{k}", b"")
        archive.writestr("last", b"found")
        archive.comment = comment
    source = warc.RangeReader(path)
    members = warc.directory(source)
    assert len(members) == 66_001
    assert source.read(warc.data_start(source, members[-1]), members[-1].size) == b"found"
    source.close()


def test_zip64_sizes_and_offsets(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    path = str(tmp_path / "wide.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("a", b"x" * 500)
        archive.writestr("b", b"y" * 50)
        archive.writestr("c", b"z" * 300)
        archive.writestr(zipfile.ZipInfo("packed"), b"q" * 90, zipfile.ZIP_DEFLATED)
    source = warc.RangeReader(path)
    members = {m.name: m for m in warc.directory(source)}
    for name, body in (("a", b"x" * 500), ("b", b"y" * 50), ("c", b"z" * 300)):
        assert source.read(warc.data_start(source, members[name]), members[name].size) == body
    with pytest.raises(ValueError):
        warc.data_start(source, members["packed"])
    source.close()


def test_broken_file(tmp_path):
    path = tmp_path / "no.zip"
    path.write_bytes(b"nothing here")
    with pytest.raises(ValueError):
        warc.directory(warc.RangeReader(str(path)))


def test_archives_of_other_writers(spark, tmp_path):
    """Sizes as text, ids that are no pages, records without a page, and sizes not given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    made = [
        ("warcinfo", "<urn:uuid:1>", b"software: x"),
        ("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ("response", "<urn:uuid:3>", http + b"<p>one</p>"),
        ("response", "<urn:page:7>", http + b"<p>seven</p>"),
        ("response", "<urn:page:99999999999999999999>", http),
    ]
    data, index = b"", []
    for kind, name, block in made:
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nContent-Length:{len(block)}\r\n\r\n"
        packed = gzip.compress(head.encode() + block + b"\r\n\r\n")
        entry = {"offset": str(len(data)), "length": str(len(packed)), "filename": "data.warc.gz"}
        index.append(f"org,a)/ 20240101 {json.dumps(entry)}\n")
        data += packed
    path = str(tmp_path / "other.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        out.writestr("archive/data.warc.gz", data)
        out.writestr("indexes/index.cdx", "".join(index))
    rows = warc.read_archives(spark.createDataFrame([(path,)], "archive string")).collect()
    want = {(None, b"<p>one</p>"), (7, b"<p>seven</p>"), (None, b"")}
    assert len(rows) == 3 and {(r.page_id, bytes(r.payload)) for r in rows} == want
    for r in rows:
        assert r.payload_bytes == len(r.payload)
        assert r.payload_digest == hashlib.sha1(r.payload).hexdigest()


def test_tasks_follow_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 4096)
    frame = spark.createDataFrame(pages(), "page_id bigint, url string, html string")
    records = warc.write_and_read(frame)
    blocks = {(r.archive, r.offset // 4096) for r in records.select("archive", "offset").collect()}
    assert len(blocks) > 3 and records.rdd.getNumPartitions() == len(blocks)
