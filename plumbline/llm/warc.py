"""WARC records in ZIP-packaged archives (WACZ layout): writing, and reading by ranges.

Writing: each task streams its pages into archives of bounded size: ``archive/data.warc.gz``
(one gzip member per record, the ZIP member itself stored) and ``indexes/index.cdxj``. Of
records with equal payloads of some size only that with the largest page id holds the payload,
the others revisit it. An archive gets a name of its own, and the list of archives is the
committed output of the job, so files of lost or repeated tasks are never read.

Reading: the end of each file is read for its directory, classic or ZIP64, then the central
directory, the local headers of the stored members and the index, all by ranges. Index rows are
dealt by archive and block of the file, and records are range-read and unpacked one by one;
nothing is extracted, and no task needs a whole archive.

Defined cases: null html is an empty payload; a null url is written without target; a null page
id is written empty and read back as null; repeated rows are records of their own (with equal
ids and large equal payloads all of them are responses); an empty table gives no archive and no
rows; further columns are ignored; payloads of any length and content come back byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pinned
from plumbline.session import fresh_path

MIN_PAYLOAD = 1000  # shorter payloads are always kept with their record
ARCHIVE_BYTES = 256 << 20
BLOCK_BYTES = 32 << 20
ARCHIVES_PER_TASK = 8
KEPT_TYPES = ("response", "revisit")
_HTTP_LENGTH = re.compile(rb"(?:^|\r\n)content-length:\s*(\d+)", re.IGNORECASE)
_NUMBER = re.compile(r"-?[0-9]{1,19}")
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id bigint, record_type string, refers_to bigint, target_uri string, "
    "payload_bytes bigint, payload_digest string, payload binary, archive string, offset bigint"
)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


# Writing


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, keeper: the page whose record holds an equal payload, or null."""
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= MIN_PAYLOAD)
    keepers = large.groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    )
    return rows.join(keepers.where("n > 1").drop("n"), "digest", "left")


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, date: str
) -> bytes:
    """One WARC record, unpacked."""
    revisit = keeper is not None and keeper != page_id
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    packed = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{packed}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{keeper}>"), ("WARC-Profile", PROFILE)]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One archive being written, front to back."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, place = _file_system(self.path)
        self.stream = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        self.index.append((page_id, self.at, len(packed)))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        lines = [
            f"page:{'' if page_id is None else page_id} - "
            + json.dumps({"offset": at, "length": n, "filename": "data.warc.gz"})
            for page_id, at, n in self.index
        ]
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            out.write("".join(f"{line}\n" for line in sorted(lines)).encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def write_archives(
    pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes the pages (page_id, url, html) below ``folder``; returns archive, n_records."""
    system, place = _file_system(folder)
    system.create_dir(place, recursive=True)
    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, html, digest, keeper in zip(
                *(batch.column(c) for c in ("page_id", "url", "html", "digest", "keeper"))
            ):
                if archive is None:
                    archive = _Archive(folder)
                page = page_id.as_py()
                payload = html.as_buffer().to_pybytes()
                archive.add(
                    page,
                    record_bytes(page, url.as_py(), payload, digest.as_py(), keeper.as_py(), date),
                )
                if archive.at >= limit:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema
        )

    rows = record_types(pages).select("page_id", "url", "html", "digest", "keeper")
    return pinned(rows.mapInArrow(write, "archive string, n_records bigint"), "archives")


# Reading


@dataclass
class Member:
    name: str
    method: int  # 0: stored
    size: int  # as it lies in the file
    header: int  # where its local header starts


class RangeReader:
    """Byte ranges of a file on any file system."""

    def __init__(self, path: str):
        system, place = _file_system(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def _wide(extra: bytes, wanted: list[int]) -> list[int]:
    """Fills sizes and offsets of all ones from the ZIP64 field, in their fixed order."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(values) if v == 0xFFFFFFFF else v for v in wanted]
        at += 4 + n
    return wanted


def directory(source: RangeReader) -> list[Member]:
    """The members of a ZIP file, from its classic or ZIP64 central directory."""
    tail_at = max(0, source.size - 22 - 65535)
    tail = source.read(tail_at, source.size - tail_at)
    end = len(tail)
    while (end := tail.rfind(b"PK\x05\x06", 0, max(end, 0))) >= 0:
        # The right one's comment ends with the file; its bytes may also come in a comment.
        if end + 22 <= len(tail) and len(tail) - end - 22 == struct.unpack_from("<H", tail, end + 20)[0]:
            break
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0:
        found = source.read(locator, 20)
        if found[:4] == b"PK\x06\x07":
            record = source.read(struct.unpack_from("<Q", found, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
    body, members, place = source.read(at, size), [], 0
    for _ in range(count):
        if body[place : place + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", body, place + 10)[0]
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", body, place + 20)
        header = struct.unpack_from("<I", body, place + 42)[0]
        name = body[place + 46 : place + 46 + n_name].decode()
        extra = body[place + 46 + n_name : place + 46 + n_name + n_extra]
        full, packed, header = _wide(extra, [full, packed, header])
        members.append(Member(name, method, packed, header))
        place += 46 + n_name + n_extra + n_comment
    return members


def data_start(source: RangeReader, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    local = source.read(member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def index_rows(source: RangeReader) -> list[tuple[int, int]]:
    """(offset in the file, length) of every record, by the archive's indexes."""
    members = {m.name: m for m in directory(source)}
    out = []
    for name, member in members.items():
        if not name.startswith("indexes/"):
            continue
        lines = source.read(data_start(source, member), member.size).decode().splitlines()
        starts: dict[str, int] = {}
        for line in lines:
            entry = json.loads(line.split(" ", 2)[2])
            file = f"archive/{entry['filename']}"
            if file not in starts:
                starts[file] = data_start(source, members[file])
            # Some writers have them as text.
            out.append((starts[file] + int(entry["offset"]), int(entry["length"])))
    return sorted(out)


def parse_record(packed: bytes) -> tuple | None:
    """(page, type, refers to, target, payload size, hex digest, payload) of one record.

    None for records that hold no page, such as requests. Of other writers' records the page is
    None, and a size or digest that is not given is the payload's own.
    """
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])
    fields = {name: value.strip() for name, _, value in lines}
    if fields["WARC-Type"] not in KEPT_TYPES:
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    given = _HTTP_LENGTH.search(http)
    length = int(given[1]) if given else len(payload)

    def page(name: str) -> int | None:
        found = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        number = int(found) if _NUMBER.fullmatch(found) else None
        return number if number is not None and -(1 << 63) <= number < 1 << 63 else None

    kind = fields["WARC-Type"]
    target = fields.get("WARC-Target-URI")
    given = fields.get("WARC-Payload-Digest", "")
    if given.startswith("sha1:"):
        digest = base64.b32decode(given.removeprefix("sha1:")).hex()
    else:
        digest = hashlib.sha1(payload).hexdigest()
    return (
        page("WARC-Record-ID"),
        kind,
        page("WARC-Refers-To"),
        None if target is None else unquote(target),
        length,
        digest,
        None if kind == "revisit" else payload,
    )


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives (column ``archive``): page_id, record_type, refers_to,
    target_uri, payload_bytes and payload_digest as recorded, payload (null for revisits),
    archive, offset."""
    place = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                source = RangeReader(path)
                rows = index_rows(source)
                source.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                    ],
                    schema=place,
                )

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("target_uri", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
            ("archive", pa.string()),
            ("offset", pa.int64()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows, held = [], 0
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in place.names)):
                if path != opened:
                    if source is not None:
                        source.close()
                    source, opened = RangeReader(path), path
                record = parse_record(source.read(at, n))
                if record is None:
                    continue
                rows.append((*record, path, at))
                held += len(record[6] or b"")
                if held > 8 << 20:  # payloads go on in small batches
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)
        if source is not None:
            source.close()

    # The rows dealt are few bytes that stand for many: tasks are counted, not sized by them.
    listed = archives.select("archive").repartition(
        max(1, -(-archives.count() // ARCHIVES_PER_TASK)), "archive"
    )
    located = listed.mapInArrow(locate, "archive string, offset bigint, length bigint")
    located = located.withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
    located = pinned(located, "places")
    n_blocks = located.select("archive", "block").distinct().count()
    dealt = located.repartition(max(1, n_blocks), "archive", "block")
    dealt = dealt.sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )


def write_and_read(pages: DataFrame) -> DataFrame:
    """The pages as records, written below the shared folder and read back."""
    archives = write_archives(pages, fresh_path(pages.sparkSession, "warc"))
    return read_archives(archives)


def digest(records: DataFrame) -> DataFrame:
    """What the records say of each page. A held payload is measured itself."""
    held = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(held, F.octet_length("payload").cast("bigint"))
        .otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(held, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d
  FROM pages
),
kept AS (
  SELECT *, CASE WHEN n >= {MIN_PAYLOAD} THEN max(page_id) OVER (PARTITION BY d) END AS keeper
  FROM hashed
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM kept
"""
