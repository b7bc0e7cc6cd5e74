r"""Legacy archives to WARC, and WARC files back to records (operator 11).

ARC, the older format, holds records one after another: a header line, as many bytes as it declares, a line feed.  The first record
(``filedesc://``) declares the version and names the fields of the header lines:

| version | header line |
|---|---|
| 1 | URL IP-address Archive-date Content-type Archive-length |
| 2 | URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length |

``arc_records`` reads them by version and declared length.  ``convert`` makes what WARC asks for and ARC lacks: record ids (UUIDs of where a record lies and what
it holds, so that a task that is run again makes the same ones), ISO timestamps, record types, block and payload digests.  Of records of equal
payloads one is a response and the others are revisits that refer to it, without the payload.  ``write_warc`` writes them as gzipped WARC files by Spark's text
sink, whose line separator is the end of a WARC record; the sink commits files, so lost executors leave none half written.  ``read_warc`` reads such files.

Payloads are not shuffled to find equal ones: digests and ids are, aggregated first within each task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm.common import broadcast_if_small, forget_chunks
from qaspark.session import Scratch, checkpoint_path, written

#: Names of the header fields by version, the end of a WARC record, the profile of revisits.
FIELDS = {1: ["url", "ip", "date", "mime", "length"],
          2: ["url", "ip", "date", "mime", "result_code", "checksum", "location", "offset", "filename", "length"]}
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes of a legacy archive that the query's pages are laid in, records of a WARC file, bytes that a reader hands on at a time.
ARC_BYTES, FILE_RECORDS, READ_BYTES = 2_000_000, 20_000, 4_000_000
#: Payloads that several records share and tasks may hold the responses of; beyond it they are joined.
SHARED = 200_000

ARC_SCHEMA = ("path string, at long, version int, url string, ip string, date string, mime string, result_code string, "
              "declared long, damaged boolean, http_headers binary, payload_sha256 binary, payload_bytes long, block binary")
WARC_SCHEMA = ("path string, at long, record_id string, record_type string, target_uri string, date string, content_type string, http_headers binary, "
               "payload binary, payload_bytes long, payload_sha1 string, refers_to string")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))


def _in_batches(rows: Iterator[tuple], schema: str, size) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about READ_BYTES; ``size``: bytes of a row."""
    waiting, n = [], 0
    for r in rows:
        waiting.append(r)
        n += 500 + size(r)
        if n >= READ_BYTES:
            yield _batch(waiting, schema)
            waiting, n = [], 0
    if waiting:
        yield _batch(waiting, schema)


class _Stream:
    """Bytes of a file, plain or gzipped in one member or many, read forward."""

    def __init__(self, content: bytes):
        #: What is unzipped and not read yet begins at ``at`` of ``held``; ``place``: bytes read.
        self.held, self.at, self.place = content, 0, 0
        self.zipped, self.next, self.member = b"", 0, None
        if content[:2] == b"\x1f\x8b":
            self.held, self.zipped, self.member = b"", content, zlib.decompressobj(31)

    def _more(self) -> bool:
        """Hold more; False at the end of the file."""
        if self.next >= len(self.zipped):
            return False
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        piece = self.zipped[self.next : self.next + (1 << 20)]
        self.next += len(piece)
        self.held, self.at = self.held[self.at :] + self.member.decompress(piece), 0
        self.next -= len(self.member.unused_data)  # of the next member
        return True

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.held) - self.at < n and self._more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        self.place += len(out)
        return out

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                return self.take(seen) if seen else None
        return self.take(end + 1 - self.at)[:-1]


def header_fields(line: str, version: int) -> dict[str, str] | None:
    """The fields of an ARC header line; None if it is not one.

    Fields are counted from the right, as an old URL may hold spaces.
    """
    names = FIELDS[version]
    values = line.rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[0] or not re.fullmatch(r"\d+", values[-1]) or not re.fullmatch(r"\d{14}", values[2]):
        return None
    return dict(zip(names, values))


def parse_arc(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of ARC_SCHEMA of one archive.

    Bytes that no header line precedes, and a block shorter than declared, are damaged; after the former nothing more is read, as no length says
    where a record begins.
    """
    s, version = _Stream(content), 1
    while True:
        at = s.place
        line = s.line()
        if line is None:
            return
        if not line.strip():  # the end of a record before, or a spare line
            continue
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        about = text.startswith("filedesc://")  # its line has the fields of either version
        fields = header_fields(text, 2) or header_fields(text, 1) if about else header_fields(text, version)
        if fields is None:
            yield (path, at, version, *[None] * 6, True, None, None, None, line)
            return
        declared = int(fields["length"])
        block = s.take(declared)
        if about:
            version = 2 if block[:2].strip() == b"2" else 1
        head, payload = split_http(block) if block.startswith(b"HTTP/") else (None, block)
        yield (path, at, version, fields["url"], fields["ip"], fields["date"], fields["mime"], fields.get("result_code"), declared, len(block) < declared,
               head, hashlib.sha256(payload).digest(), len(payload), block)


def arc_records(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """Records (ARC_SCHEMA) of legacy archives (path, content), such as Spark's binaryFile source reads; gzipped ones too.

    at: the record's place in the unzipped archive.  ``damaged`` rows are not to be converted.  Without ``blocks`` the column block is null.  A null or empty archive gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows = parse_arc(path.as_py(), content.as_py() or b"")
                yield from _in_batches(rows if blocks else ((*r[:-1], None) for r in rows), ARC_SCHEMA, lambda r: len(r[-1] or b""))

    return archives.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ARC_SCHEMA)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(headers with the blank line, payload) of an HTTP message."""
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end():]) if end else (block, b"")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _timestamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_uuid(path: str, at: int, payload_sha256: bytes) -> str:
    """Of where a record lies and what it holds: the same whenever it is made."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{at}#{payload_sha256.hex()}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def _warc(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record but for RECORD_END."""
    own = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + own.encode() + b"\r\n" + block


def warc_record(path: str, at: int, url: str, ip: str, date: str, mime: str, block: bytes, refers: tuple[str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``refers``: id and date of the response it repeats."""
    http = block.startswith(b"HTTP/")
    head, payload = split_http(block) if http else (b"", block)
    kind = ("revisit" if refers else "response") if http else "resource"
    if url.startswith("filedesc://"):
        kind, refers = "warcinfo", None
        block = f"software: qaspark\r\nformat: WARC File Format 1.1\r\nisPartOf: {_line(path)}\r\n".encode()
    own = head if kind == "revisit" else block
    about = kind != "warcinfo"
    return _warc([
        ("WARC-Type", kind), ("WARC-Record-ID", record_uuid(path, at, hashlib.sha256(payload).digest())), ("WARC-Date", _timestamp(date)),
        ("WARC-Target-URI", url if about else None), ("WARC-IP-Address", ip if about and re.fullmatch(r"[0-9A-Fa-f.:]+", ip) and ip != "0.0.0.0" else None),
        ("WARC-Block-Digest", _sha1(own)), ("WARC-Payload-Digest", _sha1(payload) if about else None),
        ("WARC-Profile", PROFILE if kind == "revisit" else None), ("WARC-Refers-To", refers[0] if refers else None), ("WARC-Refers-To-Date", refers[1] if refers else None),
        ("Content-Type", {"warcinfo": "application/warc-fields", "resource": mime or "application/octet-stream"}.get(kind, "application/http; msgtype=response"))], own)


def convert(archives: DataFrame, rank: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record binary): the WARC records of legacy archives (path, content), in their order within each partition.

    A record of HTTP becomes a response or a revisit, another one a resource, the archive's own record a warcinfo; damaged ones are left out.  Of responses
    whose payloads are equal (SHA-256) and of ``least_bytes`` or more, the last by the number in the HTTP header ``rank`` (without one: before those that have one), then by path and place,
    stays a response, and the others revisit it.
    """
    index = arc_records(archives, blocks=False).where(F.col("http_headers").isNotNull() & ~F.col("damaged") & (F.col("payload_bytes") >= least_bytes))
    number = F.lit(None) if rank is None else F.nullif(F.regexp_extract(F.col("http_headers").cast("string"), rf"(?im)^{re.escape(rank)}:\s*(-?\d+)\s*$", 1), F.lit(""))
    last = F.max(F.struct(number.cast("long").alias("rank"), "path", "at", "date"))
    shared = index.groupBy(F.col("payload_sha256").alias("own")).agg(F.count("*").alias("n"), last.alias("last")).where("n > 1")
    shared = written(shared.select("own", "last.path", "last.at", "last.date"), "warc-shared")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, at, url, ip, date, mime, block, own, to_path, to_at, to_date in zip(*(b.column(i).to_pylist() for i in range(11))):
                refers = (record_uuid(to_path, to_at, own), _timestamp(to_date)) if to_path is not None and (to_path, to_at) != (path, at) else None
                rows.append((warc_record(path, at, url, ip, date, mime, block, refers),))
            yield _batch(rows, "record binary")

    records = arc_records(archives).where("not damaged").withColumn("own", F.when(F.col("http_headers").isNotNull(), F.col("payload_sha256")))
    joined = records.join(broadcast_if_small(shared.select("own", *[F.col(c).alias(f"to_{c}") for c in ("path", "at", "date")]), SHARED), "own", "left")
    return joined.select("path", "at", "url", "ip", "date", "mime", "block", "own", "to_path", "to_at", "to_date").mapInArrow(made, "record binary")


def write_warc(records: DataFrame, folder: str) -> None:
    """Write records (record binary) as gzipped WARC files, a file a task and FILE_RECORDS records."""
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def parse_warc(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of WARC_SCHEMA of one file; a ValueError where the file is not WARC or a payload not what its digest says."""
    s = _Stream(content)
    while True:
        at = s.place
        line = s.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{path}: no WARC record at {at}")
        h: dict[str, str] = {}
        while (line := s.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            h[name.strip().lower()] = value.strip()
        block = s.take(int(h["content-length"]))
        if len(block) < int(h["content-length"]):
            raise ValueError(f"{path}: the record at {at} is cut off")
        kind = h["warc-type"]
        head, payload = split_http(block) if h.get("content-type", "").startswith("application/http") else (b"", block)
        digest = h.get("warc-payload-digest")
        if kind == "revisit":
            payload = None
        elif digest and digest != _sha1(payload):
            raise ValueError(f"{path}: the payload at {at} is not what its digest says")
        sha1 = base64.b32decode(digest.partition(":")[2]).hex() if digest else None
        yield (path, at, h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], h.get("content-type"), head, payload,
               None if payload is None else len(payload), sha1, h.get("warc-refers-to"))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records (WARC_SCHEMA) of the WARC files in a folder, plain or gzipped.

    A revisit has no payload of its own: null payload and payload_bytes, the digest from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                yield from _in_batches(parse_warc(path.as_py(), content.as_py()), WARC_SCHEMA, lambda r: len(r[8] or b""))

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").mapInArrow(run, WARC_SCHEMA)


def lay_in_arc(pages: DataFrame, date: str = "20060102030405") -> DataFrame:
    """Legacy archives (path, content) of pages (page_id, url, html), versions 1 and 2 by turns: what ``convert`` is given by the query.

    A page is an HTTP message with its html in UTF-8 (null: empty) and its page_id, if not null, in the header X-Page-Id.
    """

    def archive(path: str, version: int, pages: list[tuple]) -> bytes:
        names = "URL IP-address Archive-date Content-type " + ("Result-code Checksum Location Offset Filename " if version == 2 else "") + "Archive-length"
        about = f"{version} 0 qaspark\n{names}\n\n".encode()

        def line(url: str, ip: str, mime: str, at: int, n: int) -> bytes:
            return f"{url} {ip} {date} {mime} {f'200 - - {at} {path} ' if version == 2 else ''}{n}\n".encode()

        out = [line(f"filedesc://{path}", "0.0.0.0", "text/plain", 0, len(about)) + about]
        at = len(out[0])
        for page_id, url, html in pages:
            doc = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id) + b"\r\n" + (html or "").encode()
            out.append(b"\n" + line(re.sub(r"\s", "%20", url or "") or "about:blank", "192.0.2.1", "text/html", at + 1, len(doc)) + doc)
            at += len(out[-1])
        return b"".join([*out, b"\n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        part, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            path = f"pages-{part:06d}-{n:06d}.arc"
            return _batch([(path, archive(path, 1 + n % 2, waiting))], "path string, content binary")

        for b in batches:
            for page in zip(*(b.column(i).to_pylist() for i in range(3))):
                waiting.append(page)
                size += 200 + len(page[2] or "")
                if size >= ARC_BYTES:
                    yield close()
                    n, waiting, size = n + 1, [], 0
        if waiting:
            yield close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "path string, content binary")


def page_records(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to, read from the WARC files in ``folder`` (None: a new shared one).

    Pages (page_id, url, html) are laid in legacy archives, those converted, written and read back.  A null html is an empty payload; of equal payloads of
    LEAST_BYTES or more the page with the largest page_id is the response; a null page_id is less than any other, and of rows that repeat one is the response
    and the others refer to its page_id.  Null or odd URLs are kept on one line.  An empty table gives no row.  Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or checkpoint_path(spark, "warc-files")
    with Scratch(spark) as tables:
        archives = tables.path("arc-files")
        lay_in_arc(pages).write.option("compression", "zstd").parquet(archives)
        write_warc(convert(spark.read.schema("path string, content binary").parquet(archives), rank="X-Page-Id"), folder)
    page_id = F.regexp_extract(F.col("http_headers").cast("string"), r"(?im)^X-Page-Id:\s*(-?\d+)\s*$", 1)
    read = read_warc(spark, folder).where("record_type in ('response', 'revisit')").select(
        F.nullif(page_id, F.lit("")).cast("long").alias("page_id"), "record_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.col("refers_to").alias("to"))
    read = written(read, "warc-records")
    # a revisit's bytes are those of the response it refers to
    wanted = read.where("record_type = 'revisit'").select(F.col("to").alias("record_id")).distinct()
    responses = read.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    responses = written(responses.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes")), "warc-responses")
    return read.join(broadcast_if_small(responses, SHARED), "to", "left").select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p
"""
