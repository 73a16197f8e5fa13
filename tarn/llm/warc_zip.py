"""WARC records in ZIP packages, read by range without extraction.

Writing: each task streams its pages into ZIP files in a shared folder.  A ZIP has two stored members: the
WARC file (every record its own gzip member) and a CDXJ-like index of its records.  A file's name is unique
to the attempt that wrote it, and only files named in the Parquet manifest, which Spark commits, count: what
a lost executor left behind is ignored.

Reading: end record, ZIP64 locator and record if there are any, central directory; from the local header the
place of a stored member's bytes; from its index the place of each record; then range reads.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, file_system, pieces, rows_of, saved, scratch

RECORDS, INDEX = "records.warc.gz", "records.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_RECORD = "archive string, page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def record_id(f: int, i: int) -> str:
    """The name of the record of the row with this key."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{f}:{i}')}>"


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, own: str, first: str | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record named ``own``; a revisit if there is a ``first`` record of its payload.

    A revisit has the HTTP head alone; length and digest are those of the full payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first:
        head += [f"WARC-Refers-To: {first}", f"WARC-Profile: {_PROFILE}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {quote(refers_to, safe='')}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; the payload is what follows the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ArchiveWriter:
    """Streams records into one ZIP."""

    def __init__(self, folder: str, part: int):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"part-{part:05d}-{uuid.uuid4().hex}.zip"
        self.stream = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, raw: bytes, kind: str) -> None:
        data = _gzip(raw)
        self.member.write(data)
        self.lines.append(json.dumps({"page": page_id, "type": kind, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()
        self.stream.close()


class ZipReader:
    """Members of a ZIP file by name, through range reads alone."""

    def __init__(self, file, size: int):
        self.file, self.members = file, {}
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
            sign, _, where, _ = struct.unpack("<4sIQI", self.read(tail_at + end - 20, 20))
            if sign == b"PK\6\7":
                record = self.read(where, 56)
                if record[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end record")
                count, length, at = struct.unpack_from("<QQQ", record, 32)
        directory, p = self.read(at, length), 0
        for _ in range(count):
            sign, method, packed, full, name, extra, comment, start = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, p)
            if sign != b"PK\1\2":
                raise ValueError("broken central directory")
            title = directory[p + 46 : p + 46 + name].decode()
            fields, q = directory[p + 46 + name : p + 46 + name + extra], 0
            while q + 4 <= len(fields):
                kind, n = struct.unpack_from("<HH", fields, q)
                if kind == 1:
                    wide, r = fields[q + 4 : q + 4 + n], 0
                    values = []
                    for v in (full, packed, start):
                        if v == 0xFFFFFFFF:
                            v = struct.unpack_from("<Q", wide, r)[0]
                            r += 8
                        values.append(v)
                    full, packed, start = values
                q += 4 + n
            self.members[title] = (start, packed, method)
            p += 46 + name + extra + comment

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the file is cut short")
        return data

    def place(self, name: str) -> tuple[int, int]:
        """(first byte, length) of a stored member."""
        start, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        sign, n, extra = struct.unpack("<4s22xHH", self.read(start, 30))
        if sign != b"PK\3\4":
            raise ValueError("no local header")
        return start + 30 + n + extra, size


def _write(folder: str, roll: int):
    def run(batches):
        from pyspark import TaskContext

        part, writer, done = TaskContext.get().partitionId(), None, []
        for batch in pieces(batches):
            for page_id, url, html, digest, f, i, first_f, first_i, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "f", "i", "first_f", "first_i", "first_id")), strict=True):
                writer = writer or ArchiveWriter(folder, part)
                first = None if first_f is None or (first_f, first_i) == (f, i) else record_id(first_f, first_i)
                writer.add(page_id, record_bytes(page_id, url, (html or "").encode(), digest, record_id(f, i), first, first_id), "revisit" if first else "response")
                if writer.at >= roll:
                    writer.close()
                    done.append((writer.name, len(writer.lines), writer.at))
                    writer = None
        if writer:
            writer.close()
            done.append((writer.name, len(writer.lines), writer.at))
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row of pages (page_id, url, html); returns the manifest (archive, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id (null last, then
    the first of repeated rows) is a response and the others revisit it; all else is a response.  Null html is
    empty; payloads of any length are whole.  Other columns are ignored whatever their names.  An empty table
    gives an empty manifest.
    """
    rows = rows_of(pages, None, page_id="page_id", url="url", html="html").withColumn("html", F.col("html").cast("string"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    groups = rows.where(size >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "f", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(groups.select("digest", "first"), "digest", "left")
    records = joined.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "digest", "f", "i", F.col("first.f").alias("first_f"), F.col("first.i").alias("first_i"), F.col("first.page_id").cast("string").alias("first_id"))
    return saved(records.mapInArrow(_write(f"{folder}/archives", roll_bytes), "archive string, records bigint, bytes bigint"), f"{folder}/manifest")


def read_archive(folder: str, archive: str):
    """(headers, payload, index line) of each record of an archive."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/archives/{archive}") as file:
        reader = ZipReader(file, file.size())
        first, size = reader.place(RECORDS)
        for line in reader.read(*reader.place(INDEX)).decode().splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > size:
                raise ValueError("a record lies outside its member")
            yield *parse_record(zlib.decompress(reader.read(first + entry["offset"], entry["length"]), 31)), entry


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """A row per record of the archives in the manifest; payloads are checked against length and digest.

    Page ids come back as ``id_type``.
    """
    import hashlib

    manifest = spark.read.schema("archive string, records bigint, bytes bigint").parquet(f"{folder}/manifest")

    def run(batches):
        for batch in batches:
            for archive, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for headers, payload, _ in read_archive(folder, archive):
                    digest, n, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"]), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{archive}: a payload does not fit its header")
                    ids = [unquote(headers[h]) if h in headers else None for h in ("X-Page-ID", "X-Refers-To-Page")]
                    rows.append((archive, ids[0], n, digest, kind, ids[1]))
                if len(rows) != expected:
                    raise ValueError(f"{archive}: {len(rows)} records, not {expected}")
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), arrow_schema(_RECORD), strict=True)], schema=arrow_schema(_RECORD))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = manifest.select("archive", "records").repartition(parts).mapInArrow(run, _RECORD)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``pages`` written and read back; the rules are those of ``write_archives``."""
    folder = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).drop("archive")


OP4_SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> m THEN m END AS refers_to
FROM g
"""
