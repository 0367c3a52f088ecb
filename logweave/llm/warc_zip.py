"""WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP file of stored (not deflated) members: ``archive/data.warc.gz``,
each record its own gzip member, and ``indexes/index.cdx``, a line for each record
with its offset and length in that member.  The writer always uses ZIP64 records.
The reader finds the end record, follows the ZIP64 locator, walks the central
directory, locates the stored members behind their local headers, reads the index by
its range and then the records in runs of ranges.

Of records with equal payloads that with the largest page_id is a response and the
others revisit it.  The digests are grouped and joined as short rows; pages travel
once, to the task that packs them.

Defined results: null html is an empty payload, equal to other empty ones; null
page_ids are never a revisit's target: with a non-null id among equal payloads they
revisit it, else all are responses; rows that repeat the largest page_id are all
responses; an empty table gives no package and no row.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import new_path, written
from logweave.llm.files import new_file, open_file, read_range

#: A package is closed when its records hold so many bytes.
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

_U32, _U16 = 0xFFFFFFFF, 0xFFFF


class ZipWriter:
    """Stored members, one after the other, with ZIP64 sizes throughout."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.member = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.member = [raw, self.at, 0, 0]
        # Sizes and checksum follow the data (flag bit 3); names are UTF-8 (bit 11).
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, _U32, _U32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.member[2] = zlib.crc32(data, self.member[2])
        self.member[3] += len(data)
        self._put(data)

    def end(self) -> None:
        raw, at, crc, size = self.member
        self._put(struct.pack("<4sI2Q", b"PK\7\10", crc, size, size))
        self.entries.append((raw, at, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.entries:
            extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, _U32, _U32, len(raw), len(extra), 0, 0, 0, 0, _U32) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.entries)
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _U16, _U16, _U32, _U32, 0))
        self.out.close()


def stored_members(file) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, size) of the stored members, from the central directory."""
    size = file.size()
    tail_at = max(0, size - (22 + _U16))
    tail = read_range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail):  # not a record, but bytes of a comment
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: it has no end record")
    n, length, start = struct.unpack_from("<H2I", tail, end + 10)
    if _U16 == n or _U32 in (length, start):
        locator = read_range(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        record = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 end record is missing")
        n, length, start = struct.unpack_from("<3Q", record, 32)
    directory, at, out = read_range(file, start, length), 0, {}
    for _ in range(n):
        if directory[at:at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", directory, at + 8)
        packed, full, name_len, extra_len, comment_len = struct.unpack_from("<2I3H", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + name_len]
        extra, e = directory[at + 46 + name_len:at + 46 + name_len + extra_len], 0
        while e + 4 <= len(extra):
            kind, k = struct.unpack_from("<2H", extra, e)
            if kind == 1:  # holds those of the three values that do not fit, in this order
                wide, w = extra[e + 4:e + 4 + k], 0
                if full == _U32:
                    full, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if packed == _U32:
                    packed, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if local == _U32:
                    local = struct.unpack_from("<Q", wide, w)[0]
            e += 4 + k
        if method == 0:
            head = read_range(file, local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("a local header is missing")
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = local + 30 + sum(struct.unpack_from("<2H", head, 26)), full
        at += 46 + name_len + extra_len + comment_len
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC record in a gzip member; a revisit holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def planned(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, payload and refers_to (null for responses), one row a page."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    short = rows.select("page_id", F.sha1("payload").alias("sha1"))
    best = short.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null")
    revisits = short.join(best, "sha1").where(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("page_id").alias("of"), F.col("sha1").alias("of_sha1"), "best").distinct()
    joined = rows.withColumn("sha1", F.sha1("payload")).join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha1") == F.col("of_sha1")), "left")
    return joined.select("page_id", "url", "payload", F.col("best").alias("refers_to"))


def write_packages(plan: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the records of each partition; path, records and bytes of every package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, path, index = None, None, []

        def closed():
            zip_.end()
            zip_.begin(INDEX)
            zip_.write(b"".join(index))
            zip_.end()
            zip_.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [zip_.at]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                if zip_ is None:
                    path, out = new_file(folder, ".zip")
                    zip_, index = ZipWriter(io.BufferedWriter(_Raw(out), 1 << 20)), []
                    zip_.begin(DATA)
                url = url.as_py().replace("\r", "%0D").replace("\n", "%0A")
                data = record(page_id.as_py(), url, payload.as_py(), refers_to.as_py())
                index.append(f"{zip_.member[3]} {len(data)}\n".encode())
                zip_.write(data)
                if zip_.at >= package_bytes:
                    yield closed()
                    zip_ = None
        if zip_ is not None:
            yield closed()

    return plan.mapInArrow(run, "path string, records long, bytes long")


class _Raw(io.RawIOBase):
    """An output stream for io.BufferedWriter."""

    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)

    def close(self):
        if not self.closed:
            super().close()
            self.out.close()


def records_of(path: str) -> Iterator[bytes]:
    """All records of a package, read in runs of about RUN_BYTES."""
    with open_file(path) as file:
        members = stored_members(file)
        begin, size = members[DATA]
        at, length = members[INDEX]
        ranges = [tuple(map(int, line.split())) for line in read_range(file, at, length).splitlines()]
        k = 0
        while k < len(ranges):
            first, last = ranges[k][0], k + 1
            while last < len(ranges) and ranges[last][0] + ranges[last][1] - first <= RUN_BYTES:
                last += 1
            run = read_range(file, begin + first, ranges[last - 1][0] + ranges[last - 1][1] - first)
            for offset, n in ranges[k:last]:
                if offset + n > size:
                    raise ValueError("the index points beyond the archive")
                yield zlib.decompress(run[offset - first:offset - first + n], 31)
            k = last


ROWS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of all packages of ``manifest`` (path)."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for raw in records_of(path):
                    fields, http, payload = parse(raw)
                    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        n, own = len(payload), digest(payload)
                        if own != stated:
                            raise ValueError(f"{path}: the payload does not match its digest")
                    else:
                        n, own = int(http.rpartition(b"Content-Length: ")[2]), stated
                    page, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    rows.append((page and int(page), fields["WARC-Target-URI"], payload if keep_payload and kind == "response" else None, n, own, kind, to and int(to)))
                    held += len(payload) * keep_payload + 200
                    if held > RUN_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path").mapInArrow(run, ROWS)


def archive(pages: DataFrame, **kw) -> DataFrame:
    """Packs ``pages`` into the shared folder; the manifest, written once."""
    return written(write_packages(planned(pages, **kw), new_path(pages.sparkSession, "packages")), "manifest")


def report(pages: DataFrame, **kw) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the packages."""
    manifest = archive(pages, **kw)
    spread = manifest.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read_packages(spread, keep_payload=False).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT h, max(page_id) AS best FROM d GROUP BY h HAVING count(*) > 1),
x AS (SELECT d.*, CASE WHEN page_id <> best THEN best END AS refers_to FROM d LEFT JOIN b USING (h)),
g AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(1 + 5 * i AS INTEGER), 5) AS INTEGER)) AS parts FROM x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
                       || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM g
"""
