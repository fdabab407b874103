"""WARC archives: a writer and a sequential reader.

Every record is one gzip member. The reader decompresses incrementally, frames the block by Content-Length,
and verifies the digest of the block and, for responses and resources, of the payload; anything that does not fit raises
ValueError. Payloads of at least `least_bytes` that equal an earlier one are written as revisit records, which
name the response's record and page and keep the payload's size and digest but not the payload.

Archives are binary rows (archive, content) of about `archive_bytes` each, kept in Parquet in the shared folder,
so that any file system that Spark reaches will do; read_files() streams plain .warc.gz files of any size, one record at a
time, with the same reader.

Archives of others: digests may be SHA-1, SHA-256, SHA-512 or MD5 in hexadecimal or Base32 (other algorithms are passed
over); the payload of an `application/http` block is the entity body, whose digest may be that of the body as it came or with
its chunks joined; the headers that only this writer knows are null or taken from the block.

Defined cases: null html: the empty payload; null url: no WARC-Target-URI; control characters in a url are
percent-encoded. Empty table: no archives, no rows. Rows with the smallest page_id of a payload are responses
(all of them, if the page_id is repeated); a row without page_id is a response, and never the one referred to.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import cut, map_arrow, materialise, table

#: Up to so many groups of equal payloads are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 50_000
_DATE = "2024-01-01T00:00:00Z"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One WARC record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of each gzip member of a stream that arrives in pieces."""
    z, out, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            fed = True
            out.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("WARC: the last gzip member is cut off")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; checks framing and digests."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("WARC: no record header")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"WARC: bad header line {line!r}")
        headers[k.strip().lower()] = v.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("WARC: no Content-Length")
    n = int(length)
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC: the block does not fit Content-Length")
    if not _agrees(headers.get("warc-block-digest"), [block]):
        raise ValueError("WARC: warc-block-digest does not match")
    whole = headers.get("warc-type") in ("response", "resource") and "warc-segment-number" not in headers
    if whole and not _agrees(headers.get("warc-payload-digest"), _payloads(headers, block)):
        raise ValueError("WARC: warc-payload-digest does not match")
    return headers, block


_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


def _agrees(stated: str | None, contents: list[bytes]) -> bool:
    """Whether a digest header (null: yes) is that of one of the contents."""
    name, _, value = (stated or "").partition(":")
    make = _HASHES.get(name.strip().lower().replace("-", ""))
    if make is None:
        return True
    size = make().digest_size
    value = value.strip()
    try:
        want = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error):
        return False
    return any(make(c).digest() == want for c in contents)


def _payloads(headers: dict[str, str], block: bytes) -> list[bytes]:
    """What may count as the payload of a record: the block, or an HTTP message's body as it came and with its chunks joined."""
    if not headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return [block]
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return [block]
    joined = _unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else None
    return [body] if joined is None else [joined, body]


def _unchunked(body: bytes) -> bytes | None:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]+)", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def read_stream(data: bytes, piece: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    view = memoryview(data)
    return map(parse, members(bytes(view[i : i + piece]) for i in range(0, len(view), piece)))


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def record_types(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )
    firsts = (
        pages.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first < last")
        .select("payload_digest", "first")
    )
    firsts = materialise(firsts)
    if firsts.count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    return (
        pages.join(firsts, "payload_digest", "left")
        .withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
        .drop("first")
    )


def write_archives(typed: DataFrame, archive_bytes: int = 4_000_000) -> DataFrame:
    """Archives of record_types() rows, written to the shared folder: rows (archive string, content binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{uuid.uuid4().hex}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            for row in (r for part in cut(batch) for r in part.to_pylist()):
                page, refers = row["page_id"], row["refers_to"]
                digest = f"sha256:{row['payload_digest']}"
                headers = [
                    ("WARC-Record-ID", record_id(page, digest)),
                    ("WARC-Date", _DATE),
                    ("WARC-Payload-Digest", digest),
                    ("WARC-Payload-Length", str(row["payload_bytes"])),
                ]
                if page is not None:
                    headers.append(("WARC-Page-ID", str(page)))
                if row["url"] is not None:
                    headers.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"])))
                if refers is None:
                    held.append(record("response", [*headers, ("Content-Type", "text/html")], row["payload"]))
                else:
                    headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    headers += [("WARC-Refers-To", record_id(refers, digest)), ("WARC-Refers-To-Page-ID", str(refers))]
                    held.append(record("revisit", headers, b""))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    # row groups bound what the reader holds at once
    return materialise(map_arrow(typed, run, "archive string, content binary"), **{"parquet.block.size": 16 << 20})


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _rows(records: Iterable[tuple[dict[str, str], bytes]], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of the records of one archive."""
    names = [c.split()[0] for c in _READ.split(", ")]
    cols: list[list] = [[] for _ in names]
    size = 0
    for h, block in records:
        kind = h.get("warc-type")
        payload = _payloads(h, block)[0] if kind in ("response", "resource") else None
        length = _number(h.get("warc-payload-length"))
        algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
        row = (
            _number(h.get("warc-page-id")),
            h.get("warc-target-uri"),
            payload if with_payload else None,
            length if length is not None else len(block if payload is None else payload),
            digest if algorithm == "sha256" else h.get("warc-payload-digest"),
            kind,
            _number(h.get("warc-refers-to-page-id")),
        )
        for col, value in zip(cols, row):
            col.append(value)
        size += len(block) if with_payload else 100
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names)
            cols, size = [[] for _ in names], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of archives (column content), in order; payload is null for revisits and if not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _rows(read_stream(batch.column(0)[i].as_py()), with_payload)

    return map_arrow(archives.select("content"), run, _READ)


def read_files(spark: SparkSession, path: str, with_payload: bool = True, piece: int = 1 << 20) -> DataFrame:
    """Records of the .warc.gz files of a path or pattern, one task a file, which streams it from the file system (those
    that Arrow knows: local and mounted folders, HDFS, S3, GCS): a task holds one record and one piece, however large the file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    names = sorted(s.getPath().toString() for s in found or [] if s.isFile())
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(len(names), 1), "file")

    def chunks(name: str) -> Iterator[bytes]:
        system, inside = pa.fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if re.match(r"s3a://|file:/[^/]", name) else name)
        with system.open_input_stream(inside, compression=None) as f:
            while got := f.read(piece):
                yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _rows(map(parse, members(chunks(name))), with_payload)

    return map_arrow(files, run, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(record_types(table(spark, sf_dir, "pages")))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
