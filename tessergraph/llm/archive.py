"""Operator 8: WARC archives with a two-level capture index.

Writing.  Each page becomes one WARC/1.1 record, its own gzip member; a payload of at
least ``min_bytes`` bytes that an earlier id has too becomes a revisit record without
body.  Spark's text writer puts the members' raw bytes into files, with an empty gzip
member as line separator, so a file is a plain multi-member ``.warc.gz`` and goes to any
store Spark can write.  Pages are dealt to files by a hash of the id; a file holds about
``file_bytes`` of payload, which bounds what a reader task holds.

Index.  (reversed-host key, timestamp, file, offset, length) lines are range-sorted by key and id,
so a host with a third of all pages spreads over partitions, cut into compressed blocks of
``BLOCK`` lines, and a sparse directory keeps each block's first key.  ``lookup`` finds the
block by binary search in the directory, then the line in the block, then reads just that
range of the archive through Hadoop's file system.

Defined cases.  A null html is an empty payload; a null url is written without target and
left out of the index; payloads under ``min_bytes`` are always responses.  Rows with
one page_id are records of their own, each a row of the result; the smallest id among equal payloads is the response, and if
that id is repeated with the same payload all its rows are responses.  Rows with a null id
are written as responses and never referred to.  An empty table gives no files and no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.llm import common

BLOCK = 2000
#: An empty gzip member, written between records.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
MEMBER_HEAD = EMPTY_MEMBER[:10]
DATE = "1970-01-01T00:00:00Z"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    return MEMBER_HEAD + c.compress(data) + c.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: headers, body (none for a revisit) and the closing blank lines."""
    body = b"" if refers_to is not None else payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        out, held = [], 0
        for page_id, url, html, digest, refers_to in rows:
            out.append(_member(record(page_id, url, (html or "").encode(), digest, refers_to)))
            held += len(out[-1])
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 100, file_bytes: int = 16_000_000) -> None:
    """Write the pages' records to ``path`` as multi-member .warc.gz files."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"))
    digest = F.sha2(html.cast("binary"), 256)
    sizes = base.select("page_id", digest.alias("digest"), F.octet_length(html).alias("n"))
    seen, seen_path = common.stored(sizes, "digests")
    shape = seen.agg(F.sum("n").alias("n")).first()
    files = max(1, -(-(shape.n or 0) // file_bytes))
    owner = seen.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("c"))
    again = seen.where(F.col("n") >= min_bytes).join(owner.where("c > 1"), "digest").where(F.col("page_id") != F.col("owner"))
    again = again.groupBy("page_id", "digest").agg(F.min("owner").alias("refers_to"))
    # the join needs these keys together, so the pages are shuffled once
    whole = base.withColumn("digest", digest).repartition(files, "page_id", "digest") if files > 1 else base.withColumn("digest", digest).coalesce(1)
    rows = whole.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    members = rows.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    common.remove(pages.sparkSession, seen_path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a multi-member file."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        view = z.decompress(data[at : at + 65536])
        end = at + 65536
        parts = [view]
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + 1_000_000]))
            end += 1_000_000
        if not z.eof:
            raise ValueError(f"a gzip member at byte {at} isn't complete")
        length = min(end, len(data)) - len(z.unused_data) - at
        if record_bytes := b"".join(parts):
            yield at, length, *split_record(record_bytes)
        at += length


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            out = []
            for offset, length, h, body in parse(content.as_py()):
                kind = h["WARC-Type"]
                if kind == "response":
                    n, digest = len(body), hashlib.sha256(body).hexdigest()
                    if f"sha256:{digest}" != h["WARC-Payload-Digest"]:
                        raise ValueError(f"the record at byte {offset} of {path} doesn't match its digest")
                else:
                    n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                out.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, n, digest, _page(h.get("WARC-Refers-To")), path.as_py(), offset, length))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, checked against its digest, with its place in the archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(_read, READ)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, as capture indexes sort them."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url
    host = host.removeprefix("www.")
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string()), *b.columns[1:]], ["key", "page_id", "record_type", "file", "offset", "length"])


INDEX = "first_key string, last_key string, part int, n long, block binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), []

    def packed() -> pa.RecordBatch:
        text = "\n".join("\t".join(map(str, x)) for x in held).encode()
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[-1][0]]), pa.array([part], pa.int32()), pa.array([len(held)]), pa.array([zlib.compress(text)], pa.binary())], ["first_key", "last_key", "part", "n", "block"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append((row[0].replace("\t", "%09").replace("\n", "%0A"), *row[1:]))
            if len(held) == BLOCK:
                yield packed()
                held.clear()
    if held:
        yield packed()


def build_index(records: DataFrame, path: str) -> DataFrame:
    """Write the sorted, compressed blocks to ``path``; the directory (first_key, last_key, part, n) is its sparse level."""
    spark = records.sparkSession
    keyed = records.where("url IS NOT NULL").select("url", "page_id", "record_type", "file", "offset", "length")
    keyed = keyed.mapInArrow(_keys, "key string, page_id long, record_type string, file string, offset long, length long")
    ordered = keyed.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    ordered.mapInArrow(_blocks, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path).select("first_key", "last_key", "part", "n")


def lookup(spark: SparkSession, index: str, url: str, limit: int = 10) -> list[tuple[dict[str, str], bytes]]:
    """The first ``limit`` captures of a url: directory, block, line, then a range read of each record."""
    key = url_key(url).replace("\t", "%09").replace("\n", "%0A")
    # Parquet statistics on the sorted directory stand for its binary search: only blocks that can hold the key are read
    blocks = spark.read.schema(INDEX).parquet(index).where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "part").limit(limit + 1).collect()
    found = []
    for b in blocks:
        lines = [x.split("\t") for x in zlib.decompress(b.block).decode().split("\n")]
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key and len(found) < limit:
            _, _, _, file, offset, length = lines[at]
            found.append(split_record(gzip.decompress(read_range(spark, file, int(offset), int(length)))))
            at += 1
    return found


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Hadoop reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = common.written(read_archive(spark, path), "records")
    build_index(records, common.shared_path(spark, "cdx"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN owner < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner < page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 100
"""
