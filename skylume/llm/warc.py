"""WARC archives: a deterministic sharded writer and a reader.

Method: records are range-sorted by id into shards whose borders are quantiles of a
hash-chosen sample of ids (the same for the same table), a shard's task streams its sorted
records into files that roll at a compressed size, headers and digests are made anew, each
file is written under a temporary name and renamed, and a manifest names the files that
count.  A task that runs again writes the same bytes under the same names; leftovers of
lost tasks are not in the manifest and are never read.

Of the records with equal payloads of at least ``min_bytes`` bytes the one with the least
id is a response and the others are revisits of it; smaller payloads are all responses.

Files hold one gzip member a record.  They are written through a file system chosen by the
folder's URI and read back by Spark's binary source.

Defined cases: a null payload is empty; a null url leaves the header out; a null id comes
first, and stays null; rows that repeat the least id are all responses; line breaks in a
url are percent-encoded; an empty table gives an archive without files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, settle

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads broadcast at most.
BROADCAST_GROUPS = 200_000
#: Ids looked at to find the borders of shards.
BORDER_SAMPLE = 20_000


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _record_id(page: int | None, digest: str) -> bytes:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}:{digest}'.encode()).digest()[:16])}>".encode()


def encode_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record: an HTTP response block, without its body for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if is_revisit else b"response"), b"WARC-Record-ID: " + _record_id(page, digest), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    if is_revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _record_id(first, digest), b"X-Refers-To-Page: %d" % first]
    if page is not None:
        head.append(b"X-Page-Id: %d" % page)
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); raises where length or block digest do not hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


class _Roller:
    """Writes one shard's records to files of about ``target`` compressed bytes."""

    def __init__(self, folder: str, shard: int, target: int):
        self.system, self.folder = _system(folder)
        self.shard, self.target, self.roll, self.done = shard, target, 0, []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/.tmp-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.system.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.target:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:06d}-{self.roll:04d}.warc.gz"
        self.system.move(self.temporary, f"{self.folder}/{name}")
        self.done.append((name, self.size, self.records, self.sha.hexdigest()))
        self.roll, self.out = self.roll + 1, None


MANIFEST = "name string, bytes long, records long, sha256 string"


def _borders(ids: DataFrame, shards: int) -> list[int]:
    """At most ``shards`` - 1 borders: quantiles of a sample that a hash of the id picks."""
    if shards < 2:
        return []
    n = ids.count()
    step = max(1, n // BORDER_SAMPLE)
    sample = sorted(r[0] for r in ids.filter(F.pmod(F.xxhash64("i"), F.lit(step)) == 0).filter("i is not null").select("i").limit(4 * BORDER_SAMPLE).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def with_first(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """i, url, html, digest, n and ``first``: the least id of an equal large payload, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumns({"html": html, "digest": F.sha2(html, 256), "n": F.octet_length(html).cast("long")})
    groups = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    groups = settle(groups)
    return rows.join(maybe_broadcast(groups, groups.count(), BROADCAST_GROUPS), "digest", "left")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100, file_bytes: int = 4 << 20, shard_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z") -> list[str]:
    """Write the archive under ``folder`` (a URI all executors share); returns its files' names.

    Files roll at ``file_bytes`` compressed bytes; shards hold about ``shard_bytes`` of payload.
    The manifest is written last: without it there is no archive.
    """
    slim = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).alias("url"), F.col(html).alias("html"))
    total = slim.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    borders = _borders(slim.select("i"), max(1, -(-total // shard_bytes)))
    shard = F.lit(0)
    if borders:
        shard = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.coalesce(F.col("i"), F.lit(-(1 << 63)))))
    rows = with_first(slim, min_bytes).withColumn("shard", shard.cast("int"))
    dealt = rows.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("i").asc_nulls_first(), "digest", "url")
    _system(folder)[0].create_dir(_system(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = None
        for batch in batches:
            for r in batch.to_pylist():
                if roller is None or roller.shard != r["shard"]:
                    if roller:
                        roller.close()
                        yield _rows(roller.done)
                    roller = _Roller(folder, r["shard"], file_bytes)
                revisit = r["first"] is not None and r["i"] != r["first"]
                roller.add(encode_record(r["i"], r["url"], r["html"].encode(), r["digest"], r["first"], revisit, date))
        if roller:
            roller.close()
            yield _rows(roller.done)

    files = sorted(tuple(r) for r in dealt.select("shard", "i", "url", "html", "digest", "first").mapInArrow(write, MANIFEST).collect())
    system, path = _system(folder)
    lines = "".join(json.dumps(dict(zip(("name", "bytes", "records", "sha256"), f, strict=True))) + "\n" for f in files)
    temporary = f"{path}/.tmp-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(lines.encode())
    system.move(temporary, f"{path}/manifest.jsonl")
    return [f[0] for f in files]


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names, sizes, records, digests = zip(*done, strict=True) if done else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(records, pa.int64()), pa.array(digests, pa.string())], names=["name", "bytes", "records", "sha256"])


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _members(data: memoryview) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            piece = data[at : at + 65536]
            if not piece:
                raise ValueError("archive ends within a record")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files in the manifest, digests checked against the payloads."""
    schema = T.StructType(READ.fields[: 6 + with_payload])
    names = [json.loads(r[0])["name"] for r in spark.read.text(f"{folder}/manifest.jsonl").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for member in _members(memoryview(content.as_buffer())):
                    rows.append(_parsed(member, with_payload))
                    held += len(member) if with_payload else 200
                    if held > 8 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    return files.mapInArrow(parse, schema)


def _parsed(member: bytes, with_payload: bool) -> tuple:
    h, block = decode_record(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    page, first = h.get("x-page-id"), h.get("x-refers-to-page")
    row = (int(page) if page else None, h.get("warc-target-uri"), length, digest, h["warc-type"], int(first) if first else None)
    return (*row, payload if h["warc-type"] == "response" else None) if with_payload else row


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=schema.names)
