"""WARC archives in seekable Zstandard bundles.

``write`` turns each page into a WARC 1.1 record. Of pages with equal payloads the one
with the smallest id is a ``response`` with the payload, the others are ``revisit``
records that name it and hold no payload. Tasks group records into Zstandard frames of
about ``FRAME_BYTES``, each of which can be read without any other, and frames into
bundles, which end in a seek table: a skippable frame with the sizes of all frames, as
the public seekable format lays it out, so any Zstandard tool reads a bundle as one
stream of records. The folder holds

* ``bundles/*.warc.zst``,
* ``index``, a Parquet table with a row a record: its id, record id, type and digest, the
  bundle, frame and frame bytes that hold it, and its offset and length within its frame.

A task writes its bundles under names of its own, and only the index, which Spark
commits, says which of them count; what a lost task has left is never read.

``records`` reads all bundles back through their seek tables, frame by frame, and checks
each payload against its digest. ``lookup`` reads only the frames that hold the wanted
ids, and the frames of the responses that these revisit.

Defined cases: a null payload is empty; empty payloads are equal to each other unless
``least`` is above 0; payloads below ``least`` bytes are all responses; a null id stands
after all others, and is read back as null; repeated rows are records of their own, one
of them the response; a null URL leaves the header out; blanks and control characters in
a URL are percent-encoded, as a header's line cannot hold them; columns besides the id,
the URL and the payload are left out; an empty table gives an empty index and no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import checked, held_at, removed, scratch, written

#: Uncompressed bytes of a frame, about, and compressed bytes of a bundle, about.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
#: Payloads up to ``SMALL`` come to a writer as many at once as make up ``BATCH_BYTES``; larger ones come one by one.
SMALL = 1 << 18
BATCH_BYTES = 1 << 26
#: Compressed bytes that a task reads, about.
READ_BYTES = 1 << 25
#: Up to so many shared payloads (150 bytes each, about) are broadcast.
BROADCAST_SHARED = 200_000
LEVEL = 3
#: Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "id string, record_id string, record_type string, digest string, bundle string, frame int, frame_start bigint, frame_bytes bigint, offset bigint, length bigint"
RECORD = "id string, record_id string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to string, refers_to_record string, bundle string, frame int, offset bigint, payload binary"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer of a bundle: the compressed and the plain size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int]]:
    """(start, compressed bytes) of each frame of a bundle of ``size`` bytes, of which ``read(start, n)`` gives a part."""
    if size < 17:
        raise ValueError("the bundle ends before its seek table")
    n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    entry = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or size < 17 + entry * n:
        raise ValueError("the bundle does not end in a seek table")
    table = read(size - 9 - entry * n, entry * n)
    out, at = [], 0
    for k in range(n):
        length = struct.unpack_from("<I", table, entry * k)[0]
        out.append((at, length))
        at += length
    if at + 17 + entry * n != size:
        raise ValueError("the seek table does not fit the bundle")
    return out


def _record_id(run: str, row: int) -> str:
    h = hashlib.md5(f"{run}:{row}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f]")


def _line(name: str, value: str | int | None) -> str:
    return "" if value is None else f"{name}: {value}\r\n"


def record(run: str, row: dict) -> tuple[str, str, bytes]:
    """(record id, digest, bytes) of the record of ``row``: its row, id, url, payload, size, sha, first (the row it revisits, else null) and first_id."""
    own, digest = _record_id(run, row["row"]), base64.b32encode(row["sha"]).decode()
    revisit = row["first"] is not None
    url = row["url"] if row["url"] is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"])
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode() + (b"" if revisit else row["payload"])
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {own}\r\nWARC-Date: {DATE}\r\n"
    head += _line("WARC-Target-URI", url) + f"WARC-Payload-Digest: sha1:{digest}\r\n" + _line("X-Page-ID", row["id"])
    if revisit:
        head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_record_id(run, row['first'])}\r\n" + _line("X-Refers-To-Page-ID", row["first_id"])
    head += f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return own, digest, head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, headers, block's own headers, payload) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC record where one should begin")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        http, _, payload = data[start:stop].partition(b"\r\n\r\n")
        yield at, stop + 4 - at, head, http, payload
        at = stop + 4


class _Bundles:
    """Where a task puts its records; ``closed`` gets the index rows of each frame that is written."""

    def __init__(self, root: str):
        import zstandard

        self.store, self.root = fs.FileSystem.from_uri(root)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out, self.rows, self.parts, self.size = None, [], [], 0

    def add(self, row: dict, own: str, digest: str, data: bytes) -> list[tuple]:
        self.rows.append((None if row["id"] is None else str(row["id"]), own, "revisit" if row["first"] is not None else "response", digest, self.size, len(data)))
        self.parts.append(data)
        self.size += len(data)
        return self.closed() if self.size >= FRAME_BYTES else []

    def closed(self) -> list[tuple]:
        """Writes the records held as a frame."""
        if not self.rows:
            return []
        if self.out is None:
            self.store.create_dir(f"{self.root}/bundles", recursive=True)
            self.name, self.frames, self.at = f"{uuid.uuid4().hex}.warc.zst", [], 0
            self.out = self.store.open_output_stream(f"{self.root}/bundles/{self.name}", compression=None)  # else the name would have it packed again
        packed = self.packer.compress(b"".join(self.parts))
        self.out.write(packed)
        done = [(*r[:4], self.name, len(self.frames), self.at, len(packed), *r[4:]) for r in self.rows]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.rows, self.parts, self.size = [], [], 0
        if self.at >= BUNDLE_BYTES:
            self.end()
        return done

    def end(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def _indexed(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _writer(root: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = _Bundles(root)
        for b in batches:
            done = []
            for row in b.to_pylist():
                done += bundles.add(row, *record(run, row))
            if done:
                yield _indexed(done)
        if done := bundles.closed():
            yield _indexed(done)
        bundles.end()

    return write_


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes ``pages`` as an archive into the folder ``path``, which all executors can write to, and returns its index."""
    spark, run = pages.sparkSession, uuid.uuid4().hex
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keyed = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    # written once, so that a row keeps its number whatever is computed again
    keyed, at = held_at(keyed.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("sha", F.unhex(F.sha1("payload"))), "pages")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    shared = keyed.filter(F.col("size") >= least).groupBy("sha").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared, firsts = held_at(shared.select(F.col("sha").alias("s"), F.col("f.row").alias("first"), F.col("f.id").alias("first_id")), "shared")
    rows = keyed.join(checked(shared, BROADCAST_SHARED), (F.col("sha") == F.col("s")) & (F.col("row") != F.col("first")) & (F.col("size") >= least), "left").drop("s")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for small, most in ((True, BATCH_BYTES // SMALL), (False, 1)):
            spark.conf.set(setting, most)
            fits = F.col("size") <= SMALL
            rows.filter(fits if small else ~fits).mapInArrow(_writer(path, run), INDEX).write.mode("append").parquet(f"{path}/index")
    finally:
        spark.conf.set(setting, before)
    removed(spark, at, firsts)
    return index(spark, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _opened(path: str, name: str) -> pa.NativeFile:
    store, root = fs.FileSystem.from_uri(path)
    return store.open_input_file(f"{root}/bundles/{name}")


_FRAME = "bundle string, frame int, frame_start bigint, frame_bytes bigint"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, frame, frame_start, frame_bytes) by the seek tables at the ends of the bundles."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b["bundle"].to_pylist():
                with _opened(path, name) as f:
                    found = frames_of(lambda at, n, f=f: f.read_at(n, at), f.size())
                yield pa.RecordBatch.from_pydict({"bundle": [name] * len(found), "frame": pa.array(range(len(found)), pa.int32()), "frame_start": pa.array([x[0] for x in found], pa.int64()), "frame_bytes": pa.array([x[1] for x in found], pa.int64())})

    return index(spark, path).groupBy("bundle").agg(F.lit(1).alias("n")).select("bundle").mapInArrow(footers, _FRAME)


def _reader(path: str, payloads: bool, wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, kinds = zip(*(c.split() for c in RECORD.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker, open_, name = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for r in b.to_pylist():
                if r["bundle"] != name:
                    open_, name = _opened(path, r["bundle"]), r["bundle"]
                data, out = unpacker.decompress(open_.read_at(r["frame_bytes"], r["frame_start"])), []
                only = set(r["records"]) if wanted else None
                for offset, _, head, http, payload in parsed(data):
                    if only is not None and head["WARC-Record-ID"] not in only:
                        continue
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
                    held = payload if payloads and kind == "response" else None
                    out.append((head.get("X-Page-ID"), head["WARC-Record-ID"], kind, head.get("WARC-Target-URI"), size, digest, head.get("X-Refers-To-Page-ID"), head.get("WARC-Refers-To"), name, r["frame"], offset, held))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    return read


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of an archive; a revisit has no payload of its own, but its size and digest are those of the payload it stands for."""
    found, _ = held_at(frames(spark, path), "frames")
    total = found.agg(F.sum("frame_bytes").alias("n")).first()["n"] or 0
    tasks = min(100_000, max(spark.sparkContext.defaultParallelism, total // READ_BYTES))
    return found.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(_reader(path, payloads, False), RECORD)


def _read_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The records of the index rows ``places``, of which each frame is read once."""
    by_frame = places.groupBy("bundle", "frame", "frame_start", "frame_bytes").agg(F.collect_set("record_id").alias("records"))
    return by_frame.mapInArrow(_reader(path, True, True), RECORD)


def lookup(spark: SparkSession, path: str, ids: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, record_id, record_type, url, payload) of the wanted ids, revisits with the payload of their response."""
    listed = index(spark, path)
    wanted = ids.select(F.col(id).cast("string").alias("id")).distinct()
    found = written(_read_at(spark, path, listed.join(wanted, "id", "left_semi")), "wanted")
    answers = found.filter("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    held = _read_at(spark, path, listed.join(answers, "record_id", "left_semi")).select(F.col("record_id").alias("refers_to_record"), F.col("payload").alias("answer"))
    kind = ids.schema[id].dataType
    return found.join(held, "refers_to_record", "left").select(F.col("id").cast(kind).alias(id), "record_id", "record_type", "url", F.coalesce("payload", "answer").alias("payload"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = records(spark, path, payloads=False)
    return got.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


_BITS = ", ".join(f"'{k:04b}'" for k in range(16))
_SQL = f"""
WITH sized AS (SELECT row_number() OVER () AS row, page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ([{_BITS}])[position(substr(h, i::INTEGER, 1) IN '0123456789abcdef')]), '') AS b FROM sized),
told AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, (5 * i + 1)::INTEGER, 1)::INTEGER + 8 * substr(b, (5 * i + 2)::INTEGER, 1)::INTEGER
 + 4 * substr(b, (5 * i + 3)::INTEGER, 1)::INTEGER + 2 * substr(b, (5 * i + 4)::INTEGER, 1)::INTEGER + substr(b, (5 * i + 5)::INTEGER, 1)::INTEGER, 1)), '') AS payload_digest,
 row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, row) AS place, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, row) AS first FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to FROM told"""

QUERIES = {"op13_warc": op13_warc}
ORACLE = {"op13_warc": _SQL}
