"""WARC archives: a writer with revisits and a salvage reader.

Writer: each task writes its pages as one or more ``.warc.gz`` files of about
``FILE_BYTES`` of payload, a gzip member per record, to a shared folder. File
names are unique to the attempt, and a file counts only if it is in the manifest
that Spark commits, so repeated or lost tasks leave no trace. Of equal payloads of
``REVISIT_BYTES`` at least, the one with the smallest id is a response, the others
are revisits without payload; which they are is found on digests alone.

Reader: a file is read in pieces of ``READ_BYTES``. A member may hold one record, as the writer's do, or
many; its records are searched in what it holds, with the gaps between. A record counts if its member
decompresses with the right checksum, its version line, headers, length and end
are in order, and its digest fits. If a check fails, the reader looks on from
the next byte for the next gzip magic number, or version line in plain archives,
where a record passes all checks, recovers the later records, and reports the
bytes between as a quarantined gap.

Defined cases: a null payload is empty; payloads shorter than ``REVISIT_BYTES``
are all responses; rows that repeat an id give a record each, and of such rows
with the smallest id all records are responses; a null id is written without a
number, is a response and never the one that others revisit; an empty table gives
no files; other columns are ignored. A record larger than memory
isn't read: a record, and a member as compressed, is held whole while it is checked.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, STRING, materialise, schema, scratch_path, ship_package

REVISIT_BYTES = 100
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2000-01-01T00:00:00Z"


def record(kind: str, number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record's bytes. The block of a revisit is empty; its payload digest and
    length are the full payload's."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record at ``at`` if it passes all checks."""
    line = VERSION.match(data, at)
    stop = data.find(b"\r\n\r\n", at) if line else -1
    if stop < 0:
        return None
    try:
        pairs = [x.split(": ", 1) for x in data[line.end():stop].decode().split("\r\n")]
        head = {k.lower(): v for k, v in pairs}
        size = int(head["content-length"])
    except (ValueError, KeyError):
        return None
    begin = stop + 4
    block = data[begin:begin + size]
    if size < 0 or len(block) < size or data[begin + size:begin + size + 4] != b"\r\n\r\n":
        return None
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return None
    return head, block, begin + size + 4


class _Source:
    """Bytes of a stream from ``base`` on, read as they are wanted."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.base, self.data, self.ended = stream, step, 0, bytearray(), False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(max(self.step, len(self.data) // 2))
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[:to - self.base]
        self.base = to


def _member_end(source: _Source, at: int) -> int | None:
    """End of the gzip member at ``at`` if it decompresses with the right checksum; what it
    holds is not kept."""
    d = zlib.decompressobj(31)
    pos = at - source.base
    try:
        while not d.eof:
            if pos >= len(source.data) and not source.more():
                return None
            piece = bytes(source.data[pos:pos + source.step])
            while piece:
                d.decompress(piece, source.step)
                left = d.unused_data if d.eof else d.unconsumed_tail
                pos += len(piece) - len(left)
                piece = b"" if d.eof else left
    except zlib.error:
        return None
    return source.base + pos


class _Unzipped:
    """What a sound gzip member holds, as a stream."""

    def __init__(self, data: bytes):
        self.left, self.zip = data, zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while self.left:
            out = self.zip.decompress(self.left, n)
            self.left = self.zip.unconsumed_tail
            if out:
                return out
        return b""


def _plain_record(source: _Source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    while len(source.data) - (at - source.base) < 10 and source.more():
        pass
    if not VERSION.match(source.data, at - source.base):
        return None
    while True:
        head = source.data.find(b"\r\n\r\n", at - source.base)
        length = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})\r\n", bytes(source.data[at - source.base:head + 2])) if head >= 0 else None
        need = head + 8 + int(length[1]) if length else None
        if need is not None and len(source.data) >= need or source.ended or head >= 0 and not length:
            got = parse(bytes(source.data[at - source.base:need]))
            return (got[0], got[1], at + got[2]) if got else None
        source.more()


def _next_start(source: _Source, at: int, zipped: bool) -> int | None:
    """First place from ``at`` on where a member (unless ``zipped``: within one) or version line may begin."""
    while True:
        here = at - source.base
        gz = -1 if zipped else source.data.find(GZIP, here)
        line = VERSION.search(source.data, here)
        found = [x for x in (gz if gz >= 0 else None, line.start() if line else None) if x is not None]
        if found:
            return source.base + min(found)
        at = max(at, source.base + len(source.data) - 9)
        source.drop(at)
        if not source.more():
            return None


def _member_records(source: _Source, at: int, end: int) -> Iterator[tuple]:
    """Records of a sound member, and the gaps between; nothing if it has no record."""
    items = ((kind, at, end, head, block, (start, stop)) for kind, start, stop, head, block, _ in salvage(
        _Unzipped(bytes(source.data[at - source.base:end - source.base])), source.step, True))
    first = []
    for item in items:
        first.append(item)
        if item[0] == "record":
            break
    else:
        return
    after = next(items, None)
    if len(first) == 1 and after is None:  # one record and nothing else
        yield (*first[0][:5], None)
        return
    yield from first
    if after is not None:
        yield after
        yield from items


def salvage(stream, step: int = READ_BYTES, zipped: bool = False) -> Iterator[tuple[str, int, int, dict[str, str], bytes, tuple[int, int] | None]]:
    """("record", start, end, headers, block, inner) of each good record in file order,
    and ("gap", start, end, {}, b"", inner) of the quarantined bytes between. A member with other than one
    record gives its own place for each of its records and gaps, and their place in what it holds as ``inner``."""
    source, at, lost = _Source(stream, step), 0, None
    while True:
        while len(source.data) - (at - source.base) < 10 and source.more():
            pass
        end, items = None, iter(())
        if not zipped and source.data[at - source.base:at - source.base + 3] == GZIP:
            end = _member_end(source, at)
            items = _member_records(source, at, end) if end else items
        else:
            got = _plain_record(source, at)
            if got:
                end, items = got[2], iter([("record", at, got[2], got[0], got[1], None)])
        first = next(items, None)
        if first is not None:
            if lost is not None:
                yield "gap", lost, at, {}, b"", None
                lost = None
            yield first
            yield from items
            at = end
            source.drop(at)
            continue
        if source.ended and at >= source.base + len(source.data):
            if lost is not None:
                yield "gap", lost, at, {}, b"", None
            return
        lost = at if lost is None else lost
        start = _next_start(source, at + 1, zipped)
        at = source.base + len(source.data) if start is None else start
        if start is not None:
            source.drop(at)


class _Damaged:
    """A stream with one bit changed at each of some places."""

    def __init__(self, stream, spots: list[int]):
        self.stream, self.spots, self.at = stream, spots, 0

    def read(self, n: int) -> bytes:
        data = bytearray(self.stream.read(n))
        for spot in self.spots:
            if self.at <= spot < self.at + len(data):
                data[spot - self.at] ^= 0x10
        self.at += len(data)
        return bytes(data)


def _open(path: str, write: bool = False):
    """A file of the shared folder, in whatever store it is."""
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if write:
        store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at) if write else store.open_input_stream(at)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest (path, records)."""
    ship_package(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    given = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    digests = given.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    digests, _ = materialise(digests, "digests")
    firsts = (digests.where((F.col("bytes") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest")
              .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("digest").alias("_digest"), "first"))
    revisits = (digests.join(firsts, F.col("digest") == F.col("_digest")).where("id <> first")
                .select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct())
    marked = (given.withColumn("digest", F.sha2("payload", 256))
              .join(revisits, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
              .select("id", "url", "payload", "digest", F.col("first").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, held, count = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([count], pa.int64())})

        for b in batches:
            for i, url, payload, digest, ref in zip(*(b.column(c) for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path, held, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, write=True)
                body, ref = payload.as_py(), ref.as_py()
                kind = "response" if ref is None else "revisit"
                out.write(member(record(kind, i.as_py(), url.as_py(), body, digest.as_py(), ref)))
                held, count = held + len(body), count + 1
                if held >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    manifest, _ = materialise(marked.mapInArrow(run, schema(path=STRING, records=LONG)), "manifest")
    return manifest


def read_archives(manifest: DataFrame, path_col: str = "path", with_block: bool = True, damage_every: int | None = None) -> DataFrame:
    """Rows of kind record or gap: path, start, end, and of records the headers' id,
    type, url, digest, length, reference and the block. A member with several records gives each a row.

    With ``damage_every`` each archive is read a second time with a bit changed in the middle of every
    record whose id that number divides, and ``salvaged`` tells whether the record came back all the same;
    else it is null."""
    ship_package(manifest.sparkSession)
    out = schema(kind=STRING, path=STRING, start=LONG, end=LONG, id=LONG, record_type=STRING, url=STRING,
                 payload_digest=STRING, payload_bytes=LONG, refers_to=LONG).add("block", "binary").add("salvaged", "boolean")

    def number(x: str | None) -> int | None:
        m = re.search(r"(-?\d+)>?$", x or "")
        return int(m[1]) if m else None

    def sound(path: str) -> Iterator[tuple]:
        with _open(path) as stream:
            for kind, start, end, head, block, _ in salvage(stream):
                n = number(head.get("x-payload-length")) if kind == "record" else None
                yield (kind, path, start, end, number(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"),
                       head.get("warc-payload-digest", "").removeprefix("sha256:") if head else None,
                       n if n is not None or kind == "gap" else len(block), number(head.get("warc-refers-to")),
                       block if with_block and kind == "record" else None, None)

    def rows(path: str) -> Iterator[tuple]:
        if not damage_every:
            yield from sound(path)
            return
        places = [(*r[:5],) for r in sound(path)] if with_block else list(sound(path))  # no block is held
        spots = [(r[2] + r[3]) // 2 for r in places if r[0] == "record" and r[4] is not None and r[4] % damage_every == 0]
        with _open(path) as stream:
            back = {(start, end) for kind, start, end, *_ in salvage(_Damaged(stream, spots)) if kind == "record"}
        for r in sound(path) if with_block else places:
            yield (*r[:-1], (r[2], r[3]) in back if r[0] == "record" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, *[pa.int64()] * 2, pa.binary(), pa.bool_()]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], out.names)

        for b in batches:
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[-2] or b"") + 200
                    if size > 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    spark = manifest.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return (manifest.select(F.col(path_col).alias("path")).repartition(parts, "path").mapInArrow(run, out))


DAMAGE_EVERY = 97


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by the salvage reader, from the archives as they are and
    from the archives with the records of every 97th id damaged (``salvaged``)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    back = read_archives(manifest, with_block=False, damage_every=DAMAGE_EVERY).where("kind = 'record'")
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "salvaged")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to,
       page_id IS NULL OR page_id % 97 <> 0 AS salvaged FROM f
"""
