"""WARC archives: written by tasks, read back in ranges, verified by boundary chains.

Writing. Pages with equal payloads of at least a given size share one response, that of the
least id; the others become revisits that refer to it. Digests are counted without the
payloads, so a payload held by a third of all pages moves no more than any other. Tasks write
files of bounded size to the shared folder; only the files named in committed rows count.

Reading. Files are cut into ranges. A task looks for the record magic in its range and emits a
candidate for each: its offset and that of its successor, from the record's own header (or,
for compressed archives, from the end of the member). Magic inside payloads gives false
candidates. Records are those that a chain of successors reaches from the file's start: the
chains inside each range are followed in place, and ranges are joined by pointer jumping, which
doubles the reach with every round. Everything else is dropped, and only then are records read.

Edge cases: a null payload is empty. Payloads may hold whole records, magic or compressed
members. Repeated ids get records of their own. A null id is written without a page id; equal
payloads refer to the least id that is not null. An empty table gives no files and no records.
A file that ends inside a record gives the records before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.storage import opened, shared_folder, stored, write_once

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08\x00"
BLANK = b"\r\n\r\n"
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
HEADER_BYTES = 64 << 10  # read at first for a record's header; more as long as it goes on
_HEADER_LINE = re.compile(rb"[\x21-\x39\x3b-\x7e]+:|[\x20\t]")
_LENGTH = re.compile(rb"\r\nContent-Length:\x20*([0-9]+)\r\n", re.IGNORECASE)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the response's HTTP head and no payload, whose size its header keeps."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url) if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)), ("X-Refers-To-Page-ID", refers_to),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + BLANK


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
          compress: bool = True, level: int = 6) -> DataFrame:
    """Write one record per row; the result lists the files: ``(file, bytes, records)``."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body"))
    # sizes and digests alone decide what is a revisit; the bodies stay out of these shuffles
    sums = rows.where(F.length("body") >= least_bytes).select(F.sha1("body").alias("sum"), "id")
    firsts = sums.groupBy("sum").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    # of repeated payloads, the ids that revisit: found by digest, joined back by id
    again = sums.join(firsts, "sum").where(F.col("id") != F.col("first")).select("id", "sum", "first").distinct()
    again = stored(again, "warc-revisits")
    marked = rows.withColumn("sum", F.sha1("body")).join(again, ["id", "sum"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = uri = None
        size = count = 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([count])], ["file", "bytes", "records"])

        for batch in batches:
            for page_id, link, body, first in zip(*(batch.column(c) for c in ("id", "url", "body", "first"))):
                data, first = body.as_py(), first.as_py()
                kind = "response" if first is None else "revisit"
                out = record(kind, page_id.as_py(), link.as_py(), data, base32_sha1(data), first)
                if compress:
                    member = zlib.compressobj(level, wbits=31)
                    out = member.compress(out) + member.flush()
                if stream is not None and size + len(out) > FILE_BYTES:
                    yield closed()
                    stream = None
                if stream is None:
                    stream, uri = write_once(folder, "archive", ".warc.gz" if compress else ".warc")
                    size = count = 0
                stream.write(out)
                size += len(out)
                count += 1
        if stream is not None:
            yield closed()

    listed = marked.select("id", "url", "body", "first").mapInArrow(run, "file string, bytes long, records long")
    return stored(listed, "warc-files")


class Window:
    """Bytes of a file from an offset on, read ahead as needed."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        end = min(offset + n, self.size)
        if offset < self.at or end > self.at + len(self.data):
            self.handle.seek(offset)
            self.at, self.data = offset, self.handle.read(max(end - offset, min(1 << 20, self.size - offset)))
        return self.data[offset - self.at : end - self.at]


def _head(window: Window, offset: int) -> bytes:
    """Bytes from ``offset`` to the blank line behind a header of any length, or less if no header goes on there."""
    n = HEADER_BYTES
    while True:
        head = window.get(offset, n)
        if BLANK in head or len(head) < n or not head.startswith(b"WARC/1."):
            return head
        # the last line may be cut
        if not all(_HEADER_LINE.match(line) for line in head.split(b"\r\n")[1:-1]):
            return head
        n *= 2


def successor(window: Window, offset: int) -> int | None:
    """Offset after the record or member that begins at ``offset``; None if none does."""
    if window.get(offset, len(GZIP) - 1) == GZIP[:3]:
        member, at = zlib.decompressobj(wbits=31), offset
        head = b""
        try:
            while not member.eof:
                chunk = window.get(at, 64 << 10)
                if not chunk:
                    return None
                part = member.decompress(chunk)
                head = head or part[: len(VERSION)]
                at += len(chunk)
        except zlib.error:
            return None
        return at - len(member.unused_data) if head.startswith(b"WARC/1.") else None
    head = _head(window, offset)
    end = head.find(BLANK)
    length = _LENGTH.search(head, 0, end + 2) if end >= 0 and head.startswith(b"WARC/1.") else None
    if length is None:
        return None
    after = offset + end + len(BLANK) + int(length[1])
    return after + len(BLANK) if window.get(after, len(BLANK)) == BLANK else None


def candidates(window: Window, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """``(offset, successor)`` of every magic that begins in [begin, end)."""
    for magic in (b"\r\n\r\nWARC/1.", GZIP[:3]):
        skip = 4 if magic[:1] == b"\r" else 0
        at = begin - skip
        if skip and at < 0:
            at = 0
            if window.get(0, 7) == b"WARC/1." and begin == 0 and (after := successor(window, 0)):
                yield 0, after
        while at < end:
            data = window.get(at, min(1 << 20, end - at) + len(magic) - 1)
            found = data.find(magic)
            while found >= 0:
                offset = at + found + skip
                if begin <= offset < end and (after := successor(window, offset)):
                    yield offset, after
                found = data.find(magic, found + 1)
            at += max(len(data) - len(magic) + 1, 1)


def _ranges(files: DataFrame) -> DataFrame:
    """``(file, bytes, begin, end)`` ranges of the files, dealt out evenly."""
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
    ranges = files.select("file", "bytes", F.explode(spans).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + RANGE_BYTES, F.col("bytes")))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "file", "begin")


def links(files: DataFrame) -> DataFrame:
    """Candidates of all files: ``(file, begin, offset, after)``; ``begin`` is that of the range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, begin, end in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "begin", "end"))):
                system, path = opened(uri)
                with system.open_input_file(path) as handle:
                    found = sorted(set(candidates(Window(handle, size), begin, end)))
                if found:
                    offset, after = zip(*found)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array([begin] * n), pa.array(offset), pa.array(after)], ["file", "begin", "offset", "after"])

    return _ranges(files).mapInArrow(run, "file string, begin long, offset long, after long")


def _exits(found: DataFrame) -> DataFrame:
    """For every candidate of a range, where its chain leaves the range: ``(file, offset, exit)``."""

    def run(table: pa.Table) -> pa.Table:
        begin = table.column("begin")[0].as_py()
        jump = dict(zip(table.column("offset").to_pylist(), table.column("after").to_pylist()))
        out: dict[int, int] = {}
        for offset in sorted(jump, reverse=True):  # successors lie behind, so they are done
            out[offset] = out.get(jump[offset], jump[offset])
        n = len(out)
        return pa.table({"file": pa.array([table.column("file")[0].as_py()] * n), "begin": pa.array([begin] * n, pa.int64()),
                         "offset": pa.array(list(out), pa.int64()), "exit": pa.array(list(out.values()), pa.int64())})

    return found.groupBy("file", "begin").applyInArrow(run, "file string, begin long, offset long, exit long")


def verified(found: DataFrame) -> DataFrame:
    """The candidates that a chain reaches from their file's start: ``(file, offset, after)``."""
    jumps = stored(_exits(found), "warc-exits").select("file", "offset", F.col("exit").alias("to"))
    # the entry of each range on the file's chain: from offset 0, doubling the reach each round
    reached = stored(jumps.where(F.col("offset") == 0).select("file", "offset"), "warc-reached")
    count = reached.count()
    while count:
        stepped = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        grown = stored(reached.union(stepped.join(jumps.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), "warc-reached")
        size = grown.count()
        if size == count:
            break
        reached, count = grown, size
        far = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("_far"))
        jumps = stored(
            jumps.join(far, ["file", "to"], "left").select("file", "offset", F.coalesce("_far", "to").alias("to")), "warc-jumps"
        )

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        jump = dict(zip(left.column("offset").to_pylist(), left.column("after").to_pylist()))
        file = left.column("file")[0].as_py() if left.num_rows else None
        rows: list[tuple[int, int]] = []
        for at in right.column("offset").to_pylist():
            while at in jump:
                rows.append((at, jump[at]))
                at = jump[at]
        rows = sorted(set(rows))
        return pa.table({"file": pa.array([file] * len(rows), pa.string()), "offset": pa.array([a for a, _ in rows], pa.int64()),
                         "after": pa.array([b for _, b in rows], pa.int64())})

    begin = (F.floor(F.col("offset") / RANGE_BYTES) * RANGE_BYTES).cast("long")
    entries = reached.withColumn("begin", begin)
    return found.groupBy("file", "begin").cogroup(entries.groupBy("file", "begin")).applyInArrow(follow, "file string, offset long, after long")


_FIELD = re.compile(rb"^([A-Za-z-]+):\x20*(.*)$")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record's bytes; the payload is what follows the HTTP head."""
    head, _, rest = data.partition(BLANK)
    fields = {m[1].decode().lower(): m[2].decode() for line in head.split(b"\r\n")[1:] if (m := _FIELD.match(line))}
    block = rest[: int(fields.get("content-length", 0))]
    return fields, block.partition(BLANK)[2]


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, offset long"


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All verified records of the files. A response's digest and size are taken from its payload as read."""
    found = stored(links(files), "warc-links")
    records = stored(verified(found), "warc-records")
    begin = (F.floor(F.col("offset") / RANGE_BYTES) * RANGE_BYTES).cast("long")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.withColumn("begin", begin).repartition(parts, "file", "begin").sortWithinPartitions("file", "offset")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = handle = None
        for batch in batches:
            rows = []
            for name, offset, after in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "after"))):
                if name != uri:
                    system, path = opened(name)
                    uri, handle = name, system.open_input_file(path)
                handle.seek(offset)
                data = handle.read(after - offset)
                fields, payload = parsed(zlib.decompress(data, wbits=31) if data.startswith(GZIP[:3]) else data)
                kind, number = fields.get("warc-type"), lambda k: int(fields[k]) if k in fields else None
                whole = kind == "response"
                digest = base32_sha1(payload) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                rows.append((number("x-page-id"), fields.get("warc-target-uri"), kind, len(payload) if whole else number("x-payload-length"),
                             digest, number("x-refers-to-page-id"), payload if with_payload and whole else None, name, offset))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return dealt.select("file", "offset", "after").mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [x.strip().split(" ")[0] for x in _RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of any folder that Spark reads, as ``read`` takes them; no content is loaded."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
