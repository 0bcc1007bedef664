"""WARC archives: one gzip member per record, written and read as tables of byte blocks.

Writing: of pages with equal payloads of at least min_revisit bytes, the one with the largest
page_id is a response and the others are revisits that refer to it. Reading is sequential: members
are decompressed incrementally, records are framed by Content-Length and digests are verified.

An archive is a partition's rows (archive, part, data); data holds whole members, so a block can be
read by itself and concatenated blocks are a valid .warc.gz file. Files are read line by line as they
are inflated. Null html is an empty payload, a null url or page_id is left out of the record; rows
that repeat a page are responses alike; a payload has to fit in a row. Further columns are ignored,
whatever their names. Empty tables give empty archives and results.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, few, materialise, null_safe
from .runs import key_runs

BLOCK = 4 << 20
FEED = 1 << 16
REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to, null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), as_bytes("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    light = rows.filter(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    key = lambda a: F.conv(F.substring("digest", a, 15), 16, 10).cast("long")  # noqa: E731  120 of the digest's bits
    runs = key_runs(materialise(light.select(key(1).alias("k1"), key(16).alias("k2"), "page_id", "digest"), "payloads"), ["page_id"], 2, "page_id", "payload_runs", descending=True)
    back = runs.filter("run_big AND NOT page_id <=> run_first").select("page_id", "digest", F.col("run_first").alias("refers_to")).dropDuplicates(["page_id", "digest"])
    return null_safe(rows, few(materialise(back, "revisits")), ["page_id", "digest"])


def _id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{page if page is not None else 'none-' + digest}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as a gzip member."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to, digest)}", f"WARC-Profile: {REVISIT}"]
    block_sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{block_sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame) -> DataFrame:
    """archive, part, data: a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{pid:06d}.warc.gz"]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["archive", "part", "data"])

        # a few rows at a time become Python objects
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    part, held, size = part + 1, [], 0
        if held:
            yield block()

    return materialise(records.mapInArrow(run, "archive string, part int, data binary"), "warc")


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    z, out = None, []
    for chunk in chunks:
        while chunk:
            if z is None:
                z, out = zlib.decompressobj(31), []
            out.append(z.decompress(chunk))
            chunk = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(out)
                z = None
    if z is not None:
        raise ValueError("the archive ends within a gzip member")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def parse(member: bytes) -> Iterator[tuple]:
    """The records of a member, framed by Content-Length; ValueError if a frame or digest is wrong."""
    at = 0
    while at < len(member):
        end = member.index(b"\r\n\r\n", at)
        f = _fields(member[at:end])
        n = int(f["content-length"])
        block = member[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) != n or member[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"{f.get('warc-record-id')}: wrong Content-Length")
        if f.get("warc-block-digest") and f["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError(f"{f.get('warc-record-id')}: wrong block digest")
        if f.get("warc-type") not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        said = f["warc-payload-digest"].removeprefix("sha1:")
        revisit = f["warc-type"] == "revisit"
        if not revisit and said != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"{f.get('warc-record-id')}: wrong payload digest")
        size = int(_fields(http).get("content-length", len(payload)))
        url = f.get("warc-target-uri")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield _page(f.get("warc-record-id")), url, f["warc-type"], _page(f.get("warc-refers-to")), size, base64.b32decode(said).hex(), None if revisit else payload


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def read_archives(blocks: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of a table with a column data of whole gzip members."""

    def rows(data: bytes) -> Iterator[tuple]:
        for m in members(data[i : i + FEED] for i in range(0, len(data), FEED)):
            yield from parse(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"]:
                out, size = [], 0
                for r in rows(data.as_py()):
                    out.append(r if with_payload else (*r[:-1], None))
                    size += len(r[-1] or b"") + 200
                    if size > BLOCK:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return blocks.select("data").mapInArrow(run, READ)


def records(lines: Iterable[bytes]) -> Iterator[bytes]:
    """The WARC records of a stream of lines (without their line feeds), one at a time, by Content-Length."""
    head: list[bytes] = []
    it = iter(lines)
    for line in it:
        if not head and not line.strip():
            continue
        head.append(line)
        if line.strip():
            continue
        top = b"\n".join(head) + b"\n"
        left, block = int(_fields(top[:-4])["content-length"]) + 4, []
        while left > 0:
            part = next(it, None)
            if part is None:
                raise ValueError("the archive ends within a record")
            block.append(part)
            left -= len(part) + 1
        yield top + b"\n".join(block) + b"\n"
        head = []
    if head:
        raise ValueError("the archive ends within a record")


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of .warc.gz files: a task for each file, which the codec inflates as a stream; no more than a record and a batch of lines is held."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, x.as_py()) for b in batches for f, x in zip(b["file"].to_pylist(), b["line"], strict=True))
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            out, size = [], 0
            for record_bytes in records(x for _, x in own):
                for r in parse(record_bytes):
                    out.append(r if with_payload else (*r[:-1], None))
                    size += len(r[-1] or b"") + 200
                if size > BLOCK:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return lines.mapInArrow(run, READ)
