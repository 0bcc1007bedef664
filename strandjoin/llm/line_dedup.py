"""Line dedup: hashes of lines are range-partitioned with a secondary sort by document and position
and streamed; the result is a compressed keep bitmap for each document, not its text.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys
under min_chars code points are never dropped. A document is a distinct pair (doc_id, text): null
text is one empty line, a null doc_id is an id like any other, rows that repeat a pair count once
and each get its result. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, materialise, null_safe
from .runs import key_runs

LINES = "doc_id long, text_hash long, k1 long, k2 long, first_pos int, positions array<int>"


def _hash_lines(min_chars: int):
    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for doc, th, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["raw"].to_pylist(), strict=True):
            at: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.split(b"\n")):
                at.setdefault(line.strip().lower(), []).append(i)
            for key, pos in at.items():
                if min_chars <= 1 and key or min_chars > 1 and len(key.decode("utf-8", "replace")) >= min_chars or min_chars <= 0:
                    h = xxhash.xxh3_128_digest(key)
                    out.append((doc, th, h[:8], h[8:], pos[0], pos))
        if not out:
            return None
        docs, ths, h1, h2, first, pos = zip(*out, strict=True)
        k = [pa.array(np.frombuffer(b"".join(h), "<i8")) for h in (h1, h2)]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), *k, pa.array(first, pa.int32()), pa.array(pos, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "k1", "k2", "first_pos", "positions"])

    return of


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _bitmap(b: pa.RecordBatch) -> pa.RecordBatch:
    n, dropped, maps = b["n_lines"].to_numpy(), b["dropped"].to_pylist(), []
    for k, gone in zip(n, dropped, strict=True):
        keep = np.ones(k, bool)
        if gone:
            keep[gone] = False
        maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
    return pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], b["n_lines"], pa.array([len(x or ()) for x in dropped], pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep_bitmap (zlib, one bit for each line, lowest first), a row for each distinct (doc_id, text).

    Lines whose key is in at least min_docs documents go from every document; with keep_first the
    first occurrence by (doc_id, position) stays.
    """
    keyed = _keyed(docs, id_col, text_col)
    lines = map_batches(keyed.select("doc_id", "text_hash", as_bytes("text").alias("raw")), _hash_lines(min_chars), LINES)
    lines = lines.withColumn("uid", F.xxhash64("doc_id", "text_hash"))
    hit = key_runs(materialise(lines, "lines"), ["doc_id", "first_pos", "text_hash"], min_docs, "uid" if keep_first else None, "line_runs", distinct=True).filter("run_big")
    if keep_first:
        hit = hit.withColumn("positions", F.when(F.col("uid") == F.col("run_first"), F.slice("positions", 2, F.greatest(F.size("positions") - 1, F.lit(0)))).otherwise(F.col("positions")))
    gone = hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("positions")).alias("dropped"))
    sizes = keyed.select("doc_id", "text_hash", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).dropDuplicates(["doc_id", "text_hash"])
    joined = null_safe(sizes, gone, ["doc_id", "text_hash"])
    return map_batches(joined, _bitmap, "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_lines(raw: bytes, bitmap: bytes) -> bytes:
    lines = raw.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_dropped and the kept text, or with digest its SHA-256 (the text then stays in the tasks)."""
    name, kind = ("kept_sha256", "string") if digest else ("text", "string")

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [x if not d else kept_lines(x, m) for x, m, d in zip(b["raw"].to_pylist(), b["keep_bitmap"].to_pylist(), b["n_dropped"].to_pylist(), strict=True)]
        got = [hashlib.sha256(x).hexdigest() for x in got] if digest else [x.decode() for x in got]
        return pa.RecordBatch.from_arrays([b["doc_id"], b["n_lines"], b["n_dropped"], pa.array(got, pa.string())], names=["doc_id", "n_lines", "n_dropped", name])

    keyed = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", as_bytes("text").alias("raw"))
    return map_batches(null_safe(keyed, bitmaps, ["doc_id", "text_hash"], "inner"), of, f"doc_id long, n_lines long, n_dropped long, {name} {kind}")
