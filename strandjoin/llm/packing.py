"""Token ids, packed by best-fit decreasing into fixed-length rows.

Every text is encoded whole and ends with the end-of-text id; sequences over `length` are split
into pieces of `length` and a rest, so that nothing is lost. Within a block of about block_tokens
tokens, pieces are placed by decreasing length in the fullest row that still has room; a segment
tree over the capacities finds it. A row holds its ids as little-endian int32, the cumulative
lengths of its segments and where positions restart, with the document and token offset of each.

A null or empty text is the end-of-text id alone; null ids and repeated rows are documents like any
other; texts of equal length keep their order. Further columns are ignored, whatever their names.
Empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: The pre-tokenisation pattern that the vocabulary was made for; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: PATTERN never joins what a word's end and the white space behind it part, so that the ids of both don't depend on each other.
PART = re.compile(rf"(?s:.{{1,65536}})[{WHITE}]*[^{WHITE}]*")


class TextIds:
    """Ids of texts. Each part is encoded whole: most time goes into ids of rare words, which remembering words wouldn't save."""

    def __init__(self, path: str):
        self.encode = encoder(path).encode_ordinary

    def of(self, text: str) -> np.ndarray:
        # as one list, a very long text's ids would take many times its size
        return np.frombuffer(b"".join(array("i", self.encode(part)).tobytes() for part in PART.findall(text)), "<i4")


class CapacityTree:
    """A segment tree over capacities 0..top: the least capacity of at least n that some row has."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, taken out; None if no row has room."""
        i = n + self.size
        while not self.count[i]:
            while i & 1:  # up from right children; past the root there is nothing
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """The pieces of each row, by index."""
    tree, rows = CapacityTree(length), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found:
            capacity, row = found
        else:
            capacity, row = length, len(rows)
            rows.append([])
        rows[row].append(k)
        if capacity > lengths[k]:
            tree.add(capacity - lengths[k], row)
    return rows


def pack(docs: DataFrame, length: int = 2048, block_tokens: int = 4_000_000, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack_id, ids (length int32), n_tokens (the rest is end ids), cu_seqlens, position_resets, doc_ids, doc_offsets.

    The vocabulary is a file that the driver sees, or any path that Spark reads; it is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextIds(SparkFiles.get(name)).of
        base, done = TaskContext.get().partitionId() << 32, 0

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal done
            places = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for a in range(0, len(places), 512):
                cols: list[list] = [[] for _ in range(7)]
                for row in places[a : a + 512]:
                    own = [pieces[k] for k in row]
                    cu = np.cumsum([0, *(len(p[2]) for p in own)], dtype=np.int32)
                    ids = np.full(length, end, "<i4")
                    ids[: cu[-1]] = np.concatenate([p[2] for p in own])
                    for c, v in zip(cols, (base + done, ids.tobytes(), int(cu[-1]), cu, cu[:-1], [p[0] for p in own], [p[1] for p in own]), strict=True):
                        c.append(v)
                    done += 1
                types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        pieces, held = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = np.append(encode(text.as_py()), np.int32(end))
                for at in range(0, len(ids), length):
                    pieces.append((doc, at, ids[at : at + length]))
                held += len(ids)
                if held >= block_tokens:
                    yield from rows(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from rows(pieces)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """The segments again: doc_id, offset, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, offsets, out = [], [], []
            for ids, cu, d, o in zip(*(b[c].to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "doc_offsets")), strict=True):
                row = np.frombuffer(ids, "<i4")
                docs += d
                offsets += o
                out += [row[x:y] for x, y in zip(cu, cu[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "offset", "ids"])

    return packed.mapInArrow(run, "doc_id long, offset long, ids array<int>")
