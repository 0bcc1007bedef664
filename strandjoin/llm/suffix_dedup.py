"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier go.

Sharding is exact: every window of `length` bytes belongs to the minimizer (the least hash of its
`gram`-byte substrings), so that equal windows share a minimizer. Neighbouring windows with one
minimizer occurrence form a piece. Pieces of minimizers that occur once hold nothing repeated. Equal
pieces are aggregated to their first occurrence before any text moves, the later ones being covered
whole; where a minimizer's pieces differ, the suffixes of its distinct pieces are sorted by external
induction (see induced.py), and of each group of suffixes whose common prefix is at least `length`
all but the earliest mark their bytes. A minimizer with more than most_pieces distinct pieces, as a
common phrase with ever other neighbours makes, would be one task's work: its windows are dealt out
by their own hashes instead, which finds the same bytes.

Windows never cross documents. A document is a distinct pair (doc_id, text), documents are in order
of doc_id (null first) and then of the text's hash; rows that repeat a pair get the same result. Null
text is empty; very long texts are cut into pieces whole. Further columns are ignored, whatever their
names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, few, map_batches, materialise, null_safe, partitions, release, unique_ids
from .induced import sorted_suffixes
from .runs import key_runs

PIECES = "k1 long, k2 long, doc long, start int, runs int"
GROUP = 1 << 16


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of `gram` bytes (a power of two), by doubling."""
    h = x.astype(np.uint64) + np.uint64(1)
    k, base = 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while k < gram:
            h = h[:-k] * base + h[k:]
            base = base * base
            k *= 2
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes, where its least is (the first, of equals)."""
    val, at, k = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * k <= width:
        left = val[:-k] <= val[k:]
        val, at, k = np.where(left, val[:-k], val[k:]), np.where(left, at[:-k], at[k:]), 2 * k
    if d := width - k:
        left = val[:-d] <= val[d:]
        at = np.where(left, at[:-d], at[d:])
    return at


def pieces_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(text number, minimizer hash, start, window count) of the pieces, and the joined texts; no piece crosses texts."""
    joined = b"".join(texts)
    if len(joined) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), joined
    x = np.frombuffer(joined, np.uint8)
    h = gram_hashes(x, gram)
    at = least_at(h, length - gram + 1)
    ends = np.cumsum([len(t) for t in texts])
    # window s is good if it ends within its text
    room = np.repeat(ends, [len(t) for t in texts])[: len(at)] - np.arange(len(at)) >= length
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (room[1:] != room[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    good = room[start]
    start, count = start[good], count[good]
    own = np.searchsorted(ends, start, "right")
    # pieces of neighbouring texts never join: the last windows of a text have no room
    return own, h[at[start]], start, count, joined


def _cut(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(docs: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            own, h, start, count, joined = pieces_of(texts, length, gram)
            if len(start):
                ends = (start + count + (length - 1)).tolist()
                inside = np.frombuffer(b"".join(xxhash.xxh3_64_digest(joined[a:b]) for a, b in zip(start.tolist(), ends, strict=True)), "<i8")
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(inside), pa.array(np.asarray(docs, np.int64)[own]), pa.array((start - first[own]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["k1", "k2", "doc", "start", "runs"])

        docs, texts, held = [], [], 0
        for b in batches:
            for doc, raw in zip(b["doc"].to_pylist(), b["raw"], strict=True):
                raw = raw.as_py()
                if len(raw) >= length:
                    docs.append(doc)
                    texts.append(raw)
                    held += len(raw)
                if held >= GROUP:
                    yield from give(docs, texts)
                    docs, texts, held = [], [], 0
        if texts:
            yield from give(docs, texts)

    return run


def repeated_windows(pieces: list[bytes], length: int, memory: int) -> Iterator[tuple[int, np.ndarray]]:
    """(piece, its windows that also start in an earlier piece); pieces are in order and no piece holds a window twice."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int32) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[begin + sizes] = 1
    base, parts = 0, []
    for pos, lcp in sorted_suffixes(text, length, memory):
        group = base + np.cumsum(lcp < length)
        base = int(group[-1])
        own = np.searchsorted(begin, pos, "right") - 1
        window = begin[own] + sizes[own] - pos >= length
        parts.append((group[window], pos[window]))
    if not parts:
        return
    group, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    # of each group the least position is the earliest window, as pieces are in order
    order = np.lexsort((pos, group))
    group, pos = group[order], pos[order]
    later = np.sort(pos[1:][group[1:] == group[:-1]])
    own = np.searchsorted(begin, later, "right") - 1
    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
    for w in np.split(later, cuts) if len(later) else []:
        k = int(np.searchsorted(begin, w[0], "right") - 1)
        yield k, w - begin[k]


def spans(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that windows with these (sorted) starts cover, as [from, to)."""
    cut = np.flatnonzero(np.diff(windows) > length)
    return list(zip(windows[np.append(0, cut + 1)].tolist(), (windows[np.append(cut, len(windows) - 1)] + length).tolist(), strict=True))


def _sort_shard(length: int, memory: int, most: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard comes sorted by minimizer; whole minimizers are taken together up to about `most` bytes."""

        def give(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: r[1:3])
            docs, a, b = [], [], []
            for k, w in repeated_windows([r[3] for r in rows], length, memory):
                for x, y in spans(w, length):
                    docs.append(rows[k][1])
                    a.append(rows[k][2] + x)
                    b.append(rows[k][2] + y)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc", "a", "b"])

        rows, held = [], 0
        for b in batches:
            for r in zip(b["k1"].to_pylist(), b["doc"].to_pylist(), b["start"].to_pylist(), b["piece"].to_pylist(), strict=True):
                if held >= most and r[0] != rows[-1][0]:
                    yield from give(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
        if rows:
            yield from give(rows)

    return run


def _fetch(length: int):
    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        k1, docs, starts, out = [], [], [], []
        for doc, raw, want in zip(b["doc"].to_pylist(), b["raw"].to_pylist(), b["want"].to_pylist(), strict=True):
            for w in want:
                k1.append(w["k1"])
                docs.append(doc)
                starts.append(w["start"])
                out.append(raw[w["start"] : w["start"] + w["runs"] + length - 1])
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(out, pa.binary())], names=["k1", "doc", "start", "piece"])

    return of


def _window_rows(length: int):
    """A row for each window of each piece, by its hash."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, starts, keys = [], [], []
        for doc, start, piece in zip(b["doc"].to_pylist(), b["start"].to_pylist(), b["piece"].to_pylist(), strict=True):
            n = len(piece) - length + 1
            docs.append(np.full(n, doc))
            starts.append(np.arange(start, start + n, dtype=np.int32))
            keys += [xxhash.xxh3_128_digest(piece[k : k + length]) for k in range(n)]
        if not keys:
            return None
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts))], names=["k1", "k2", "doc", "start"])

    return of


def removed_spans(docs: DataFrame, length: int = 100, gram: int = 32, memory: int = 64 << 20, most_pieces: int = 20_000) -> DataFrame:
    """doc, spans (sorted, disjoint [a, b) of bytes) of the documents that lose bytes. docs: doc (long, unique, in order), raw."""
    spark = docs.sparkSession
    cut = docs.select("doc", "raw").mapInArrow(_cut(length, gram), PIECES)
    pieces = materialise(cut.withColumn("inside", F.col("k2")).withColumn("k2", F.lit(0).cast("long")), "pieces")
    often = key_runs(pieces, ["inside", "doc", "start"], 2, name="often", only_big=True)
    release(pieces)
    placed = often.select("k1", F.col("inside").alias("k2"), "doc", "start", "runs").withColumn("at", F.struct("doc", "start"))
    known = key_runs(placed, ["doc", "start"], 2, "at", "known")
    release(often)
    later = known.filter("run_first <> at").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("runs") + length - 1).alias("b"))
    distinct = known.filter("run_first = at").select("k1", F.lit(0).cast("long").alias("k2"), "doc", "start", "runs")
    differ = key_runs(distinct, ["doc", "start"], 2, name="differ", only_big=True)
    hot = materialise(differ.groupBy("k1").agg(F.count("*").alias("n")).filter(F.col("n") > most_pieces).select("k1"), "hot_minimizers")
    any_hot = not hot.isEmpty()
    want = differ.groupBy("doc").agg(F.collect_list(F.struct("k1", "start", "runs")).alias("want"))
    texts = map_batches(docs.select("doc", "raw").join(want, "doc"), _fetch(length), "k1 long, doc long, start int, piece binary")
    if any_hot:
        texts = materialise(texts, "piece_texts")
    cool = texts.join(few(hot), "k1", "left_anti") if any_hot else texts
    shards = cool.repartition(partitions(spark), "k1").sortWithinPartitions("k1", "doc", "start")
    both = later.unionByName(shards.mapInArrow(_sort_shard(length, memory), "doc long, a int, b int"))
    if any_hot:
        windows = map_batches(texts.join(few(hot), "k1", "left_semi").select("doc", "start", "piece"), _window_rows(length), "k1 long, k2 long, doc long, start int")
        seen = key_runs(windows.withColumn("at", F.struct("doc", "start")), ["doc", "start"], 2, "at", "hot_windows", only_big=True)
        again = seen.filter("run_first <> at").select("doc", "start")
        # neighbouring windows are one span
        order = Window.partitionBy("doc").orderBy("start")
        again = again.withColumn("new", (F.col("start") - F.lag("start").over(order) > length).cast("int")).withColumn("g", F.sum(F.coalesce("new", F.lit(0))).over(order))
        both = both.unionByName(again.groupBy("doc", "g").agg(F.min("start").alias("a"), (F.max("start") + length).cast("int").alias("b")).select("doc", "a", "b"))
    return both.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))


def _apply(b: pa.RecordBatch) -> pa.RecordBatch:
    n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
    for raw, marks in zip(b["raw"].to_pylist(), b["s"].to_pylist(), strict=True):
        at, gone, runs, parts, end = 0, 0, 0, [], -1
        for m in marks or ():
            if m["a"] > end:  # touching spans are one run
                runs += 1
                end = m["a"]
            if m["a"] > at:
                parts.append(raw[at : m["a"]])
                at = m["a"]
            if m["b"] > at:
                gone += m["b"] - at
                at = m["b"]
            end = max(end, m["b"])
        parts.append(raw[at:])
        rest = b"".join(parts)
        n_bytes.append(len(raw))
        n_removed.append(gone)
        n_spans.append(runs)
        sha.append(hashlib.sha256(rest).hexdigest())
    longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
    return pa.RecordBatch.from_arrays([b["doc_id"], *longs, pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 32, memory: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), as_bytes(text).alias("raw"))
    unique = unique_ids(docs, id_col)
    if unique:
        own = keyed.select("doc_id", F.col("doc_id").alias("doc"), "raw")
    else:  # places in order of (doc_id, text) stand in for the ids
        order = keyed.select("doc_id", "text_hash").distinct()
        order = order.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
        order = materialise(order.withColumn("doc", F.monotonically_increasing_id()), "order")
        own = null_safe(keyed, order, ["doc_id", "text_hash"]).select("doc_id", "doc", "raw")
    marks = removed_spans(own if unique else own.dropDuplicates(["doc"]), length, gram, memory, most_pieces)
    return map_batches(own.join(marks, "doc", "left"), _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
