"""Numbers that tasks make by the tile, dealt out over parts and settled there.

A shuffled row is a block of packed columns, some thousand numbers of a part, so that a window or a suffix takes
a fifth of the room that a row of its own would. A part is one task's, about PART rows; parts are ranges of unique keys, by
bounds from a sample, or shares of a hash. More than PASS rows are dealt in passes over the input, of which each
has some of the parts, so that no more than a pass's rows are between map and reduce at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Rows of a part, of a pass, and those that a task holds before it sends them.
PART, PASS, HELD = 1 << 20, 1 << 28, 1 << 20
#: Sampled keys for each part.
SAMPLED = 64

Columns = list[np.ndarray]
Make = Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]]
PartOf = Callable[[Columns], np.ndarray]


def packed(cols: Columns) -> bytes:
    """Columns of longs: each above its least value, as narrow as it can be, byte by byte, compressed."""
    head, body = [len(cols), len(cols[0])], []
    for x in cols:
        low = int(x.min())
        y = x - low
        width = next(k for k in (1, 2, 4, 8) if k == 8 or int(y.max()) < 1 << 8 * k)
        head += [low, width]
        body.append(y.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return np.array(head, np.int64).tobytes() + pa.Codec("zstd", 1).compress(b"".join(body), asbytes=True)


def unpacked(raw: bytes) -> Columns:
    k, n = np.frombuffer(raw, np.int64, 2).tolist()
    head = np.frombuffer(raw, np.int64, 2 * k, 16).tolist()
    body = np.frombuffer(pa.Codec("zstd").decompress(raw[16 + 16 * k :], n * sum(head[1::2]), asbytes=True), np.uint8)
    out, at = [], 0
    for low, width in zip(head[::2], head[1::2]):
        y = np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(f"<u{width}").reshape(n)
        out.append(y.astype(np.int64) + low)
        at += n * width
    return out


def by_hash(keys: int, parts: int) -> PartOf:
    """Shares of the first columns' hash."""

    def run(cols: Columns) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint64)
        for c in cols[:keys]:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)

    return run


def by_bounds(bounds: np.ndarray) -> PartOf:
    """Ranges of the first columns: a part's number is how many bounds (rows, sorted) aren't above the row."""

    def run(cols: Columns) -> np.ndarray:
        first = np.ascontiguousarray(bounds[:, 0])
        part, upto = np.searchsorted(first, cols[0], "left"), np.searchsorted(first, cols[0], "right")
        at = np.flatnonzero(part != upto)
        for j in np.unique(np.concatenate([np.arange(a, z) for a, z in set(zip(part[at].tolist(), upto[at].tolist()))])) if len(at) else []:
            mine = at[cols[0][at] == first[j]]
            above, same = np.zeros(len(mine), bool), np.ones(len(mine), bool)
            for k in range(1, bounds.shape[1]):
                x = cols[k][mine]
                above |= same & (x > bounds[j, k])
                same &= x == bounds[j, k]
            part[mine] += above | same
        return part

    return run


def ranges(d: DataFrame, make: Make, keys: int, rows: int) -> tuple[PartOf, int]:
    """Ranges of about PART of so many rows, by keys (the first columns) of a sample of d. A bounded number of keys for each part comes to the driver."""
    parts = max(1, -(-rows // PART))
    if parts == 1:
        return by_bounds(np.zeros((0, keys), np.int64)), 1
    want = SAMPLED * parts
    share = min(1.0, 256 * want / rows)
    step = max(1, int(rows * share / want))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for cols in make(batches):
            n = len(cols[0])
            mine = np.arange(-at % step, n, step)
            at += n
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array(c[mine]) for c in cols[:keys]], [f"k{i}" for i in range(keys)])

    picked = (d if share == 1.0 else d.sample(share, 1)).mapInArrow(pick, ", ".join(f"k{i} long" for i in range(keys))).toArrow()
    cols = [c.to_numpy() for c in picked.columns]
    if not cols[0].size:
        return by_bounds(np.zeros((0, keys), np.int64)), 1
    order = np.lexsort(cols[::-1])
    at = order[np.unique(np.arange(1, parts) * len(order) // parts)]
    return by_bounds(np.stack([c[at] for c in cols], axis=1)), len(at) + 1


def settled(d: DataFrame, make: Make, part_of: PartOf, parts: int, settle: Callable[[int, Columns], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """What settle() makes of each part's columns, written to the shared folder: make()'s rows, in no order, go to the part that part_of() gives.

    settle(part, columns) has a part whole, hence its order and its groups, and its rows are written as they come.
    """
    out, most = None, max(1, PASS // PART)
    for low in range(0, parts, most):
        high = min(low + most, parts)

        def sent(held: list[Columns], low: int = low) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            cols = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(cols[0], kind="stable")
            part = cols[0][order]
            cols = [c[order] for c in cols[1:]]
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for a, z in zip(edges, edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) - low], pa.int32()), pa.array([packed([c[a:z] for c in cols])], pa.binary())], ["part", "cols"])

        def deal(batches: Iterator[pa.RecordBatch], low: int = low, high: int = high, sent=sent) -> Iterator[pa.RecordBatch]:
            raw, n, held, kept = [], 0, [], 0

            def mine() -> None:
                nonlocal raw, n, kept
                cols = [np.concatenate(c) for c in zip(*raw)]
                part = part_of(cols)
                at = np.flatnonzero((part >= low) & (part < high))
                if len(at):
                    held.append([part[at], *(c[at] for c in cols)])
                kept, n, raw = kept + len(at), 0, []

            for cols in make(batches):
                raw.append(cols)
                n += len(cols[0])
                if n >= HELD // 4:
                    mine()
                    if kept >= HELD:
                        yield from sent(held)
                        held, kept = [], 0
            if raw:
                mine()
            yield from sent(held)

        def whole(batches: Iterator[pa.RecordBatch], low: int = low) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, list[bytes]] = {}
            for b in batches:
                for p, raw in zip(b.column("part").to_pylist(), b.column("cols").to_pylist()):
                    blocks.setdefault(p, []).append(raw)
            for p in sorted(blocks):
                cols = [np.concatenate(c) for c in zip(*map(unpacked, blocks.pop(p)))]
                yield from settle(low + p, cols)

        there = d.mapInArrow(deal, "part int, cols binary").repartitionById(high - low, F.col("part")).mapInArrow(whole, schema)
        out = stored(there, name, out)
    return out


def batches_of(cols: list, names: list[str], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of a bounded length."""
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)
    for k in range(0, whole.num_rows, most):
        yield whole.slice(k, most)
