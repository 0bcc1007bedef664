"""Windows of tiles as numbers, two bits a base, and what is settled by equal ones without a row of text for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import WORD
from ..sources import dealt
from ..sources.references import Tiled, tiled
from ..sources.storage import forget
from .search import kmer_text

#: Codes of bases; others are 4.
CODES = np.full(128, 4, np.int64)
CODES[[ord(c) for c in "ACGT"]] = range(4)


def names(width: int) -> list[str]:
    """The words of a window."""
    return [f"w{i}" for i in range(-(-width // WORD))]


def text(width: int) -> Column:
    """The window that words say."""
    return F.concat(*[kmer_text(F.col(w), min(WORD, width - WORD * k)) for k, w in enumerate(names(width))])


def shown(refs: DataFrame | Tiled, width: int) -> Tiled:
    t = refs if isinstance(refs, Tiled) else tiled(refs, right=width - 1)
    if t.right < width - 1:
        raise ValueError(f"the tiles show {t.right} bases of what follows, a window has {width}")
    return t


def _words(codes: np.ndarray, width: int) -> list[np.ndarray]:
    """The words of the window from each position on."""
    n, out = len(codes) - width + 1, []
    for k in range(0, width, WORD):
        w = np.zeros(n, np.int64)
        for j in range(k, min(k + WORD, width)):
            w = w << 2 | codes[j : j + n]
        out.append(w)
    return out


def _whole(width: int, step: int):
    """Tiles to ref_id, the offsets of their own windows without N, and the codes of their bases; tiles without such windows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for ref, t0, bases in zip(*(b.column(c).to_pylist() for c in ("ref_id", "t0", "bases"))):
                n = min(step, len(bases) - width + 1)
                if n > 0:
                    codes = CODES[np.frombuffer(bases[: n + width - 1].encode(), np.uint8)]
                    ns = np.concatenate([[0], (codes > 3).cumsum()])
                    at = np.flatnonzero(ns[width:] == ns[:-width])
                    if len(at):
                        yield ref, t0 + at, at, codes & 3

    return run


def plain(width: int, step: int):
    """Words, ref_id and off of windows without N."""
    whole = _whole(width, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for ref, off, at, codes in whole(batches):
            yield [*(w[at] for w in _words(codes, width)), np.full(len(at), ref), off]

    return run


def on_both_strands(width: int, step: int):
    """Windows by the lesser of their two strands' words, with how often they count: twice if both are equal."""
    whole = _whole(width, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for ref, off, at, codes in whole(batches):
            fw = [w[at] for w in _words(codes, width)]
            rc = [w[::-1][at] for w in _words(3 - codes[::-1], width)]
            less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
            for a, b in zip(fw, rc):
                less |= same & (a < b)
                same &= a == b
            yield [*(np.where(less, a, b) for a, b in zip(fw, rc)), np.full(len(at), ref), off, same + 1 << 1 | 1]

    return run


def converted(width: int, step: int):
    """The forms, C read as T, of windows and of what they are on the other strand; only the former are asked for."""
    whole = _whole(width, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for ref, off, at, codes in whole(batches):
            other = 3 - codes[::-1]
            fw = _words(np.where(codes == 1, 3, codes), width)
            rc = _words(np.where(other == 1, 3, other), width)
            yield [*(w[at] for w in fw), np.full(len(at), ref), off, np.full(len(at), 3)]
            yield [*(w[::-1][at] for w in rc), np.full(len(at), ref), off, np.full(len(at), 2)]

    return run


def whole_counts(t: Tiled, width: int) -> DataFrame:
    """ref_id, t0, windows: how many windows without N begin in each tile that has any."""
    whole = _whole(width, t.step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ref, off, at, _ in whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array([ref]), pa.array([int(off[0] - at[0])]), pa.array([len(at)])], ["ref_id", "t0", "windows"])

    return t.tiles.filter("bases <> ''").select("ref_id", "t0", "bases").mapInArrow(run, "ref_id long, t0 long, windows long")


def starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def once(refs: DataFrame | Tiled, width: int, how) -> DataFrame:
    """ref_id, off of the windows asked for whose words `how` makes once, stored. They are dealt out by the words' hash."""
    t, n = shown(refs, width), len(names(width))

    def settle(part: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort(cols[:n])
        ref, off, flag = (c[order] for c in cols[n:])
        at = starts([c[order] for c in cols[:n]])
        alone = at[(np.add.reduceat(flag >> 1, at) == 1) & (flag[at] & 1 == 1)]
        by = alone[np.lexsort((off[alone], ref[alone]))]
        yield from dealt.batches_of([ref[by], off[by]], ["ref_id", "off"])

    tiles = t.tiles.filter("bases <> ''").select("ref_id", "t0", "bases")
    made = how(width, t.step)
    rows = (t.refs.agg(F.sum("len")).first()[0] or 0) * (2 if how is converted else 1)
    parts = max(1, -(-rows // dealt.PART))
    return dealt.settled(tiles, made, dealt.by_hash(n, parts), parts, settle, "ref_id long, off long", "once")


def covering(places: DataFrame, refs: DataFrame, width: int, tile: int) -> DataFrame:
    """Of places (ref_id, off; a stored() table, which goes) and references (ref_id, len): ref_id, t (from 0, `tile` bases each), len, marks: the offsets of the places in the tile and of those before it that reach into it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            if b.num_rows:
                ref, off = b.column("ref_id").to_numpy(), b.column("off").to_numpy()
                over = np.flatnonzero(off % tile >= tile - width + 1)
                yield [np.concatenate([ref, ref[over]]), np.concatenate([off // tile, off[over] // tile + 1]), np.concatenate([off, off[over]])]

    def settle(part: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort(cols[::-1])
        ref, t, off = (c[order] for c in cols)
        at = starts([ref, t])
        for k in range(0, len(at), 64):  # some tiles at once
            low, edges = int(at[k]), [*at[k : k + 65].tolist()]
            edges = edges if len(edges) == 65 else [*edges, len(off)]
            lists = pa.ListArray.from_arrays(pa.array([e - low for e in edges], pa.int32()), pa.array(off[low : edges[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ref[at[k : k + 64]]), pa.array(t[at[k : k + 64]]), lists], ["ref_id", "t", "marks"])

    parts = max(1, -(-places.count() // dealt.PART))
    marks = dealt.settled(places.select("ref_id", "off"), made, dealt.by_hash(2, parts), parts, settle, "ref_id long, t long, marks array<long>", "marks")
    forget(places)
    every = refs.filter(F.col("len") > 0).select(F.col("ref_id").cast("long").alias("ref_id"), F.col("len").cast("long").alias("len"))
    every = every.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / tile))))
    return every.join(marks, ["ref_id", "t"], "left")


def _bases(b: pa.RecordBatch, width: int, tile: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of covering(): ref_id, the tile's first base, whether a place is at each base, and how many of the last `width` bases have one."""
    for ref, t, size, marks in zip(*(b.column(c).to_pylist() for c in ("ref_id", "t", "len")), b.column("marks")):
        n = min(tile, size - t * tile)
        flags = np.zeros(n + width, np.int64)
        if marks.is_valid:
            flags[np.asarray(marks.values) - t * tile + width] = 1
        total = flags.cumsum()
        yield ref, t * tile, flags[width:], total[width:] - total[:n]


def by_base(tiles: DataFrame, width: int, tile: int) -> DataFrame:
    """covering() as ref_id, off, mapable, covering, a row for each base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ref, at, own, n in _bases(b, width, tile):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ref)), pa.array(at + np.arange(len(own))), pa.array(own == 1), pa.array(n)], ["ref_id", "off", "mapable", "covering"])

    return tiles.mapInArrow(run, "ref_id long, off long, mapable boolean, covering long")


def symbols(tiles: DataFrame, width: int, tile: int) -> DataFrame:
    """covering() as ref_id, t, symbols: the tile's bases as one text, the count of each as a character from 64 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["".join(map(chr, (n + 64).tolist())) for _, _, _, n in _bases(b, width, tile)]
            if texts:
                yield pa.RecordBatch.from_arrays([b.column("ref_id"), b.column("t"), pa.array(texts)], ["ref_id", "t", "symbols"])

    return tiles.mapInArrow(run, "ref_id long, t long, symbols string")
