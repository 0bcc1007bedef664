"""Equal windows of the references as classes: reads are compared with a window's text once, however often it occurs.

build() sorts all windows of one width by text and place over the cluster. A class is a text, how often it
occurs (n) and the number of its first place; its places have the numbers from there on. Reads are joined
with classes by keys of one to three blocks (a lossless family of spaced seeds, wider the more classes there
are), so a placement is counted, not made, and limits (-m, -M, -k, --strata) are decided by sums of n. Only what is reported becomes rows: the numbers of its places, joined with the places one to
one, so a repeat that is a third of the reference is no task's group. For few reads that are known, classes are made of the
windows alone that a key of theirs finds.

A table of classes serves reads of its width. Windows with N are in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import WORD, reverse_complement, word_at
from ..options import AlignOptions
from ..sources import dealt
from ..sources.references import Tiled, tiled
from ..sources.storage import ranked, stored, with_offsets
from . import search, windows
from .policy import READ, order
from .search import READ_KEY, close_enough, judged, oriented

#: Bytes of keys up to which they are broadcast.
BROADCAST = 64 << 20
#: Bases that near_counts leaves out at a time; so many make at most 4 ** BLOCK texts a group.
BLOCK = 6
#: Letters by their codes.
BASES = "ACGTN"


@dataclass
class Classes:
    """table: window, n, first (place); places: place, ref_id, off, in the order of window, ref_id and off."""

    width: int
    table: DataFrame
    places: DataFrame


def tile_windows(refs: DataFrame | Tiled, width: int) -> DataFrame:
    """ref_id, off, window: every window, those with N too, cut from tiles."""
    t = refs if isinstance(refs, Tiled) else tiled(refs, right=width - 1)
    if t.right < width - 1:
        raise ValueError(f"the tiles show {t.right} bases of what follows, a window has {width}")
    inner = 64
    d = t.tiles.filter("bases <> ''").withColumn("s", F.explode(F.sequence(F.lit(0), F.least(F.length("bases"), F.lit(t.step)) - 1, F.lit(inner))))
    own = F.least(F.lit(inner), F.lit(t.step) - F.col("s"))
    d = d.select("ref_id", (F.col("t0") + F.col("s")).alias("t1"), own.alias("own"), F.substring("bases", F.col("s") + 1, F.lit(inner + width - 1)).alias("part"))
    high = F.least(F.col("own"), F.length("part") - width + 1) - 1
    d = d.filter(high >= 0).withColumn("j", F.explode(F.sequence(F.lit(0), high)))
    return d.select("ref_id", (F.col("t1") + F.col("j")).alias("off"), F.substring("part", F.col("j") + 1, F.lit(width)).alias("window"))


def met(reads: DataFrame, refs: DataFrame | Tiled, width: int, opts: AlignOptions) -> DataFrame | None:
    """ref_id, off, window of the windows without N that a key of a read finds, among which is every placement; None where keys are too many for a walk over the tiles."""
    found = search.candidates(reads, refs, opts)
    if found is None:
        return tile_windows(refs, width).filter(F.lit(False))
    cands, _, longest = found
    chunks = -(-longest // WORD)
    if "words" not in cands.columns:
        return None
    d = cands.filter(F.col("len") == width).withColumn("at", F.col("off") - F.col("t0"))
    whole = F.lit(True)
    for k in range(chunks):
        inside = F.coalesce(F.get("p_inside", F.lit(k)), F.lit(0).cast("long"))
        whole = whole & (word_at(F.col("ns"), F.col("at") + WORD * k, int("01" * WORD, 2)).bitwiseAND(inside) == 0)
    text = F.concat(*[search.kmer_text(word_at(F.col("words"), F.col("at") + WORD * k, 0), WORD) for k in range(chunks)])
    d = d.select("*", F.explode(F.array(whole)).alias("whole")).filter("whole")  # exploded, or it would be a condition of the join
    return d.select("ref_id", "off", F.substring(text, 1, width).alias("window")).distinct()


def build(refs: DataFrame | Tiled, width: int, reads: DataFrame | None = None, opts: AlignOptions | None = None) -> Classes:
    """The classes of a width, written to the shared folder: of all windows, or of those that keys of few reads find, which are all that these reads can be placed in under opts."""
    some = None if reads is None else met(reads, refs, width, opts)
    if some is None:
        return _of_all(refs, width)
    placed = ranked(some, ["window", "ref_id", "off"], "place")
    table = stored(placed.groupBy("window").agg(F.count("*").alias("n"), F.min("place").alias("first")), "classes")
    return Classes(width, table, placed.select("place", "ref_id", "off"))


def _of_all(refs: DataFrame | Tiled, width: int) -> Classes:
    """Classes of all windows, which are dealt out over ranges of their words and places. A range numbers its own; a class that lies in several is added up from its ends."""
    t, words = windows.shown(refs, width), windows.names(width)

    def settle(part: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        at = windows.starts(cols[: len(words)])
        n = np.diff(np.r_[at, len(order)])
        new = np.ones(len(order), bool)
        new[at] = False  # where a value is null
        of_class = lambda x, kind=pa.int64(): pa.array(np.where(new, 0, x), kind, mask=new)
        size, ends = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        size[at], ends[at[[0, -1]]] = n, True
        kept = [*map(of_class, cols[: len(words)]), *cols[len(words) :], of_class(size), pa.array(ends), (part << 33) + np.arange(len(order))]
        yield from dealt.batches_of(kept, [*words, "ref_id", "off", "n", "ends", "__id"])

    tiles = t.tiles.filter("bases <> ''").select("ref_id", "t0", "bases")
    made = windows.plain(width, t.step)
    part_of, parts = dealt.ranges(tiles, made, len(words) + 2, t.refs.agg(F.sum("len")).first()[0] or 0)
    kinds = f"{', '.join(f'{w} long' for w in words)}, ref_id long, off long, n long, ends boolean, __id long"
    d = with_offsets(dealt.settled(tiles, made, part_of, parts, settle, kinds, "classes"), "place")
    heads = d.filter("n IS NOT NULL").select(*words, "n", F.col("place").alias("first"), "ends")
    cut = heads.filter("ends").groupBy(*words).agg(F.sum("n").alias("n"), F.min("first").alias("first"))  # two rows a range
    table = heads.filter("NOT ends").drop("ends").unionByName(cut).select(windows.text(width).alias("window"), "n", "first")
    return Classes(width, table, d.select("place", "ref_id", "off"))


def family(seed: int, budget: int, texts: int, most: float = 1.0) -> tuple[int, int]:
    """Blocks that a seed part is cut into, and how many of them a key has: of budget + r blocks r are equal in any placement, and every r of them are a key.

    The fewest are taken (r from 1 on) with which a read meets at most `most` of so many texts by chance, so that candidates
    a read don't grow with the reference; if none does, those that meet the fewest.
    """
    options = []
    for exact in (1, 2, 3):
        blocks = budget + exact
        if seed >= blocks:
            options.append((comb(blocks, exact) * texts / 4.0 ** (seed // blocks * exact), exact, blocks))
    chance, exact, blocks = next((o for o in options if o[0] <= most), min(options))
    return blocks, exact


def candidates(reads: DataFrame, c: Classes, opts: AlignOptions, max_bytes: int = BROADCAST, exact: int | None = None) -> tuple[DataFrame, Column]:
    """Classes where a key of a read is found, a row for each key that finds one, and whether a row, of which `at` says where read and window differ, has the first such key. exact: blocks a key has, if not family()'s.

    Keys are broadcast while their counted bytes are at most max_bytes; beyond that keys and classes are shuffled by key.
    """
    probes = oriented(reads, opts)
    facts = probes.agg(F.count("*").alias("n"), F.min("len").alias("low"), F.max("len").alias("high")).first()
    if facts["n"] and (facts["low"], facts["high"]) != (c.width, c.width):
        raise ValueError(f"the classes are for reads of {c.width} bases, the reads have {facts['low']} to {facts['high']}")
    seed = c.width if opts.mode == "v" else min(opts.seed_len, c.width)
    blocks, exact = (opts.budget + exact, exact) if exact else family(seed, opts.budget, c.table.count())
    size, keys = seed // blocks, list(combinations(range(blocks), exact))

    def each(text: str, begin: Column) -> Column:
        part = lambda b: F.substring(text, begin + b * size + 1, F.lit(size))
        return F.array(*[F.struct(begin.cast("int").alias("begin"), F.lit(i).alias("key"), F.concat(*map(part, key)).alias("text")) for i, key in enumerate(keys)])

    own = probes.select(*READ_KEY, "fw", "probe", "len", "seed_at", "seed_n", F.inline(each("probe", F.col("seed_at")))).filter(~F.contains("text", F.lit("N")))
    begins = [F.lit(at) for at in sorted({0, c.width - seed})]
    there = c.table.select("window", "n", "first", F.inline(F.concat(*[each("window", at) for at in begins])))
    few = facts["n"] * len(keys) * (c.width + exact * size + 80) <= max_bytes
    d = there.join(F.broadcast(own) if few else own, ["begin", "key", "text"])
    # the first key is that of the first equal blocks: no others lie before its last one
    last = F.element_at(F.array(*[F.lit(key[-1]) for key in keys]), F.col("key") + 1)
    wrong = F.array_distinct(F.transform("at", lambda i: F.floor((i - F.col("seed_at")) / size).cast("int")))
    return d, F.size(F.filter(wrong, lambda b: (b >= 0) & (b < last))) == last + 1 - exact


def found(reads: DataFrame, c: Classes, opts: AlignOptions, max_bytes: int = BROADCAST, exact: int | None = None) -> DataFrame:
    """The classes that reads can be placed in: read_id, mate, name, fw, seq, qual, len, stratum, penalty, cost, mms, window, n, first, trimmed5, trimmed3."""
    cands, once = candidates(reads, c, opts, max_bytes, exact)
    rest = oriented(reads, opts).select(*READ_KEY, "fw", "name", "pqual", "trimmed5", "trimmed3")
    d = judged(cands.filter(close_enough(F.col("window"), opts)).join(rest, [*READ_KEY, "fw"]), opts, once)
    return d.select(*READ_KEY, "name", "fw", "seq", "qual", "len", "stratum", "penalty", "cost", "mms", "window", "n", "first", "trimmed5", "trimmed3")


def _best(hits: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return hits.withColumn("__least", F.min("stratum").over(Window.partitionBy(*key))).filter(F.col("stratum") == F.col("__least")).drop("__least")


def chosen(hits: DataFrame, opts: AlignOptions, key: tuple[str, ...] = READ) -> DataFrame:
    """found() classes that something is reported of, with oms, n_hits, sampled, begin (the first place reported) and takes (how many from there on are enough).

    With -k of a class as many places are taken as better classes leave; the ranking of equals is expanded()'s. Over -M a
    class of the best stratum is drawn by its n and one of its places.
    """
    everything = Window.partitionBy(*key)
    total = F.sum("n").over(everything)
    d = hits.withColumn("oms", F.col("n") - 1)
    if opts.strata:
        d = _best(hits, key).withColumn("oms", total - 1)
    most = opts.m if opts.m is not None else opts.sample_m
    d = d.withColumn("n_hits", F.lit(None).cast("long") if most is None else total)
    if opts.m is not None:
        d = d.filter(F.col("n_hits") <= opts.m)
    over = F.lit(False) if opts.sample_m is None else F.col("n_hits") > opts.sample_m
    d = d.withColumns({"sampled": over, "begin": F.col("first"), "takes": F.col("n")})
    if opts.limit is not None:
        better = F.coalesce(F.sum("n").over(everything.orderBy("cost").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        d = d.withColumn("__left", F.lit(opts.limit) - better).withColumn("takes", F.when(F.col("sampled"), F.col("n")).otherwise(F.least("n", "__left"))).filter("takes > 0").drop("__left")
    if opts.sample_m is not None:
        share = (F.pmod(F.xxhash64(F.lit(opts.seed), *key, "window", "fw"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        lot = -F.ln(share) / F.col("n")  # the least of these is a class with odds n
        d = d.withColumn("__lot", F.row_number().over(everything.orderBy("stratum", lot, "window", "fw"))).filter("NOT sampled OR __lot = 1").drop("__lot")
        one = F.col("first") + F.pmod(F.xxhash64(F.lit(opts.seed + 1), *key), F.col("n"))
        sampled = F.col("sampled")
        d = d.withColumns({"begin": F.when(sampled, one).otherwise(F.col("begin")), "takes": F.when(sampled, F.lit(1)).otherwise(F.col("takes")), "oms": F.when(sampled, F.lit(opts.sample_m)).otherwise(F.col("oms")).cast("long")})
    return d


def expanded(picked: DataFrame, c: Classes, opts: AlignOptions, key: tuple[str, ...] = READ) -> DataFrame:
    """chosen() classes as placements, with what policy.report() has: ref_id, off, rank, mapq and the rest."""
    d = picked.withColumn("place", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("takes") - 1))).drop("begin", "takes", "first", "n")
    d = d.join(c.places, "place").drop("place")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order())))
    if opts.limit is not None:
        d = d.filter(F.col("sampled") | (F.col("rank") <= opts.limit))
    return d.withColumn("mapq", F.when(F.col("sampled"), F.lit(0)).otherwise(F.lit(255)))


def status(reads: DataFrame, hits: DataFrame, opts: AlignOptions, key: str = "read_id") -> DataFrame:
    """policy.status() from found() classes: key, status."""
    d = _best(hits, (key,)) if opts.strata else hits
    most = opts.m if opts.m is not None else opts.sample_m
    n = d.groupBy(key).agg(F.sum("n").alias("n"))
    what = F.when(F.col("n").isNull(), F.lit("unaligned"))
    if most is not None:
        what = what.when(F.col("n") > most, F.lit("maxed"))
    return reads.select(key).distinct().join(n, key, "left").select(key, what.otherwise(F.lit("aligned")).alias("status"))


def _with_n(refs: DataFrame | Tiled, width: int, most: int) -> DataFrame:
    """Places of windows with 1 to `most` N."""
    ns = F.length("window") - F.length(F.replace("window", F.lit("N"), F.lit("")))
    return tile_windows(refs, width).filter(ns.between(1, most))


def _left_out(width: int) -> list[tuple[int, int]]:
    """The blocks that near_counts leaves out, as begin and end. With an even width those of the first half are enough: the others are theirs on the other strand."""
    upto = width if width % 2 else width // 2
    return [(at, min(at + BLOCK, upto)) for at in range(0, upto, BLOCK)]


def _rest_names(width: int) -> list[str]:
    return [f"r{i}" for i in range(-(-(width - 1) // WORD))]


def _without_blocks(width: int):
    """Windows to a row for each block outside which they have no N: part, the block's number and the block in three bits a base, and the rest in words of two bits a base."""
    names, codes = _rest_names(width), np.zeros(128, np.int64)
    codes[[ord(c) for c in BASES]] = range(len(BASES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = np.ascontiguousarray(codes[np.frombuffer("".join(b.column("window").to_pylist()).encode(), np.uint8)].reshape(-1, width).T)
            for q, (at, end) in enumerate(_left_out(width)):
                rest = np.concatenate([text[:at], text[end:]])
                ok = np.flatnonzero((rest < 4).all(axis=0))
                words = [np.zeros(len(ok), np.int64) for _ in names]
                for k, d in enumerate(rest[:, ok]):
                    words[k // WORD] = words[k // WORD] << 2 | d
                block = np.zeros(len(ok), np.int64)
                for d in text[at:end, ok]:
                    block = block << 3 | d
                part = np.full(len(ok), q) << 3 * BLOCK | block
                yield pa.RecordBatch.from_arrays([*map(pa.array, words), pa.array(part, pa.int32()), b.column("m").take(pa.array(ok))], [*names, "part", "m"])

    return run


def _with_blocks(width: int):
    """Rows of _without_blocks(), which have others for m, to their windows."""
    names, letters = _rest_names(width), np.frombuffer(BASES.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, part = [b.column(c).to_numpy() for c in names], b.column("part").to_numpy()
            for q, (at, end) in enumerate(_left_out(width)):
                mine = np.flatnonzero(part >> 3 * BLOCK == q)
                text = np.empty((width, len(mine)), np.int64)
                for i in range(at, end):
                    text[i] = part[mine] >> 3 * (end - 1 - i) & 7
                n = width - (end - at)
                for k in range(n):
                    later = min(n - k // WORD * WORD, WORD) - 1 - k % WORD
                    text[k if k < at else k + end - at] = words[k // WORD][mine] >> 2 * later & 3
                offsets = np.arange(len(mine) + 1, dtype=np.int32) * width
                whole = pa.StringArray.from_buffers(len(mine), pa.py_buffer(offsets), pa.py_buffer(letters[text.T].tobytes()))
                yield pa.RecordBatch.from_arrays([whole, b.column("others").take(pa.array(mine))], ["window", "others"])

    return run


def _near(width: int):
    """Of a share of _without_blocks()'s rows those that have partners, with others: how often the texts occur that differ in one base of the block."""
    rest, lengths = _rest_names(width), np.array([end - at for at, end in _left_out(width)])

    def settle(_: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, part, m = cols[: len(rest) + 1], cols[-2], cols[-1]
        order = np.lexsort(keys)
        at = windows.starts([k[order] for k in keys])
        sizes = np.diff(np.r_[at, len(order)])
        alike = np.repeat(sizes > 1, sizes)  # a text that is alone without a block has no partner there
        rows, group = order[alike], np.repeat(np.arange(len(at)), sizes)[alike]
        block, most, own = part[rows] & (1 << 3 * BLOCK) - 1, lengths[part[rows] >> 3 * BLOCK], m[rows]
        others = np.zeros(len(rows), np.int64)
        for i in range(BLOCK):
            low = 3 * i
            without = block >> low + 3 << low | block & (1 << low) - 1
            mine = np.flatnonzero((i < most) & (without & int("4" * BLOCK, 8) == 0))
            if len(mine):
                key = group[mine] << 3 * BLOCK | without[mine]
                by = np.argsort(key, kind="stable")
                first = windows.starts([key[by]])
                total = np.add.reduceat(own[mine][by], first)
                others[mine[by]] += np.repeat(total, np.diff(np.r_[first, len(by)])) - own[mine][by]
        found = np.flatnonzero(others)
        yield from dealt.batches_of([*(k[rows][found] for k in keys[: len(rest)]), pa.array(part[rows][found], pa.int32()), others[found]], [*rest, "part", "others"])

    return settle


def near_counts(refs: DataFrame | Tiled, c: Classes) -> DataFrame:
    """window, hits: in how many places, on both strands, a window is found with at most one mismatch; for all windows with at most one N, and what they are on the other strand.

    Texts one base apart are equal without the base (a deletion key), so partners are added up by key and never paired.
    Blocks come first: a text that is alone without a block of six bases has no partner there, and needs no keys in it. Rows
    of a block are a few longs, dealt out by what is left without it, of which a text is made again where it has partners; two
    texts that differ in the second half differ in the first one on the other strand, so such blocks have no rows.
    """
    width, rest = c.width, _rest_names(c.width)
    other = lambda d, n: d.select(reverse_complement("window").alias("window"), n)
    own = c.table.select("window", "n").unionByName(_with_n(refs, width, 1).select("window", F.lit(0).cast("long").alias("n")))
    both = stored(own.unionByName(other(own, "n")).groupBy("window").agg(F.sum("n").alias("m")), "strands")
    without = _without_blocks(width)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in without(batches):
            cols = {x: b.column(x).to_numpy().astype(np.int64) for x in b.schema.names}
            yield [*(cols[r] for r in rest), cols["part"] >> 3 * BLOCK, cols["part"], cols["m"]]

    parts = max(1, -(-both.count() * len(_left_out(width)) // dealt.PART))
    words = ", ".join(f"{r} long" for r in rest)
    near = dealt.settled(both, made, dealt.by_hash(len(rest) + 1, parts), parts, _near(width), f"{words}, part int, others long", "near")
    near = near.mapInArrow(_with_blocks(width), "window string, others long")
    if width % 2 == 0:
        near = near.unionByName(other(near, "others"))
    near = near.groupBy("window").agg(F.sum("others").alias("others"))
    return both.join(near, "window", "left").select("window", (F.col("m") + F.coalesce("others", F.lit(0).cast("long"))).alias("hits"))


def counts(refs: DataFrame | Tiled, c: Classes, opts: AlignOptions) -> DataFrame:
    """window, hits: in how many places align() would put a window of the references as a read of best quality; windows with more N than the budget aren't there. Each text is searched once and its hits are sums."""
    if (opts.mode, opts.budget, opts.forward, opts.reverse) == ("v", 1, True, True):
        return near_counts(refs, c)
    most = c.width if opts.mode == "n" else opts.budget
    texts = c.table.select("window", F.col("first").alias("read_id"))
    if most:
        broken = ranked(_with_n(refs, c.width, most).select("window").distinct(), ["window"], "i")
        texts = texts.unionByName(broken.select("window", (-1 - F.col("i")).alias("read_id")))
    zero = F.lit(0)
    reads = texts.select("read_id", zero.alias("mate"), F.lit("").alias("name"), F.col("window").alias("seq"), F.repeat(F.lit("I"), F.lit(c.width)).alias("qual"), F.lit("").alias("raw"), zero.alias("trimmed5"), zero.alias("trimmed3"))
    n = found(reads, c, opts).groupBy("read_id").agg(F.sum("n").alias("hits"))
    return texts.join(n, "read_id", "left").select("window", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def mapable(refs: DataFrame | Tiled, c: Classes, opts: AlignOptions) -> DataFrame:
    """ref_id, off, mapable: of every window, whether it has one placement under opts.

    A text with one placement occurs once, so its class gives the place and no repeat is joined by its text.
    """
    once = counts(refs, c, opts).filter("hits = 1").select("window")
    marks = c.table.filter("n = 1").join(once, "window", "left_semi").select(F.col("first").alias("place"), F.lit(True).alias("one"))
    known = c.places.join(marks, "place", "left").select("ref_id", "off", F.coalesce("one", F.lit(False)).alias("mapable"))
    ns = F.length("window") - F.length(F.replace("window", F.lit("N"), F.lit("")))
    most = c.width if opts.mode == "n" else opts.budget
    every = tile_windows(refs, c.width).withColumn("ns", ns)
    never = every.filter(F.col("ns") > most).select("ref_id", "off", F.lit(False).alias("mapable"))
    some = every.filter(F.col("ns").between(1, most)).join(once.withColumn("one", F.lit(True)), "window", "left")
    return known.unionByName(never).unionByName(some.select("ref_id", "off", F.coalesce("one", F.lit(False)).alias("mapable")))
