"""Alignment as a similarity join: seeds, exact seed join, verification.

Seeds come from the pigeonhole principle. A read with at most b mismatches in its seed part has, of
b + 1 disjoint blocks of it, one that matches exactly; and of two blocks one with at most one
mismatch where b is 2 or 3, so that the exact keys within one mismatch of a block are looked up.
Whichever expects fewer candidates is taken for each read: three keys of 9 bases match the reference
far more often than 86 of 14. Both strands are searched by the reverse complement of the read.

Keys are joined with the reference's k-mers, two bits a base, which are K bases wide; a shorter key
is compared with as many leading bases. K-mers are an index's stored table, or made of tiles on the
fly. Candidates are compared with the tiles' packed words by exclusive or and a count of bits, in
generated code; only what is left gets its window as text and is verified base by base. (Reads of more
than PACKED words are held against the text by a bounded edit distance, never above the number of
mismatches.) A placement that several blocks find is kept from the first of them, which needs no shuffle.

Keys are broadcast while their counted bytes are at most max_broadcast. The tiles are then walked once:
the k-mers of a tile are looked up and what they find is compared with the same tile's words, so that no
row of a k-mer is stored, shuffled or joined with its tile again. Beyond it keys and k-mers are shuffled by
key (an index's stored ones aren't at their full width, as they are bucketed), where adaptive execution
splits the rows of a hot k-mer, and candidates are joined with their tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import penalty
from ..functions.sequence import WORD, flag_words, mismatches, pack_2bit, packed_compare, packed_words, reverse_complement, word_at
from ..options import AlignOptions
from ..sources.references import Tiled, tiled

#: Bases of a stored k-mer, and the key widths in use: the widest that a block has room for.
K = 14
#: Words of a read up to which it is compared packed.
PACKED = 6
WIDTHS = (14, 12, 10, 8, 6, 5, 4, 3, 2, 1)
READ_KEY = ("read_id", "mate")
# Strands of mate 1 and mate 2 by orientation.
STRANDS = {"fr": (True, False), "rf": (False, True), "ff": (True, True)}


def oriented(reads: DataFrame, opts: AlignOptions) -> DataFrame:
    """A row for each read and searched strand, with the read as it lies on the forward reference (probe, pqual).

    For mates a strand that isn't searched is an orientation of the pair: each mate goes without the strand it has there.
    """
    n = F.length("seq")
    seed = n if opts.mode == "v" else F.least(F.lit(opts.seed_len), n)
    d = reads.filter(n >= opts.shortest).withColumn("len", n).withColumn("seed_n", seed)
    d = d.withColumn("fw", F.explode(F.array(F.lit(True), F.lit(False))))
    fw1, fw2 = STRANDS[opts.orientation]
    own = F.when(F.col("mate") == 2, F.lit(fw2)).when(F.col("mate") == 1, F.lit(fw1)).otherwise(F.lit(True))
    d = d.filter(F.when(F.col("fw") == own, F.lit(opts.forward)).otherwise(F.lit(opts.reverse)))
    d = d.withColumn("probe", F.when(F.col("fw"), F.col("seq")).otherwise(reverse_complement("seq")))
    d = d.withColumn("pqual", F.when(F.col("fw"), F.col("qual")).otherwise(F.reverse("qual")))
    return d.withColumn("seed_at", F.when(F.col("fw"), F.lit(0)).otherwise(F.col("len") - F.col("seed_n")))


def _width(bases: Column) -> Column:
    """The widest key for a block."""
    table = F.array(*[F.lit(max(w for w in WIDTHS if w <= n)) for n in range(1, K + 1)])
    return F.element_at(table, F.least(bases, F.lit(K)))


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), by.cast("int"))


def planned(probes: DataFrame, opts: AlignOptions) -> DataFrame:
    """How each probe is looked up: read_id, mate, fw, probe, len, seed_at, seed_n, errors (mismatches that a block's keys allow), blen, k, blocks."""
    exact = opts.budget + 1
    d = probes.select(*READ_KEY, "fw", "probe", "len", "seed_at", "seed_n", *[F.floor(F.col("seed_n") / n).cast("int").alias(f"b{n}") for n in {exact, 2}])
    if opts.budget < 2:
        near = F.lit(False)
    else:  # expected candidates for each reference base: keys over the number of keys of that width
        d = d.withColumns({"w1": _width(F.col(f"b{exact}")), "w2": _width(F.col("b2"))})
        near = 2 * (3 * F.col("w2") + 1) * F.pow(F.lit(0.25), "w2") < exact * F.pow(F.lit(0.25), "w1")
    d = d.withColumn("errors", near.cast("int"))
    d = d.withColumn("blen", F.when(F.col("errors") == 1, F.col("b2")).otherwise(F.col(f"b{exact}"))).withColumn("k", _width(F.col("blen")))
    d = d.withColumn("blocks", F.when(F.col("errors") == 1, F.lit(2)).otherwise(F.lit(exact)))
    return d.select(*READ_KEY, "fw", "probe", "len", "seed_at", "seed_n", "errors", "blen", "k", "blocks")


def seeds(plan: DataFrame) -> DataFrame:
    """A row for each key of each block of planned probes, with block and seed for blocks. A block with more N than errors has no key."""
    d = plan.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    d = d.withColumn("s", F.substring("probe", F.col("seed_at") + F.col("block") * F.col("blen") + 1, F.col("k")))
    d = d.withColumn("ns", F.length("s") - F.length(F.replace("s", F.lit("N"), F.lit("")))).filter(F.col("ns") <= F.col("errors"))
    d = d.withColumn("base", pack_2bit(F.replace("s", F.lit("N"), F.lit("A"))))
    digit = lambda i: 2 * (F.col("k") - 1 - i)
    any_place = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), 3 * F.col("k") - 1), lambda x: _shift(x % 3 + 1, digit(F.floor(x / 3)))))
    at_n = F.transform(F.array(*map(F.lit, range(4))), lambda x: _shift(x, digit(F.instr("s", "N") - 1)))
    masks = F.when(F.col("errors") == 0, F.array(F.lit(0).cast("long"))).when(F.col("ns") > 0, at_n).otherwise(any_place)
    d = d.withColumn("mask", F.explode(masks))
    return d.withColumn("seed", F.col("base").bitwiseXOR(F.col("mask"))).drop("s", "ns", "base", "mask")


def kmers(t: Tiled, k: int = K) -> DataFrame:
    """kmer (two bits a base), span, ref_id, pos: the k bases from each position on; where an N or the end comes first, span is how many there are before it, and the rest is as if A."""
    inner = 64
    d = t.tiles.withColumn("s", F.explode(F.sequence(F.lit(0), F.least(F.length("bases"), F.lit(t.step)) - 1, F.lit(inner))))
    part = F.translate(F.substring("bases", F.col("s") + 1, F.lit(inner + k - 1)), "ACGT", "0123")
    d = d.select("ref_id", (F.col("t0") + F.col("s")).alias("t1"), part.alias("part"), F.least(F.lit(inner), F.length("bases") - F.col("s")).alias("own"))
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    d = d.select("ref_id", (F.col("t1") + F.col("j")).alias("pos"), F.substring_index(F.substring("part", F.col("j") + 1, F.lit(k)), "N", 1).alias("s")).filter("s <> ''")
    return d.select(F.conv(F.rpad("s", k, "0"), 4, 10).cast("long").alias("kmer"), F.length("s").alias("span"), "ref_id", "pos")


#: What a walk over the tiles knows of a candidate's tile: for packed reads the words that it lies in, which begin at t0.
TILE = ("t0", "bases", "words", "ns")


def walked(t: Tiled, own: DataFrame, k: int, longest: int) -> DataFrame:
    """Broadcast keys (seeds()) with the places where k bases of a tile equal them: own's columns, ref_id, off and TILE (bases for reads over PACKED words, words and ns for others). A placement comes from the tile that it begins in, so a tile is read up to the longest read behind it.

    Ns are as A here and a tile is as if A went on behind its end; compared windows are checked for both.
    """
    tiles = t.tiles if "words" in t.tiles.columns else with_words(t.tiles)
    chunks = -(-longest // WORD)
    kept = ("ref_id", "t0", "words", *(("ns",) if chunks <= PACKED else ("bases",)))
    upto = F.least(F.size("words"), F.lit(-(-(t.step + longest) // WORD)))
    d = tiles.filter("bases <> ''").select(*kept, F.explode(F.sequence(F.lit(0), upto - 1)).alias("w"))
    high, low = (F.coalesce(F.get("words", F.col("w") + i), F.lit(0).cast("long")) for i in (0, 1))
    d = d.select(*kept, "w", high.alias("high"), low.alias("low"), F.explode(F.array(*map(F.lit, range(WORD)))).alias("j"))
    two = _shift(F.col("high"), 2 * F.col("j")).bitwiseAND(F.lit((1 << 2 * WORD) - 1)).bitwiseOR(F.call_function("shiftrightunsigned", F.col("low"), 2 * (WORD - F.col("j"))))
    d = d.select(*kept, (F.col("t0") + F.col("w") * WORD + F.col("j")).alias("pos"), F.shiftrightunsigned(two, 2 * (WORD - k)).alias("kmer"))
    d = d.join(F.broadcast(own), F.col("kmer") == F.col("seed"))
    d = d.withColumn("off", F.col("pos") - F.col("seed_at") - F.col("block") * F.col("blen"))
    d = d.filter((F.col("off") >= F.col("t0")) & (F.col("off") < F.col("t0") + t.step)).drop("pos", "kmer", "seed")
    if chunks <= PACKED:
        i = F.greatest(F.floor((F.col("off") - F.col("t0")) / WORD).cast("int"), F.lit(0))  # conditions may be taken in another order
        d = d.withColumns({"words": F.slice("words", i + 1, F.lit(chunks + 1)), "ns": F.slice("ns", i + 1, F.lit(chunks + 1)), "t0": F.col("t0") + i * WORD})
    else:
        d = d.drop("words")
    # keeps the partitions, but generated code of what follows apart: with it the loop over positions is a method too long to be compiled
    return d.coalesce(1 << 20)


def kmer_text(kmer: Column, k: int) -> Column:
    """The bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def _first_block() -> Column:
    """Whether no earlier block finds the placement too; at is where read and window differ."""
    ok = F.lit(True)
    i0 = F.col("seed_at")
    for b in range(3):
        start = i0 + b * F.col("blen")
        wrong = F.size(F.filter("at", lambda i: (i >= start) & (i < start + F.col("k"))))  # noqa: B023
        ok = ok & ((F.col("block") <= b) | (wrong > F.col("errors")))
    return ok


def judged(cands: DataFrame, opts: AlignOptions, once: Column | None = None) -> DataFrame:
    """Candidates with their window: the valid ones, with seq and qual as placed, stratum, penalty, cost and mismatches by position from the 5' end. once: which rows of `at` are kept of a placement found several times, if not those of the first block."""
    # exploded, as predicates on a projected column would compute it anew below the joins
    d = cands.withColumn("at", F.explode(F.array(mismatches(F.col("probe"), F.col("window"))))).filter(_first_block() if once is None else once)
    five = lambda i: F.when(F.col("fw"), i).otherwise(F.col("len") - 1 - i)
    cost = lambda i: penalty(F.ascii(F.substring("pqual", i + 1, F.lit(1))) - 33, opts.rounding)
    d = d.withColumn("penalty", F.aggregate("at", F.lit(0), lambda a, i: a + cost(i)))
    d = d.withColumn("stratum", F.size(F.filter("at", lambda i: five(i) < F.col("seed_n"))))
    valid = F.col("stratum") <= opts.budget
    if opts.mode == "n":
        valid = valid & (F.col("penalty") <= opts.max_penalty)
    one = lambda i: F.struct(five(i).alias("pos"), F.substring("window", i + 1, F.lit(1)).alias("ref"), F.substring("probe", i + 1, F.lit(1)).alias("read"))
    d = d.filter(valid).withColumn("mms", F.array_sort(F.transform("at", one)))
    return d.withColumns({"seq": F.col("probe"), "qual": F.col("pqual"), "cost": F.col("stratum") * 16384 + F.col("penalty")})


def verify(cands: DataFrame, opts: AlignOptions) -> DataFrame:
    """judged() placements as HIT."""
    return judged(cands, opts).select("read_id", "mate", "name", "fw", "ref_id", "off", "seq", "qual", "len", "stratum", "penalty", "cost", "mms", "window", "trimmed5", "trimmed3")


HIT = "read_id long, mate int, name string, fw boolean, ref_id long, off long, seq string, qual string, len int, stratum int, penalty int, cost int, mms array<struct<pos:int,ref:string,read:string>>, window string, trimmed5 int, trimmed3 int"


def close_enough(window: Column, opts: AlignOptions) -> Column:
    """Whether the seed parts of read and window can differ in no more than the budget, by a bounded edit distance, and the window is whole."""
    part = lambda c: F.substring(c, F.col("seed_at") + 1, F.col("seed_n"))
    near = F.levenshtein(part(F.col("probe")), part(window), opts.budget) >= 0 if opts.budget else part(F.col("probe")) == part(window)
    return (F.length(window) == F.col("len")) & near & ~F.contains(window, F.lit("N"))


#: A probe's words: its bases, its Ns, the seed part, and all of it.
PROBE_WORDS = ("bases", "ns", "seed", "inside")


def with_words(tiles: DataFrame) -> DataFrame:
    """Tiles with their bases packed."""
    words, ns = packed_words("bases")
    return tiles.withColumns({"words": words, "ns": ns})


def probe_words(plan: DataFrame) -> DataFrame:
    """plan with PROBE_WORDS as p_* columns."""
    words, _ = packed_words("probe")
    flags = lambda c: F.translate(c, "ACGTN", "AAAAC")
    no, yes = (lambda n, x=x: F.repeat(F.lit(x), n.cast("int")) for x in "AC")
    seed = F.concat(no(F.col("seed_at")), yes(F.col("seed_n")), no(F.col("len") - F.col("seed_at") - F.col("seed_n")))
    made = {"bases": words, "ns": flag_words(flags(F.col("probe"))), "seed": flag_words(seed), "inside": flag_words(yes(F.col("len")))}
    return plan.withColumns({f"p_{k}": v for k, v in made.items()})


#: Keys are broadcast up to so many bytes.
BROADCAST = 128 << 20


def key_bytes(length: Column) -> Column:
    """What a row of a key takes, at most: the probe's text and its words, and its other columns."""
    return length + len(PROBE_WORDS) * 8 * (F.floor(length / WORD) + 3) + 160


def candidates(reads: DataFrame, refs, opts: AlignOptions, max_broadcast: int = BROADCAST) -> tuple[DataFrame, Tiled, int] | None:
    """Places where a key of a read is found, one row for each key and block that finds it (with TILE where keys were broadcast), the opened references and the longest read's length; None if no read can be searched."""
    spark = reads.sparkSession
    probes = oriented(reads, opts)
    plan = planned(probes, opts)
    # one row for each key width, with the bytes of the most keys that there can be
    most = F.sum(F.col("blocks") * (1 + 3 * F.col("k") * F.col("errors")) * key_bytes(F.col("len")))
    facts = plan.groupBy("k").agg(F.max("len").alias("longest"), most.alias("n")).collect()
    if not facts:
        return None
    longest, few = max(f["longest"] for f in facts), sum(f["n"] for f in facts) <= max_broadcast
    if isinstance(refs, DataFrame):
        if refs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            refs = refs.repartition(spark.sparkContext.defaultParallelism)
        refs = tiled(refs, right=longest)
    if longest > refs.right:
        raise ValueError(f"a read has {longest} bases, the tiles show {refs.right}")
    table = None if few else refs.kmers() if hasattr(refs, "kmers") else kmers(refs)
    cands = None
    for k in sorted(f["k"] for f in facts):
        own = plan.filter(F.col("k") == k)
        own = seeds(probe_words(own) if -(-longest // WORD) <= PACKED else own)
        if few:
            c = walked(refs, own, k, longest)
        else:
            grams = table if k == K else table.filter(F.col("span") >= k).withColumn("kmer", F.shiftright("kmer", 2 * (K - k)))
            c = (grams.filter(F.col("span") == K) if k == K else grams).join(own, grams["kmer"] == own["seed"])
            c = c.withColumn("off", F.col("pos") - F.col("seed_at") - F.col("block") * F.col("blen")).filter("off >= 0")
        cands = c if cands is None else cands.unionByName(c)
    return cands.select(*READ_KEY, "fw", "probe", "len", "seed_at", "seed_n", "blen", "k", "errors", "block", "ref_id", "off", *[c for c in cands.columns if c.startswith("p_") or c in TILE]), refs, longest


def align(reads: DataFrame, refs, opts: AlignOptions, max_broadcast: int = BROADCAST) -> DataFrame:
    """Every valid placement of every read, as HIT. refs: rows of references, tiles, or an opened index. Reads are trimmed and chosen before. Keys over max_broadcast bytes are shuffled."""
    found = candidates(reads, refs, opts, max_broadcast)
    if found is None:
        return reads.sparkSession.createDataFrame([], HIT)
    cands, refs, longest = found
    chunks = -(-longest // WORD)
    at, window = F.col("off") - F.col("t0"), F.substring("bases", (F.col("off") - F.col("t0") + 1).cast("int"), F.col("len"))
    c = cands
    if "t0" not in cands.columns:
        tiles = with_words(refs.tiles) if chunks <= PACKED and "words" not in refs.tiles.columns else refs.tiles
        pieces = tiles.select(F.col("ref_id").alias("t_ref"), "t0", "bases", *(("words", "ns") if chunks <= PACKED else ()))
        c = c.join(pieces, (F.col("ref_id") == F.col("t_ref")) & (F.col("off") - F.col("off") % refs.step == F.col("t0")))
    elif chunks <= PACKED:  # a window without N is what its words say
        window = F.substring(F.concat(*[kmer_text(word_at(F.col("words"), at + WORD * i, 0), WORD) for i in range(chunks)]), F.lit(1), F.col("len"))
    if chunks <= PACKED:
        wrong, broken = packed_compare(F.col("words"), F.col("ns"), at, *[F.col(f"p_{x}") for x in PROBE_WORDS], chunks)
        close = F.explode(F.array((wrong <= opts.budget) & ~broken)).alias("close")  # exploded, or it would be a condition of the join
        c = c.select("*", close).filter("close").drop("close").withColumn("window", F.explode(F.array(window)))
    else:
        c = c.withColumn("window", F.explode(F.filter(F.array(window), lambda w: close_enough(w, opts))))
    c = c.drop(*TILE, "t_ref", *[f"p_{x}" for x in PROBE_WORDS])
    rest = oriented(reads, opts).select(*READ_KEY, "fw", "name", "pqual", "trimmed5", "trimmed3")
    return verify(c.join(rest, [*READ_KEY, "fw"]), opts)
