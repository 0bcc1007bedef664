"""Pairs by one mate: the rarer one is placed, the other is looked for where the insert allows it.

Of a pair the mate with fewer candidates anchors; only its placements are searched by keys. Around each
of them the stretch in which the other mate can lie is cut from the tiles, and every window of it is
compared, without keys, so that the other mate may have more mismatches than keys could serve. As both
mates of a pair have to be placed, whichever anchors, no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import AlignOptions
from .pairs import concordant
from .search import HIT, STRANDS, align, candidates, close_enough, oriented, verify

HIT_COLUMNS = [x.split()[0] for x in "read_id, mate, name, fw, ref_id, off, seq, qual, len, stratum, penalty, cost, mms, window, trimmed5, trimmed3".split(", ")]


def anchors(reads: DataFrame, refs, opts: AlignOptions) -> DataFrame:
    """Of mates (read_id with mates 1 and 2) the rows of the mate that has fewer candidates, the first where they are as many."""
    found = candidates(reads, refs, opts)
    n = found[0].groupBy("read_id", "mate").agg(F.count("*").alias("n")) if found else reads.sparkSession.createDataFrame([], "read_id long, mate int, n long")
    counted = reads.select("read_id", "mate").join(n, ["read_id", "mate"], "left").fillna({"n": 0})
    least = counted.groupBy("read_id").agg(F.min(F.struct("n", "mate")).alias("x")).select("read_id", F.col("x.mate").alias("mate"))
    return reads.join(least, ["read_id", "mate"], "left_semi")


def beside(placed: DataFrame, others: DataFrame, refs, opts: AlignOptions, allowed: AlignOptions | None = None) -> DataFrame:
    """Placements, as HIT, of others (reads) within the insert of their mates' placements; allowed: the mismatches that they may have, if other ones than opts'."""
    allowed = allowed or opts
    fw1, fw2 = STRANDS[opts.orientation]
    probes = oriented(others, opts)
    longest = probes.agg(F.max("len")).first()[0]
    if longest is None:
        return others.sparkSession.createDataFrame([], HIT)
    if longest > refs.right:
        raise ValueError(f"a read has {longest} bases, the tiles show {refs.right}")
    own = F.when(F.col("a_mate") == 1, F.lit(fw1)).otherwise(F.lit(fw2))
    straight = F.col("a_fw") == own
    a = placed.select("read_id", "ref_id", F.col("mate").alias("a_mate"), F.col("fw").alias("a_fw"), F.col("off").alias("a_off"), F.col("len").alias("a_len"))
    d = a.join(probes, "read_id").filter("mate <> a_mate")
    due = F.when(F.col("mate") == 1, F.lit(fw1)).otherwise(F.lit(fw2))
    d = d.filter((F.col("fw") == due) == straight)
    behind = straight == (F.col("a_mate") == 1)  # whether the other mate is downstream
    low = F.when(behind, F.col("a_off")).otherwise(F.greatest(F.col("a_off") + F.col("a_len") - opts.max_insert, F.lit(0)))
    high = F.when(behind, F.col("a_off") + opts.max_insert - F.col("len")).otherwise(F.col("a_off"))
    d = d.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).filter("low <= high")
    # stretches that a tile shows whole; those of neighbouring anchors overlap
    step = refs.right - longest + 1
    d = d.withColumn("from", F.explode(F.sequence("low", "high", F.lit(step).cast("long"))))
    tiles = refs.tiles.select(F.col("ref_id").alias("t_ref"), "t0", "bases")
    d = d.join(tiles, (F.col("ref_id") == F.col("t_ref")) & (F.col("from") - F.col("from") % refs.step == F.col("t0")))
    last = F.least(F.lit(step - 1).cast("long"), F.col("high") - F.col("from"), F.length("bases") - F.col("len") - (F.col("from") - F.col("t0"))).cast("int")
    d = d.filter(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    d = d.withColumn("window", F.substring("bases", (F.col("from") - F.col("t0")).cast("int") + F.col("i") + 1, F.col("len"))).withColumn("off", F.col("from") + F.col("i"))
    zero = F.lit(0)
    d = d.filter(close_enough(F.col("window"), allowed)).drop("bases", "t_ref", "t0", "from", "low", "high", "i", "a_mate", "a_fw", "a_off", "a_len")
    d = d.dropDuplicates(["read_id", "mate", "fw", "ref_id", "off"]).withColumns({"block": zero, "blen": zero, "k": zero, "errors": zero})
    return verify(d, allowed).select(*HIT_COLUMNS)


def paired(reads: DataFrame, refs, opts: AlignOptions, allowed: AlignOptions | None = None) -> DataFrame:
    """concordant()'s pairs of reads (mates 1 and 2) against tiles or an opened index, from the rarer mates' placements. With allowed the other mate may have as many mismatches as that says."""
    rare = anchors(reads, refs, opts)
    placed = align(rare, refs, opts)
    others = reads.join(rare.select("read_id", "mate"), ["read_id", "mate"], "left_anti")
    return concordant(placed.select(*HIT_COLUMNS).unionByName(beside(placed, others, refs, opts, allowed)), opts)
