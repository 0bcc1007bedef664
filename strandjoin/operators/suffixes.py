"""Suffix array and Burrows-Wheeler transform of each reference, by prefix doubling.

Ranks start from windows of `start` characters; each round joins every suffix with the one `h`
behind it and ranks the pairs by a range-partitioned sort, until no two suffixes are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.reads import windows
from ..sources.storage import ranked, stored


def suffix_array(refs: DataFrame, start: int = 16) -> DataFrame:
    """ref_id, place (from 0), pos, before (the character before the suffix, $ for the first): the end of a text sorts before its characters."""
    end = "$"
    padded = refs.select(F.col("ref_id").alias("seq_id"), F.lit("").alias("name"), F.concat(F.col("seq"), F.repeat(F.lit(end), F.lit(start))).alias("seq"), F.length("seq").alias("n"))
    d = windows(padded, start, 1).select("seq_id", "off", F.col("seq").alias("w"))
    sizes = refs.select(F.col("ref_id").alias("seq_id"), F.length("seq").cast("long").alias("n"))
    d = d.join(sizes, "seq_id").filter("off <= n").select("seq_id", "off", "w")
    d = _rank(d, ["seq_id", "w"])
    h = start
    while True:
        n, distinct = d.agg(F.count("*"), F.countDistinct("rank")).first()
        if n == distinct:
            break
        ahead = d.select(F.col("seq_id"), (F.col("off") - h).alias("off"), F.col("rank").alias("ahead"))
        pairs = d.join(ahead, ["seq_id", "off"], "left").select("seq_id", "off", F.col("rank").alias("own"), F.coalesce("ahead", F.lit(-1).cast("long")).alias("ahead"))
        d = _rank(pairs, ["own", "ahead"])
        d = stored(d, "ranks")  # lineage would double with every round
        h *= 2
    first = d.groupBy("seq_id").agg(F.min("rank").alias("least"))
    d = d.join(first, "seq_id").select(F.col("seq_id").alias("ref_id"), (F.col("rank") - F.col("least")).alias("place"), F.col("off").alias("pos"))
    text = refs.select(F.col("ref_id").alias("seq_id"), F.lit("").alias("name"), F.concat(F.lit(end), F.col("seq")).alias("seq"))
    chars = windows(text, 1, 1).select(F.col("seq_id").alias("ref_id"), F.col("off").alias("pos"), F.col("seq").alias("before"))
    return d.join(chars, ["ref_id", "pos"]).select("ref_id", "place", "pos", "before")


def _rank(d: DataFrame, by: list[str]) -> DataFrame:
    """d without `by`, with rank: the place of its values among the distinct ones. seq_id and off stay."""
    keys = ranked(d.select(*by).distinct(), by, "rank")
    joined = d.join(keys, by)
    return joined.select("seq_id", "off", "rank")


def bwt(sa: DataFrame) -> DataFrame:
    """ref_id, bwt: the characters before the sorted suffixes."""
    rows = sa.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("place", "before"))).alias("p"))
    return rows.select("ref_id", F.array_join(F.transform("p", lambda x: x["before"]), "").alias("bwt"))


def suffix_sample(sa: DataFrame, offrate: int = 5) -> DataFrame:
    """Every 2^offrate-th row of the suffix array: ref_id, place, pos."""
    return sa.filter(F.col("place") % (1 << offrate) == 0).select("ref_id", "place", "pos")
