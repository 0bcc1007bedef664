"""Mate pairs: an interval join of two mates' placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import AlignOptions
from .policy import order, report
from .search import STRANDS

SIDE = ("fw", "off", "len", "stratum", "penalty", "seq", "qual", "mms", "name", "window", "trimmed5", "trimmed3")


def concordant(hits: DataFrame, opts: AlignOptions) -> DataFrame:
    """read_id, ref_id, first (the upstream mate), insert, and the mates' columns as m1_* and m2_*, oms among them if hits have it.

    The band join goes by read, reference and a bin of max_insert bases, with neighbouring bins.
    """
    fw1, fw2 = STRANDS[opts.orientation]
    width = max(opts.max_insert, 1)
    side = lambda m: hits.filter(F.col("mate") == m).select("read_id", "ref_id", F.floor(F.col("off") / width).alias("bin"), *[F.col(c).alias(f"m{m}_{c}") for c in (*SIDE, *({"oms"} & set(hits.columns)))])
    one, two = side(1), side(2)
    two = two.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    d = one.join(two, ["read_id", "ref_id", "bin"])
    straight = (F.col("m1_fw") == fw1) & (F.col("m2_fw") == fw2)
    flipped = (F.col("m2_fw") != fw2) & (F.col("m1_fw") != fw1)
    lower = F.col("m1_off") <= F.col("m2_off") if opts.allow_contain else F.col("m1_off") < F.col("m2_off")
    upper = F.col("m2_off") <= F.col("m1_off") if opts.allow_contain else F.col("m2_off") < F.col("m1_off")
    d = d.withColumn("first", F.when(straight & lower, F.lit(1)).when(flipped & upper, F.lit(2))).filter("first IS NOT NULL")
    d = d.withColumn("insert", F.when(F.col("first") == 1, F.col("m2_off") + F.col("m2_len") - F.col("m1_off")).otherwise(F.col("m1_off") + F.col("m1_len") - F.col("m2_off")))
    # bounds are for whole reads: what was trimmed off the outer ends counts
    cut = F.col("m1_trimmed5" if fw1 else "m1_trimmed3") + F.col("m2_trimmed3" if fw2 else "m2_trimmed5")
    low, high = F.greatest(F.lit(opts.min_insert) - cut, F.lit(0)), F.greatest(F.lit(opts.max_insert) - cut, F.lit(0))
    longest = F.greatest("m1_len", "m2_len")
    ok = (high > longest) & F.col("insert").between(low, high)
    if not opts.allow_contain:
        ok = ok & (F.col("insert") > longest)
    return d.filter(ok).drop("bin")


def report_pairs(pairs: DataFrame, opts: AlignOptions) -> DataFrame:
    """The policy in units of pairs, best by summed stratum and penalty. Of other placements a pair has as many as the mate with fewer; under -M a pair is drawn among those whose better mate has the least stratum."""
    others = F.least("m1_oms", "m2_oms") if "m1_oms" in pairs.columns else F.lit(0).cast("long")
    both = F.col("m1_stratum") + F.col("m2_stratum")
    d = pairs.withColumn("stratum", both if opts.sample_m is None else F.least("m1_stratum", "m2_stratum")).withColumn("penalty", F.col("m1_penalty") + F.col("m2_penalty"))
    d = d.withColumn("off", F.least("m1_off", "m2_off")).withColumn("fw", F.col("first") == 1).withColumn("oms", others)
    return report(d, opts, ("read_id",), [both, *order()[1:]])


def mates(pairs: DataFrame) -> DataFrame:
    """Two rows for each pair, the upstream mate first: columns of hits with mate_off, mate_fw, mate_len, insert, pair_rank."""

    def side(m: int):
        o = 3 - m
        return F.struct((F.col("first") != m).alias("late"), F.lit(m).alias("mate"), *[F.col(f"m{m}_{c}").alias(c) for c in SIDE], F.col(f"m{o}_off").alias("mate_off"), F.col(f"m{o}_fw").alias("mate_fw"), F.col(f"m{o}_len").alias("mate_len"))

    d = pairs.select("read_id", "ref_id", "insert", "mapq", "oms", "n_hits", "sampled", F.col("rank").alias("pair_rank"), F.explode(F.array_sort(F.array(side(1), side(2)))).alias("x"))
    return d.select("read_id", "ref_id", "insert", "mapq", "oms", "n_hits", "sampled", "pair_rank", "x.*")


def singles(hits: DataFrame, pairs: DataFrame, opts: AlignOptions) -> DataFrame:
    """Reported single placements of the reads that no pair was found for."""
    return report(hits.join(pairs.select("read_id").distinct(), "read_id", "left_anti"), opts)

