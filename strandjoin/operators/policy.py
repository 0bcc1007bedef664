"""Which of a read's valid placements are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..options import AlignOptions

READ = ("read_id", "mate")


def order() -> list[Column]:
    """Best first: stratum, penalty, place, strand."""
    return [F.col("stratum"), F.col("penalty"), F.col("ref_id"), F.col("off"), F.col("fw").desc()]


def with_others(hits: DataFrame) -> DataFrame:
    """Adds oms: other hits of the read and strand whose reference window is the same string."""
    return hits.withColumn("oms", F.count("*").over(Window.partitionBy(*READ, "fw", "window")) - 1)


def best_stratum(hits: DataFrame, key: tuple[str, ...] = READ) -> DataFrame:
    """Hits of the read's best stratum; oms counts their siblings."""
    d = hits.withColumn("__least", F.min("stratum").over(Window.partitionBy(*key))).filter(F.col("stratum") == F.col("__least")).drop("__least")
    return d.withColumn("oms", F.count("*").over(Window.partitionBy(*key)) - 1)


def report(hits: DataFrame, opts: AlignOptions, key: tuple[str, ...] = READ, by: list[Column] | None = None) -> DataFrame:
    """hits with n_hits, sampled, mapq and rank; only what -k/-a, --best/--strata, -m and -M let through."""
    by = by or order()
    d = hits if "oms" in hits.columns else with_others(hits)
    if opts.strata:
        d = best_stratum(d, key)
    everything = Window.partitionBy(*key)
    if opts.m is not None or opts.sample_m is not None:
        d = d.withColumn("n_hits", F.count("*").over(everything))
    else:
        d = d.withColumn("n_hits", F.lit(None).cast("long"))
    over = F.lit(False)
    if opts.m is not None:
        d = d.filter(F.col("n_hits") <= opts.m)
    if opts.sample_m is not None:
        over = F.col("n_hits") > opts.sample_m
        draw = F.xxhash64(F.lit(opts.seed), *key, "ref_id", "off", "fw")
        d = d.withColumn("sampled", over)
        d = d.withColumn("rank", F.row_number().over(everything.orderBy(F.when(over, F.col("stratum")), F.when(over, draw), *by)))
        d = d.withColumn("oms", F.when(over, F.lit(opts.sample_m).cast("long")).otherwise(F.col("oms")))
        d = d.filter(~over | (F.col("rank") == 1))
    else:
        d = d.withColumn("sampled", F.lit(False)).withColumn("rank", F.row_number().over(everything.orderBy(*by)))
    if opts.limit is not None:
        d = d.filter(F.col("sampled") | (F.col("rank") <= opts.limit))
    return d.withColumn("mapq", F.when(F.col("sampled"), F.lit(0)).otherwise(F.lit(255)))


def status(reads: DataFrame, hits: DataFrame, opts: AlignOptions, key: str = "read_id") -> DataFrame:
    """key, status: aligned, maxed (over -m or -M) or unaligned; a row for each read or pair."""
    d = best_stratum(hits) if opts.strata else hits
    most = opts.m if opts.m is not None else opts.sample_m
    n = d.groupBy(key).agg(F.count("*").alias("n"))
    what = F.when(F.col("n").isNull(), F.lit("unaligned"))
    if most is not None:
        what = what.when(F.col("n") > most, F.lit("maxed"))
    return reads.select(key).distinct().join(n, key, "left").select(key, what.otherwise(F.lit("aligned")).alias("status"))


def route(reads: DataFrame, states: DataFrame, keep_maxed: bool = True) -> dict[str, DataFrame]:
    """The reads' original text by status: al, un, max; without keep_maxed the maxed ones are with un."""
    d = reads.join(states, "read_id")
    un = F.col("status") == "unaligned" if keep_maxed else F.col("status") != "aligned"
    return {"al": d.filter("status = 'aligned'"), "un": d.filter(un), "max": d.filter("status = 'maxed'").filter(F.lit(keep_maxed))}


def counters(states: DataFrame, reported: DataFrame, sampling: bool = False) -> DataFrame:
    """One row: processed, aligned, failed, suppressed, reported, pct_aligned, pct_failed, pct_suppressed. Reads over the limit count as aligned; with sampling (-M) a placement of each is reported, and suppressed says how many were sampled."""
    one = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0).cast("long"))
    c = states.agg(one("aligned").alias("a"), one("unaligned").alias("u"), one("maxed").alias("m")).crossJoin(reported.agg(F.count("*").alias("reported")))  # one row each
    hit = F.col("a") + F.col("m")
    total = hit + F.col("u")
    pct = lambda x: F.when(total > 0, F.round(100.0 * x / total, 2)).otherwise(0.0)
    return c.select(total.alias("processed"), hit.alias("aligned"), F.col("u").alias("failed"), F.col("m").alias("suppressed"), "reported", pct(hit).alias("pct_aligned"), pct(F.col("u")).alias("pct_failed"), pct(F.col("m")).alias("pct_suppressed"), F.lit(sampling).alias("sampling"))


def metrics(reads: DataFrame) -> DataFrame:
    """One row of read statistics: reads, homopolymer, low and high entropy (base counts' Shannon entropy under and over 1.4 bits), with 3 or more N."""
    n = F.greatest(F.length("seq"), F.lit(1))
    share = [(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))) / n for b in "ACGT"]
    entropy = -sum((F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    d = reads.select("seq", entropy.alias("h"), (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("ns"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return d.agg(F.count("*").alias("reads"), count((F.col("h") == 0) & (F.length("seq") > 0)).alias("homopolymers"), count(F.col("h") < 1.4).alias("low_entropy"), count(F.col("h") >= 1.4).alias("high_entropy"), count(F.col("ns") >= 3).alias("with_3_n"))


def observed(reads: DataFrame, states: DataFrame) -> tuple[DataFrame, Observation]:
    """reads with their status, and an observation that counts them by class while they are written: aligned and unaligned ones (over a limit counts as aligned), of each class by entropy and of those with 3 or more N."""
    n = F.greatest(F.length("seq"), F.lit(1))
    share = [(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))) / n for b in "ACGT"]
    entropy = -sum((F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    several_n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit(""))) >= 3
    classes = {"reads": F.lit(True), "homopolymers": (entropy == 0) & (F.length("seq") > 0), "low_entropy": entropy < 1.4, "high_entropy": entropy >= 1.4, "with_3_n": several_n}
    d = reads.join(states, "read_id")
    seen = Observation()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    aligned = F.col("status") != "unaligned"
    parts = [count(c & a).alias(f"{name}_{how}") for name, c in classes.items() for how, a in (("aligned", aligned), ("unaligned", ~aligned))]
    return d.observe(seen, *parts), seen
