"""Search by strata: a round for each number of mismatches, of the reads that the rounds before left open.

A read is closed once no further stratum can change what is reported of it: with strata by its first
placement, with a limit of k by k placements (and by one more than -m or -M allows, which has to be
seen). Most reads are closed by exact keys, of which there are few, so the many keys of later rounds
are made for few reads. A stratum is found whole or not at all, so counts within it are right.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import AlignOptions
from ..sources.storage import stored
from .search import HIT, READ_KEY, align, candidates


@dataclass
class Rounds:
    """hits: the placements found, as HIT; open_reads and candidates: of each round, the latter only if asked for."""

    hits: DataFrame
    open_reads: list[int] = field(default_factory=list)
    candidates: list[int] = field(default_factory=list)


def enough(opts: AlignOptions) -> int | None:
    """Placements that close a read; None if all have to be found."""
    if opts.strata:
        return 1
    if opts.limit is None:
        return None
    most = opts.m if opts.m is not None else opts.sample_m
    return opts.limit if most is None else max(opts.limit, most + 1)


def by_strata(reads: DataFrame, refs, opts: AlignOptions, count: bool = False) -> Rounds:
    """What policy.report() lets through of these hits is what it lets through of align()'s. Each round's hits are written to the shared folder."""
    out = Rounds(reads.sparkSession.createDataFrame([], HIT))
    if (n := enough(opts)) is None:
        out.hits = align(reads, refs, opts)
        return out
    budget = "v" if opts.mode == "v" else "n"
    left, out.hits = reads, None
    for b in range(opts.budget + 1):
        own = replace(opts, **{budget: b})
        out.open_reads.append(left.select(*READ_KEY).distinct().count())
        if count:
            found = candidates(left, refs, own)
            out.candidates.append(found[0].count() if found else 0)
        hits = stored(align(left, refs, own).filter(F.col("stratum") == b), "round")
        out.hits = hits if out.hits is None else out.hits.unionByName(hits)
        closed = out.hits.groupBy(*READ_KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= n).select(*READ_KEY)
        left = reads.join(closed, [*READ_KEY], "left_anti")
        if b < opts.budget and left.isEmpty():
            break
    return out
