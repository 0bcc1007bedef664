"""The whole run: reads and references in, reported placements, routed reads and counters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators import pairs as mate_pairs
from .operators import policy
from .operators.search import align
from .options import AlignOptions
from .sources.reads import select, trimmed


@dataclass
class Run:
    """reads: those chosen; hits: reported single placements; mates: reported pairs, a row for each mate; states: a status for each read."""

    reads: DataFrame
    hits: DataFrame
    mates: DataFrame
    states: DataFrame
    sampling: bool = False

    def counters(self) -> DataFrame:
        return policy.counters(self.states, self.hits.select("read_id").unionByName(self.mates.filter("mate = 1").select("read_id")), self.sampling)


def run(reads: DataFrame, refs: DataFrame, opts: AlignOptions) -> Run:
    """Unpaired reads and pairs may be mixed; each goes its way."""
    chosen = select(reads, opts.skip, opts.upto)
    cut = trimmed(chosen, opts.trim5, opts.trim3)
    valid = policy.with_others(align(cut, refs, opts))
    alone, both = valid.filter("mate = 0"), valid.filter("mate > 0")
    found = mate_pairs.concordant(both, opts)
    reported = mate_pairs.mates(mate_pairs.report_pairs(found, opts))
    hits = policy.report(alone, opts)
    if opts.report_singles:
        hits = hits.unionByName(mate_pairs.singles(both, found, opts))
    by_pair = found.select("read_id", (found["m1_stratum"] + found["m2_stratum"]).alias("stratum")).withColumn("mate", policy.F.lit(1))
    unit = alone.select("read_id", "stratum", "mate").unionByName(by_pair.select("read_id", "stratum", "mate"))
    if opts.report_singles:
        unit = unit.unionByName(both.join(found.select("read_id").distinct(), "read_id", "left_anti").select("read_id", "stratum", policy.F.lit(1).alias("mate")))
    return Run(chosen, hits, reported, policy.status(chosen, unit, opts), opts.sample_m is not None)
