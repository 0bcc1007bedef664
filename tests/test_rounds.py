"""Search by strata, observed metrics and the checks of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandjoin.aligner import run
from strandjoin.operators import analysis, pairs, policy
from strandjoin.operators.rounds import by_strata
from strandjoin.operators.search import align, candidates
from strandjoin.options import AlignOptions
from strandjoin.sources import references

READS = "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int"


def made(spark, seed, n=60, width=24):
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = [unit, unit[:150] + "".join(rng.choice("ACGT") for _ in range(400)), "".join(rng.choice("ACGTN") for _ in range(200))]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    rows = []
    for i in range(n):
        s = rng.choice(seqs)
        at = rng.randrange(len(s) - width)
        r = list(s[at : at + width])
        for _ in range(rng.randrange(4)):
            r[rng.randrange(width)] = rng.choice("ACGTN")
        r = "".join(r)
        rows.append((i, 0, f"r{i}", r, "".join(chr(33 + rng.randrange(40)) for _ in r), r, 0, 0))
    return spark.createDataFrame(rows, READS), refs


@pytest.mark.parametrize("opts", [{"k": 1}, {"k": 2, "m": 3}, {"every": True, "strata": True}, {"every": True, "strata": True, "m": 1}, {"k": 1, "sample_m": 1}, {"mode": "n", "n": 2, "seed_len": 16, "max_penalty": 90, "k": 1}])
def test_rounds_report_the_same(spark, opts):
    reads, refs = made(spark, 1)
    o = AlignOptions(**({"mode": "v", "v": 2, "best": True} | opts))
    columns = ["read_id", "ref_id", "off", "fw", "stratum", "penalty", "rank", "oms", "sampled"]
    shown = lambda hits: sorted(tuple(r) for r in policy.report(hits, o).select(*columns).collect())
    assert shown(by_strata(reads, refs, o).hits) == shown(align(reads, refs, o))


def test_rounds_look_at_fewer_candidates(spark):
    reads, refs = made(spark, 2)
    o = AlignOptions(mode="v", v=2, best=True, every=True, strata=True)
    r = by_strata(reads, refs, o, count=True)
    assert r.open_reads[0] == 60 and r.open_reads == sorted(r.open_reads, reverse=True) and r.open_reads[-1] < 60
    assert sum(r.candidates) < candidates(reads, refs, o)[0].count()


def test_observed(spark):
    reads, refs = made(spark, 3)
    o = AlignOptions(mode="v", v=1, m=1)
    d, seen = policy.observed(reads, policy.status(reads, align(reads, refs, o), o))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1
    rows = d.collect()
    got = seen.get
    assert got["reads_aligned"] == sum(r["status"] != "unaligned" for r in rows)
    assert got["reads_aligned"] + got["reads_unaligned"] == 60
    total = policy.metrics(reads).first()
    for c in ("homopolymers", "low_entropy", "high_entropy", "with_3_n"):
        assert got[f"{c}_aligned"] + got[f"{c}_unaligned"] == total[c]


def test_sampled_counters(spark):
    reads, refs = made(spark, 4)
    for o in (AlignOptions(mode="v", v=1, m=1), AlignOptions(mode="v", v=1, sample_m=1)):
        r = run(reads, refs, o)
        c = r.counters().first()
        assert c["processed"] == 60 and c["aligned"] + c["failed"] == 60 and c["suppressed"] > 0
        assert c["sampling"] == (o.sample_m is not None)


def singles(rng, n):
    return [(rng.randrange(8), m, 0, rng.randrange(60), 10, rng.random() < 0.5) for _ in range(n) for m in (1, 2)]


@pytest.mark.parametrize("orientation", ["fr", "rf", "ff"])
def test_pairs_against_all_pairs(spark, orientation):
    rows = sorted(set(singles(random.Random(5), 70)))
    f1, f2 = {"fr": (True, False), "rf": (False, True), "ff": (True, True)}[orientation]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and a[3] < b[3]:
                insert = b[3] + b[4] - a[3]
                one, two = (a, b) if a[1] == 1 else (b, a)
                fits = (one[5], two[5]) == (f1, f2) if a[1] == 1 else (one[5], two[5]) == (not f1, not f2)
                if fits and insert > 10 and 12 <= insert <= 30:
                    want.add((a[0], a[2], a[3], b[3], a[1]))
    o = AlignOptions(mode="v", v=1, every=True, orientation=orientation, min_insert=12, max_insert=30)
    d = spark.createDataFrame(rows, "read_id long, mate int, ref_id long, off long, len int, fw boolean")
    assert {tuple(r) for r in analysis.rebuilt_pairs(d, o).collect()} == want
    full = d
    for c, v in {"stratum": 0, "penalty": 0, "trimmed5": 0, "trimmed3": 0}.items():
        full = full.withColumn(c, F.lit(v))
    full = full.withColumns({c: F.lit("") for c in ("seq", "qual", "mms", "name", "window")})
    assert analysis.verify_pairs(d, pairs.concordant(full, o), o).count() == 0
    lost = sorted(want)[0]
    said = [(r, ref, *((a, b) if m == 1 else (b, a)), m) for r, ref, a, b, m in want - {lost}] + [(99, 0, 1, 15, 1)]
    faults = analysis.verify_pairs(d, spark.createDataFrame(said, "read_id long, ref_id long, m1_off long, m2_off long, first int"), o).collect()
    assert {(tuple(r)[:5], r["fault"]) for r in faults} == {(lost, "missing"), ((99, 0, 1, 15, 1), "extra")}


def test_reconcile_pairs(spark):
    d = lambda ids: spark.createDataFrame([(i, m) for i in ids for m in (1, 2)], "read_id long, mate int")
    half = spark.createDataFrame([(3, 1), (4, 1), (4, 2), (6, 2)], "read_id long, mate int")
    got = analysis.reconcile_pairs(d(range(8)), d([0, 1]).unionByName(half), d([2, 4, 9]), d([5, 7]), d([0, 4, 7]))
    assert {r["read_id"]: r["fault"] for r in got.collect()} == {1: "unreported", 3: "lost", 4: "split", 6: "lost", 7: "reported", 9: "unknown"}
