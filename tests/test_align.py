"""Small cases with known answers: a reference, reads, options and the placements to find."""

import itertools
import random

import pytest

from strandjoin.aligner import run
from strandjoin.operators import index
from strandjoin.operators.policy import route
from strandjoin.operators.search import align
from strandjoin.options import AlignOptions, last_wins
from strandjoin.sources import reads as R
from strandjoin.sources import references, sinks

SMALL = "AGCATCGATCAGTATCTGA"
PAIRED = "AAAACGAAAGCTTTTATAGATGGGG"


def hits(spark, ref, reads, **o):
    o = {"mode": "v", "v": 2, "every": True} | o
    r = run(R.literals(spark, reads), references.literals(spark, ref), AlignOptions(**o))
    return sorted((x["read_id"], x["off"], x["fw"], x["mms"]) for x in sinks.default_rows(r.hits).withColumnRenamed("off0", "off").selectExpr("read_id", "off", "strand = '+' fw", "mms").collect())


@pytest.mark.parametrize(
    ("ref", "reads", "opts", "want"),
    [
        (SMALL, "CATCGATCAGTATCTG", {"v": 0}, [(0, 2)]),
        (SMALL, "CATCGATCAGTATCTG:IIIIIIIIIIIIIIII", {"v": 0}, [(0, 2)]),
        (SMALL, "CATCGATCAGTATCTG", {"v": 0, "trim3": 4, "reverse": False}, [(0, 2)]),
        (SMALL, "CATCGATCAGTATCTG", {"v": 0, "trim5": 16}, []),
        (SMALL, "CATCGATCAGTATCTG", {"v": 0, "skip": 1}, []),
        (SMALL, "CATCGATCAGTATCTG,ATCGATCAGTATCTG", {"v": 0}, [(0, 2), (1, 3)]),
        (SMALL, "CATCGATCAGTATCTG", {"mode": "n"}, [(0, 2)]),
        ("TTGTTCGTTTGTTCGT", "TTGTTCGT", {"v": 0, "m": 2}, [(0, 0), (0, 8)]),
        ("TTGTTCGTTTGTTCGTTTGTTCGT", "TTGTTCGT", {"v": 0, "m": 2}, []),
        ("ACGTTCGT", "GTTC", {"v": 0}, [(0, 2)]),
        ("ACGTNCGT", "GTNCG", {"v": 3}, []),
    ],
)
def test_single(spark, ref, reads, opts, want):
    assert [x[:2] for x in hits(spark, ref, reads, **opts)] == want


def test_edits(spark):
    assert hits(spark, "TTGCCCGT", "TTGTTCGT") == [(0, 0, True, "3:C>T,4:C>T")]
    assert hits(spark, "TTGTTCGT", "ACGGGCAA") == [(0, 0, False, "3:T>C,4:T>C")]


@pytest.mark.parametrize(
    ("mates", "opts", "want"),
    [
        (("AACGAAAG", "CCATCTA"), {"v": 0}, [(2, 16)]),
        (("AACGAAAG", "CCATCTA"), {"mode": "n", "n": 0}, [(2, 16)]),
        (("AACGAAAG", "TATAAAA"), {"v": 0}, [(2, 11)]),
        (("AACGAAAG", "AAAGCTT"), {"v": 0}, [(2, 7)]),
        (("AACGAAAG", "CTTTCGT"), {"v": 0}, []),
        (("AACGAAAG", "CTTTCGT"), {"v": 0, "allow_contain": True}, [(2, 3)]),
        (("AACGAAAG", "CTTTCGTT"), {"v": 0, "allow_contain": True}, [(2, 2)]),
        (("AACGAAAG", "CTTTCGTT"), {"v": 0, "allow_contain": True, "m": 1}, [(2, 2)]),
        (("AACGAAAG", "AACGAAAG"), {"v": 0, "allow_contain": True, "orientation": "ff", "m": 1}, [(2, 2)]),
        (("AACGAAAG", "AACGATAG"), {"v": 1, "allow_contain": True, "orientation": "ff", "m": 1}, [(2, 2)]),
    ],
)
def test_pairs(spark, mates, opts, want):
    reads = R.pairs(R.literals(spark, mates[0]), R.literals(spark, mates[1]))
    r = run(reads, references.literals(spark, PAIRED), AlignOptions(**({"mode": "v", "every": True} | opts)))
    got = [(x["a"], x["b"]) for x in r.mates.groupBy("read_id", "pair_rank").agg({"off": "min"}).withColumnRenamed("min(off)", "a").join(r.mates.groupBy("read_id", "pair_rank").agg({"off": "max"}).withColumnRenamed("max(off)", "b"), ["read_id", "pair_rank"]).collect()]
    assert sorted(got) == want


@pytest.mark.parametrize(
    ("orientation", "off", "want"),
    [("fr", "reverse", [1]), ("fr", "forward", [2]), ("rf", "reverse", [1]), ("rf", "forward", [2]), ("ff", "reverse", [1]), ("ff", "forward", [2])],
)
def test_pairs_without_a_strand(spark, orientation, off, want):
    """A strand left out is an orientation of the pair: pair 1 lies as the option says, pair 2 is its reverse complement."""
    ref = "ACGGTCATTGCACCAGTTACAGGATCCAATCGGATATCGC"
    a, b = ref[2:14], ref[24:38]
    turn = {"fr": (a, revcomp(b)), "rf": (revcomp(a), b), "ff": (a, b)}[orientation]
    back = {"fr": (revcomp(b), a), "rf": (b, revcomp(a)), "ff": (revcomp(b), revcomp(a))}[orientation]
    one, two = (",".join(x) for x in zip(turn, back, strict=True))
    reads = R.pairs(R.literals(spark, one), R.literals(spark, two))
    both = run(reads, references.literals(spark, ref), AlignOptions(mode="v", v=0, every=True, orientation=orientation))
    assert {x["read_id"] for x in both.mates.collect()} == {0, 1}
    some = run(reads, references.literals(spark, ref), AlignOptions(mode="v", v=0, every=True, orientation=orientation, **{off: False}))
    assert {x["read_id"] + 1 for x in some.mates.collect()} == set(want)


def test_singletons_and_mixed_input(spark, tmp_path):
    tab = tmp_path / "m.tab"
    tab.write_text("p\tAACGAAAG\tIIIIIIII\tCCATCTA\tIIIIIII\nq\tAACGAAAG\tIIIIIIII\tGGGGGGGGG\tIIIIIIIII\nu\tCTTTTATA\tIIIIIIII\nn\tCCCCCCCCC\tIIIIIIIII\n")
    reads = R.tabbed(spark, str(tab))
    o = {"mode": "v", "v": 0, "every": True}
    r = run(reads, references.literals(spark, PAIRED), AlignOptions(**o))
    assert sorted((x["name"], x["mate"], x["off"]) for x in r.mates.collect()) == [("p", 1, 2), ("p", 2, 16)]
    assert [(x["name"], x["off"]) for x in r.hits.collect()] == [("u", 10)]
    assert {x["read_id"]: x["status"] for x in r.states.collect()} == {0: "aligned", 1: "unaligned", 2: "aligned", 3: "unaligned"}
    r = run(reads, references.literals(spark, PAIRED), AlignOptions(report_singles=True, **o))
    assert sorted((x["name"], x["mate"], x["off"]) for x in r.hits.collect()) == [("q", 1, 2), ("u", 0, 10)]
    c = r.counters().first()
    assert (c["processed"], c["aligned"], c["failed"]) == (4, 3, 1)
    lines = sorted(x["line"] for x in sinks.sam_lines(sinks.sam_unaligned(reads, run(reads, references.literals(spark, PAIRED), AlignOptions(**o)).states)).collect())
    assert lines == sorted(["q\t77\t*\t0\t0\t*\t*\t0\t0\tAACGAAAG\tIIIIIIII\tXM:i:0", "q\t141\t*\t0\t0\t*\t*\t0\t0\tGGGGGGGGG\tIIIIIIIII\tXM:i:0", "n\t4\t*\t0\t0\t*\t*\t0\t0\tCCCCCCCCC\tIIIIIIIII\tXM:i:0"])
    out = {k: str(tmp_path / f"{k}.txt") for k in ("al", "un", "max")}
    sinks.write_routed(route(r.reads, r.states), out)
    text = lambda p: sorted(x["value"] for x in spark.read.text(p).collect())
    assert text(sinks.with_mate(out["al"], 1)) == text(sinks.with_mate(out["al"], 2)) and len(text(sinks.with_mate(out["al"], 1))) == 2
    assert text(out["al"]) == ["u\tCTTTTATA\tIIIIIIII"] and text(out["un"]) == ["n\tCCCCCCCCC\tIIIIIIIII"]
    assert sinks.counter_lines({"processed": 4, "aligned": 3, "pct_aligned": 75.0, "failed": 1, "pct_failed": 25.0, "suppressed": 0, "pct_suppressed": 0.0, "reported": 3}) == ["# reads processed: 4", "# reads with at least one alignment: 3 (75.00%)", "# reads that failed to align: 1 (25.00%)", "Reported 3 alignments"]
    row = {"processed": 4, "aligned": 3, "pct_aligned": 75.0, "failed": 1, "pct_failed": 25.0, "suppressed": 0, "pct_suppressed": 0.0, "reported": 3}
    assert sinks.counter_lines(row, pairs=1, singles=2)[-1] == "Reported 1 paired-end alignments and 2 singleton alignments"
    assert sinks.hadoop_lines(row, 2, 1)[-2:] == ["reporter:counter:Strandjoin,Unpaired alignments reported,2", "reporter:counter:Strandjoin,Paired alignments reported,2"]


def test_pair_sam(spark):
    reads = R.pairs(R.literals(spark, "AACGAAAG"), R.literals(spark, "CCATCTA"))
    r = run(reads, references.literals(spark, PAIRED), AlignOptions(mode="v", v=0))
    lines = [x["line"] for x in sinks.sam_lines(sinks.sam_records(r.mates)).orderBy("mate").collect()]
    assert lines == ["0\t99\t0\t3\t255\t8M\t=\t17\t21\tAACGAAAG\tIIIIIIII\tXA:i:0\tMD:Z:8\tNM:i:0", "0\t147\t0\t17\t255\t7M\t=\t3\t-21\tTAGATGG\tIIIIIII\tXA:i:0\tMD:Z:7\tNM:i:0"]


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(refs, reads, o):
    out = set()
    rnd = lambda q: min(30, (q + 5) // 10 * 10) if o.rounding else q
    for i, (s, q) in enumerate(reads):
        if len(s) < o.shortest:
            continue
        for fw in (True, False):
            p, pq = (s, q) if fw else (revcomp(s), q[::-1])
            n = len(p) if o.mode == "v" else min(o.seed_len, len(p))
            for r, ref in enumerate(refs):
                for off in range(len(ref) - len(p) + 1):
                    w = ref[off : off + len(p)]
                    if "N" in w:
                        continue
                    bad = [k for k in range(len(p)) if p[k] != w[k] or p[k] == "N"]
                    stratum = sum((k if fw else len(p) - 1 - k) < n for k in bad)
                    cost = sum(rnd(ord(pq[k]) - 33) for k in bad)
                    if stratum <= o.budget and (o.mode == "v" or cost <= o.max_penalty):
                        out.add((i, fw, r, off, stratum, cost))
    return out


@pytest.mark.parametrize("case", range(8))
def test_random_against_brute_force(spark, case, tmp_path):
    rng = random.Random(case)
    refs = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(20, 300))) for _ in range(3)]
    reads = []
    for _ in range(25):
        r = rng.choice(refs)
        at, n = rng.randrange(len(r) - 8), rng.randint(6, 38)
        s = list(r[at : at + n])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        s = "".join(s)
        s = s if rng.random() < 0.5 else revcomp(s)
        reads.append((s, "".join(chr(33 + rng.randint(2, 40)) for _ in s)))
    o = AlignOptions(mode="v", v=case % 4) if case < 4 else AlignOptions(mode="n", n=case % 4, seed_len=rng.randint(8, 30), max_penalty=rng.randint(40, 160), rounding=case % 2 == 0)
    ref = references.literals(spark, refs)
    df = spark.createDataFrame([(i, 0, str(i), s, q, s, 0, 0) for i, (s, q) in enumerate(reads)], "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int")
    found = [tuple(x) for x in align(df, ref, o).select("read_id", "fw", "ref_id", "off", "stratum", "penalty").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(refs, reads, o)
    if case in (2, 7):
        index.build(ref, str(tmp_path / "idx"))
        found = [tuple(x) for most in (0, 10**9) for x in align(df, index.load(spark, str(tmp_path / "idx")), o, most).select("read_id", "fw", "ref_id", "off", "stratum", "penalty").collect()]
        assert sorted(found) == sorted([*brute(refs, reads, o)] * 2)
    if case in (1, 6):
        found = [tuple(x) for x in align(df, ref, o, max_broadcast=0).select("read_id", "fw", "ref_id", "off", "stratum", "penalty").collect()]
        assert sorted(found) == sorted(brute(refs, reads, o))


LADDER = [("-", 148810, 2), ("-", 2852852, 1), ("-", 4930433, 2), ("-", 905664, 2), ("+", 1093035, 2)]


def test_policy_ladder(spark):
    from strandjoin.operators.policy import report

    d = spark.createDataFrame([(0, 0, s == "+", 0, off, n, 30 * n, str(off)) for s, off, n in LADDER], "read_id long, mate int, fw boolean, ref_id long, off long, stratum int, penalty int, window string")
    get = lambda **o: [r["off"] for r in report(d, AlignOptions(mode="v", **o)).orderBy("rank").collect()]
    assert sorted(get(every=True)) == sorted(x[1] for x in LADDER)
    assert get(every=True, best=True, strata=True) == [2852852]
    assert len(get(k=3)) == 3
    assert get(every=True, m=3) == []
    assert len(get(every=True, m=5)) == 5
    assert get(every=True, m=3, best=True, strata=True) == [2852852]
    one = report(d, AlignOptions(mode="v", every=True, sample_m=3)).collect()
    assert [(r["off"], r["mapq"], r["oms"]) for r in one] == [(2852852, 0, 3)]


@pytest.mark.parametrize("flags", [[("v", 4)], [("v", -1)], [("n", 4)], [("n", -10)], [("v", 2), ("n", 4)], [("3", -3)], [("5", -1)], [("e", -1)], [("l", 4)], [("l", 0)]])
def test_rejected_options(flags):
    with pytest.raises(ValueError):
        last_wins(flags)


def test_accepted_options():
    for f, x in itertools.product("nv", range(4)):
        assert last_wins([(f, x)]).budget == x
    assert last_wins([("v", 3), ("n", 3)]).mode == "n"


def test_packed_words(spark):
    """Any offset, length and counted part against characters; windows with N or past the end are broken."""
    from pyspark.sql import functions as F

    from strandjoin.functions import sequence as S

    rng = random.Random(8)
    text = "".join(rng.choice("ACGTACGTACGTACGTACGTACGTACGTN") for _ in range(500))
    rows = []
    for i in range(300):
        n, at = rng.randint(1, 90), rng.randrange(500)
        r = list((text[at : at + n] + "A" * n)[:n])
        for _ in range(rng.randrange(5)):
            r[rng.randrange(n)] = rng.choice("ACGTN")
        low = rng.randrange(n)
        rows.append((i, text, "".join(r), at, low, rng.randint(1, n - low)))
    d = spark.createDataFrame(rows, "i int, text string, read string, at long, low int, n int")
    words, ns = S.packed_words("text")
    flag = lambda x, n: F.repeat(F.lit(x), n)
    counted = F.concat(flag("A", F.col("low")), flag("C", F.col("n")))
    d = d.withColumns({"words": words, "ns": ns, "r": S.packed_words("read")[0], "rn": S.flag_words(F.translate("read", "ACGTN", "AAAAC")), "counted": S.flag_words(counted), "inside": S.flag_words(flag("C", F.length("read")))})
    wrong, broken = S.packed_compare(*[F.col(c) for c in ("words", "ns", "at", "r", "rn", "counted", "inside")], 3)
    for x in d.select("*", wrong.alias("wrong"), broken.alias("broken")).collect():
        window = text[x["at"] : x["at"] + len(x["read"])]
        assert x["broken"] == ("N" in window or len(window) < len(x["read"]))
        if not x["broken"]:
            part = range(x["low"], x["low"] + x["n"])
            assert x["wrong"] == sum(window[k] != x["read"][k] or x["read"][k] == "N" for k in part)


def test_few_keys_are_looked_up_in_tiles(spark, tmp_path):
    """An index without k-mers: placements over a tile's end, beside an N and at both ends, as by shuffled k-mers; no row of a k-mer is shuffled."""
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(4096)) + "N" + "".join(rng.choice("ACGT") for _ in range(4200)), "ACGT" * 40, "A", ""]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    path = f"{tmp_path}/tiles"
    index.build(refs, path, only_tiles=True)
    i = index.load(spark, path)
    assert not i.meta["kmers"] and [tuple(r) for r in i.refs.select("ref_id", "len").orderBy("ref_id").collect()] == [(k, len(s)) for k, s in enumerate(seqs)]
    texts = [s[at : at + n] for s, at, n in ((seqs[0], 0, 36), (seqs[0], 4060, 36), (seqs[0], 4070, 36), (seqs[0], 4097, 36), (seqs[0], 8180, 36), (seqs[0], 8000, 297), (seqs[0], len(seqs[0]) - 36, 36), (seqs[1], 1, 36), (seqs[1], 1, 200))]
    rows = [(k, 0, f"r{k}", s, "I" * len(s), s, 0, 0) for k, s in enumerate(texts)]
    reads = spark.createDataFrame(rows, "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int")
    for part in (reads.filter("length(seq) < 40"), reads):  # compared packed, and as text
        o = AlignOptions(mode="v", v=1, every=True)
        shown = lambda d: sorted(str(r) for r in d.collect())
        found = align(part, i, o)
        assert len(shown(found)) > 30 and shown(found) == shown(align(part, i, o, max_broadcast=-1))
    assert "kmers" not in str(found._jdf.queryExecution().optimizedPlan())
