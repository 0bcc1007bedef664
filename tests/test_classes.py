"""Window classes against placements one by one."""

import random

import pytest
from pyspark.sql import functions as F

from strandjoin.operators import analysis, classes, policy
from strandjoin.operators.search import align
from strandjoin.options import AlignOptions
from strandjoin.sources import references

READS = "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int"
WIDTH = 20


def made(spark, seed, n=60):
    """References in which a unit, a run of one base and near copies repeat, with N, and one too short for a window; and reads of them."""
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(60))
    near = "".join(rng.choice("ACGT") if rng.random() < 0.05 else b for b in unit)
    seqs = [unit * 3 + near + unit, "A" * 90 + "N" + unit[:40] + "TT", near + "N" + near[5:], "ACGT" * 12, "ACG", ""]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    rows = []
    for i in range(n):
        s = rng.choice(seqs[:4])
        at = rng.randrange(len(s) - WIDTH)
        r = list(s[at : at + WIDTH])
        for _ in range(rng.randrange(3)):
            r[rng.randrange(WIDTH)] = rng.choice("ACGTN")
        r = "".join(r)
        if i % 2:
            r = r[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((i, 0, f"r{i}", r, "".join(chr(33 + rng.randrange(40)) for _ in r), r, 0, 0))
    return spark.createDataFrame(rows, READS), refs, seqs


@pytest.fixture(scope="module")
def case(spark):
    reads, refs, seqs = made(spark, 1)
    return reads, refs, seqs, classes.build(refs, WIDTH)


COLUMNS = ["read_id", "ref_id", "off", "fw", "stratum", "penalty", "cost", "seq", "qual", "window", "rank", "oms", "n_hits", "sampled", "mapq"]
OPTIONS = [
    {"every": True}, {"every": True, "m": 3}, {"k": 1}, {"k": 4}, {"k": 2, "m": 6}, {"every": True, "best": True, "strata": True},
    {"k": 3, "best": True, "strata": True}, {"every": True, "best": True, "strata": True, "m": 2}, {"k": 1, "v": 0}, {"every": True, "v": 3, "reverse": False},
    {"mode": "n", "n": 1, "seed_len": 12, "max_penalty": 60, "k": 3}, {"mode": "n", "n": 3, "seed_len": 14, "every": True, "forward": False},
]


@pytest.mark.parametrize("opts", OPTIONS, ids=str)
def test_reports_what_placements_do(case, opts):
    reads, refs, _, c = case
    o = AlignOptions(**({"mode": "v", "v": 2} | opts))
    shown = lambda d: sorted(tuple(r) for r in d.select(*COLUMNS).collect())
    hits = classes.found(reads, c, o)
    want = align(reads, refs, o)
    assert shown(classes.expanded(classes.chosen(hits, o), c, o)) == shown(policy.report(want, o))
    states = lambda d: sorted(tuple(r) for r in d.collect())
    assert states(classes.status(reads, hits, o)) == states(policy.status(reads, want, o))


def test_keys_too_large_to_broadcast(case):
    reads, _, _, c = case
    o = AlignOptions(mode="v", v=1, every=True)
    rows = lambda d: sorted(str(r) for r in d.collect())
    assert rows(classes.found(reads, c, o, max_bytes=0)) == rows(classes.found(reads, c, o))


@pytest.mark.parametrize("opts", [{"v": 2}, {"v": 3, "reverse": False}, {"mode": "n", "n": 1, "seed_len": 13, "max_penalty": 60}], ids=str)
def test_wider_keys_find_the_same(case, opts):
    reads, _, _, c = case
    o = AlignOptions(**({"mode": "v", "every": True} | opts))
    rows = lambda exact: sorted(str(r) for r in classes.found(reads, c, o, exact=exact).collect())
    one = rows(1)
    assert one and len(set(one)) == len(one) and rows(2) == one == rows(3)


def test_keys_by_the_number_of_texts():
    assert classes.family(36, 2, 1_800_000) == (3, 1) and classes.family(36, 2, 18_000_000) == (4, 2)
    assert classes.family(36, 0, 10**12) == (1, 1) and classes.family(28, 2, 3 * 10**9)[1] > 1
    assert classes.family(4, 3, 100) in ((4, 1),)
    for texts in (10**6, 10**8, 3 * 10**9):
        blocks, exact = classes.family(36, 2, texts)
        assert classes.comb(blocks, exact) * texts <= 4 ** (36 // blocks * exact)


def test_fewer_rows_than_placements(case):
    """Over a limit nothing is expanded, and what is counted is a row a class."""
    reads, refs, _, c = case
    o = AlignOptions(mode="v", v=2, every=True, m=3)
    hits = classes.found(reads, c, o)
    n = hits.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert n["n"] == align(reads, refs, o).count() and n["rows"] * 2 < n["n"]
    assert classes.chosen(hits, o).agg(F.sum("takes")).first()[0] == policy.report(align(reads, refs, o), o).count()


def test_samples_over_the_limit(case):
    """One of the best stratum's placements, each in turn by seed; the others as they are."""
    reads, refs, _, c = case
    places, drawn = {}, {}
    for seed in range(12):
        o = AlignOptions(mode="v", v=1, k=1, sample_m=2, seed=seed)
        want = align(reads, refs, o)
        least = {r[0]: r[1] for r in want.groupBy("read_id").agg(F.min("stratum")).collect()} if not places else least
        places = places or {k: {tuple(r)[1:] for r in g} for k, g in _by_read(want.select("read_id", "ref_id", "off", "fw", "stratum").collect())}
        got = classes.expanded(classes.chosen(classes.found(reads, c, o), o), c, o).select("read_id", "ref_id", "off", "fw", "stratum", "sampled", "oms", "mapq").collect()
        assert sorted(r["read_id"] for r in got) == sorted(places)
        for r in got:
            assert tuple(r)[1:5] in places[r["read_id"]] and r["stratum"] == least[r["read_id"]]
            assert r["sampled"] == (len(places[r["read_id"]]) > 2) and (not r["sampled"] or (r["oms"], r["mapq"]) == (2, 0))
            if r["sampled"]:
                drawn.setdefault(r["read_id"], set()).add(tuple(r)[1:4])
    assert sum(len(x) for x in drawn.values()) > 4 * len(drawn)


def _by_read(rows):
    out = {}
    for r in rows:
        out.setdefault(r["read_id"], []).append(r)
    return out.items()


def test_reads_of_another_width(spark, case):
    _, _, _, c = case
    reads = spark.createDataFrame([(0, 0, "a", "ACGTACGT", "IIIIIIII", "", 0, 0)], READS)
    with pytest.raises(ValueError, match="20 bases"):
        classes.found(reads, c, AlignOptions(mode="v", v=1, every=True))
    none = classes.found(reads.limit(0), c, AlignOptions(mode="v", v=1, every=True))
    assert none.count() == 0


def placed(seqs, opts):
    """How many placements each window has, by comparing all with all."""
    turned = str.maketrans("ACGT", "TGCA")
    known = [(s[i : i + WIDTH]) for s in seqs for i in range(len(s) - WIDTH + 1) if "N" not in s[i : i + WIDTH]]
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) <= opts.v
    out, seen = {}, {}
    for r, s in enumerate(seqs):
        for i in range(len(s) - WIDTH + 1):
            w = s[i : i + WIDTH]
            if w not in seen:
                probes = [w] * opts.forward + [w[::-1].translate(turned)] * opts.reverse
                seen[w] = sum(near(p, x) for p in probes for x in known)
            out[r, i] = seen[w] == 1
    return out, seen


@pytest.mark.parametrize("opts", [{"v": 1}, {"v": 0}, {"v": 2}, {"v": 1, "reverse": False}], ids=str)
def test_mapability_against_all_pairs(spark, opts):
    rng = random.Random(3)
    _, _, seqs = made(spark, 2)
    # half a sequence turned, a palindrome, and near copies of windows with N
    tail = "".join(rng.choice("ACGT") for _ in range(70))
    seqs = [*seqs, tail + "N" + tail[::-1].translate(str.maketrans("ACGT", "TGCA"))[:33], "ACGTTGCAATTGCAACGTAC" + tail[:15] + "G" + tail[16:40]]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    o = AlignOptions(**({"mode": "v", "every": True} | opts))
    want, hits = placed(seqs, o)
    c = classes.build(refs, WIDTH)
    assert {(r["ref_id"], r["off"]): r["mapable"] for r in classes.mapable(refs, c, o).collect()} == want
    got = {r["window"]: r["hits"] for r in classes.counts(refs, c, o).collect()}
    assert {w: n for w, n in hits.items() if w.count("N") <= o.v} == {w: n for w, n in got.items() if w in hits}
    covering = {(r["ref_id"], r["off"]): r["covering"] for r in analysis.mapability(refs, WIDTH, o).collect()}
    assert covering == {(r, i): sum(want.get((r, j), False) for j in range(i - WIDTH + 1, i + 1)) for r, s in enumerate(seqs) for i in range(len(s))}


def test_no_window(spark):
    refs = references.from_table(spark.createDataFrame([(0, "ACG"), (1, ""), (2, "N" * 30)], "id long, seq string"), "id", "id", "seq")
    c = classes.build(refs, WIDTH)
    o = AlignOptions(mode="v", v=1, every=True)
    assert c.table.count() == 0
    assert [tuple(r) for r in classes.mapable(refs, c, o).orderBy("off").collect()] == [(2, i, False) for i in range(11)]


@pytest.mark.parametrize("opts", [{"every": True, "m": 3}, {"k": 1, "sample_m": 2}, {"mode": "n", "n": 1, "seed_len": 12, "max_penalty": 60, "k": 3}], ids=str)
def test_classes_of_few_reads(case, opts):
    """Of the windows that keys find alone: fewer classes, the same reports."""
    reads, refs, _, c = case
    reads = reads.filter("read_id < 12")
    o = AlignOptions(**({"mode": "v", "v": 2} | opts))
    own = classes.build(refs, WIDTH, reads, o)
    assert 0 < own.table.count() < c.table.count()
    shown = lambda c: sorted(tuple(r) for r in classes.expanded(classes.chosen(classes.found(reads, c, o), o), c, o).select(*COLUMNS).collect())
    assert shown(own) == shown(c) != []
    assert classes.build(refs, WIDTH, reads.limit(0), o).table.isEmpty()


@pytest.mark.parametrize("width", [7, 24, 36, 45])
def test_near_counts_by_packed_rows(spark, width):
    """Rows of blocks are numbers, of an even width for half the blocks, and say the same as all pairs; so do windows of more than one word and of odd widths."""
    rng = random.Random(width)
    unit = "".join(rng.choice("ACGT") for _ in range(60))
    near = [unit[:i] + rng.choice("ACGTN") + unit[i + 1 :] for i in (3, 20, 30, 41, 59)]
    turned = unit.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    seqs = [unit, *near, turned, turned[:25] + "C" + turned[26:], "AC" * 30]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    c = classes.build(refs, width)
    rc = lambda w: w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    windows = [s[i : i + width] for s in seqs for i in range(len(s) - width + 1)]
    texts = [t for w in windows if "N" not in w for t in (w, rc(w))]
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = {w: sum(differ(w, t) <= 1 for t in texts) for w in windows if w.count("N") <= 1}
    got = {r["window"]: r["hits"] for r in classes.near_counts(refs, c).collect()}
    assert {w: n for w, n in got.items() if w in want} == want
    d = spark.createDataFrame([("A" * width, 1)], "window string, m long")
    rows = d.mapInArrow(classes._without_blocks(width), ", ".join(f"{r} long" for r in classes._rest_names(width)) + ", part int, m long")
    assert rows.count() == -(-(width if width % 2 else width // 2) // classes.BLOCK)


def test_classes_over_several_ranges(spark, monkeypatch):
    """Ranges are cut within classes, too: texts, counts and places are those of the windows in order."""
    monkeypatch.setattr(classes.dealt, "PART", 40)
    monkeypatch.setattr(classes.dealt, "PASS", 160)
    _, refs, seqs = made(spark, 5)
    c = classes.build(refs, WIDTH)
    rows = sorted((s[o : o + WIDTH], r, o) for r, s in enumerate(seqs) for o in range(len(s) - WIDTH + 1) if "N" not in s[o : o + WIDTH])
    want = {}
    for k, (w, _, _) in enumerate(rows):
        n, first = want.get(w, (0, k))
        want[w] = (n + 1, first)
    assert max(n for n, _ in want.values()) > 60
    assert sorted((r["window"], r["n"], r["first"]) for r in c.table.collect()) == sorted((w, *x) for w, x in want.items())
    assert [(r["ref_id"], r["off"]) for r in c.places.orderBy("place").collect()] == [(r, o) for _, r, o in rows]
