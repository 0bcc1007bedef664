"""Pairs from one mate's placements, against all pairs of both mates' placements."""

import random
from dataclasses import replace

import pytest

from strandjoin.operators import rescue
from strandjoin.operators.pairs import concordant
from strandjoin.operators.search import align
from strandjoin.options import AlignOptions
from strandjoin.sources import references

READS = "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int"
TURN = str.maketrans("ACGT", "TGCA")
COLUMNS = ["read_id", "ref_id", "m1_off", "m2_off", "first", "insert", "m1_stratum", "m2_stratum"]


def made(spark, seed, orientation, wrong):
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(240))
    seqs = [unit + "".join(rng.choice("ACGT") for _ in range(120)), "".join(rng.choice("ACGTN") for _ in range(200)) + unit, unit[:60]]
    turns = {"fr": (False, True), "rf": (True, False), "ff": (False, False)}[orientation]
    rows = []
    for i in range(40):
        s = rng.choice(seqs[:2])
        at = rng.randrange(len(s) - 90)
        gap = rng.randrange(25, 66)
        two = [s[at : at + 22], s[at + gap : at + gap + 24]]
        if i % 3 == 0:  # the other strand
            two = [x.translate(TURN)[::-1] for x in two[::-1]]
        for m, (x, turn) in enumerate(zip(two, turns)):
            x = list(x.translate(TURN)[::-1] if turn else x)
            for _ in range(rng.randrange(wrong[m] + 1)):
                x[rng.randrange(len(x))] = rng.choice("ACGT")
            rows.append((i, m + 1, f"p{i}", "".join(x), "I" * len(x), "".join(x), 0, 0))
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    return spark.createDataFrame(rows, READS), references.tiled(refs, step=64, right=40)


def shown(d):
    return sorted(tuple(r) for r in d.select(*COLUMNS).collect())


@pytest.mark.parametrize("orientation", ["fr", "rf", "ff"])
def test_the_same_pairs(spark, orientation):
    reads, tiles = made(spark, 1, orientation, (1, 1))
    o = AlignOptions(mode="v", v=1, every=True, orientation=orientation, min_insert=20, max_insert=80)
    want = shown(concordant(align(reads, tiles, o), o))
    assert want and shown(rescue.paired(reads, tiles, o)) == want


def test_more_mismatches_beside(spark):
    """The other mate may have three, of which keys for one mismatch would miss some."""
    reads, tiles = made(spark, 2, "fr", (0, 3))
    o = AlignOptions(mode="v", v=0, every=True, min_insert=20, max_insert=80)
    loose = replace(o, v=3)
    rare = {(r["read_id"], r["mate"]) for r in rescue.anchors(reads, tiles, o).collect()}
    every = concordant(align(reads, tiles, loose), loose).collect()
    want = sorted(tuple(r[c] for c in COLUMNS) for r in every if r[f"m{1 if (r['read_id'], 1) in rare else 2}_stratum"] == 0)
    assert any(r[6] + r[7] > 1 for r in want)
    assert shown(rescue.paired(reads, tiles, o, loose)) == want


def test_nothing_to_place(spark):
    reads, tiles = made(spark, 3, "fr", (0, 0))
    o = AlignOptions(mode="v", v=0, every=True, max_insert=80)
    assert rescue.paired(reads.limit(0), tiles, o).count() == 0
