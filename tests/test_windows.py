"""Equal windows by packed words, against their texts."""

import random
from collections import Counter

import pytest

from strandjoin.operators import analysis, windows
from strandjoin.sources import dealt, references


def rc(w):
    return w.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.mark.parametrize("width", [6, 31, 36, 70])
def test_windows_that_occur_once(spark, width, monkeypatch):
    """In several parts and passes, over tiles' ends, with palindromes, N, short and empty references."""
    monkeypatch.setattr(dealt, "PART", 300)
    monkeypatch.setattr(dealt, "PASS", 900)
    monkeypatch.setattr(analysis, "TILE", 90)
    rng = random.Random(width)
    unit = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = [unit + "N" + unit[:90], rc(unit[50:150]) + "ACGT" * 20, "", "AC", "".join(rng.choice("ACGT") for _ in range(500)), unit[:40] + rc(unit[:40]), "N" * 80]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    t = references.tiled(refs, step=64, right=100)
    own = [(r, o, s[o : o + width]) for r, s in enumerate(seqs) for o in range(len(s) - width + 1)]
    n = Counter(x for _, _, w in own if "N" not in w for x in (w, rc(w)))
    want = {(r, o): "N" not in w and n[w] == 1 for r, o, w in own}
    got = {(r["ref_id"], r["off"]): (r["mapable"], r["covering"]) for r in analysis.mapability(t, width).collect()}
    assert got == {(r, i): (want.get((r, i), False), sum(want.get((r, j), False) for j in range(i - width + 1, i + 1))) for r, s in enumerate(seqs) for i in range(len(s))}
    text = {}
    for r in analysis.mapability_symbols(t, width).orderBy("ref_id", "t").collect():
        text[r["ref_id"]] = text.get(r["ref_id"], "") + r["symbols"]
    assert text == {r: "".join(chr(64 + got[r, i][1]) for i in range(len(s))) for r, s in enumerate(seqs) if s}
    forms = Counter(x.replace("C", "T") for _, _, w in own if "N" not in w for x in (w, rc(w)))
    found = Counter()
    for r in analysis.bisulfite_mapability(t, width).collect():
        found[r["ref_id"], "all"] += r["windows"]
        found[r["ref_id"], "once"] += r["mapable"]
    known = [(r, w) for r, _, w in own if "N" not in w]
    assert +found == Counter((r, "all") for r, _ in known) + Counter((r, "once") for r, w in known if forms[w.replace("C", "T")] == 1)
