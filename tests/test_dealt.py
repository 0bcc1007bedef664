"""Columns dealt out over parts, against the rows themselves."""

import random

import numpy as np
import pyarrow as pa

from strandjoin.operators import joined
from strandjoin.sources import dealt, references


def test_packed():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 1 << 57, 1000), np.full(1000, 7), rng.integers(-300, 300, 1000), rng.integers(0, 1 << 20, 1000)]
    for x, y in zip(cols, dealt.unpacked(dealt.packed(cols))):
        assert (x == y).all()


def test_ranges_of_keys():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 3, 500) for _ in range(3)]
    bounds = np.array(sorted(tuple(int(c[k]) for c in keys) for k in rng.choice(500, 9)))
    got = dealt.by_bounds(bounds)(keys)
    assert got.tolist() == [sum(tuple(b) <= key for b in bounds.tolist()) for key in zip(*(c.tolist() for c in keys))]


def test_parts_and_passes(spark, monkeypatch):
    """Every row is settled once, in its part, in several passes over the input."""
    monkeypatch.setattr(dealt, "PART", 100)
    monkeypatch.setattr(dealt, "PASS", 700)
    d = spark.range(0, 5000, 1, 3).selectExpr("id * 7919 % 5003 AS k", "id")

    def make(batches):
        for b in batches:
            yield [b.column("k").to_numpy(), b.column("id").to_numpy()]

    def settle(part, cols):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), part)), *map(pa.array, cols)], ["part", "k", "id"])

    part_of, parts = dealt.ranges(d, make, 1, 5000)
    assert 40 <= parts <= 50
    rows = dealt.settled(d, make, part_of, parts, settle, "part long, k long, id long", "dealt").collect()
    assert sorted((r["k"], r["id"]) for r in rows) == sorted((r["k"], r["id"]) for r in d.collect())
    by = sorted((r["k"], r["part"]) for r in rows)
    assert [p for _, p in by] == sorted(p for _, p in by) and len({p for _, p in by}) == parts
    hashed = dealt.settled(d, make, dealt.by_hash(1, 9), 9, settle, "part long, k long, id long", "dealt").collect()
    assert len(hashed) == 5000 and len({r["part"] for r in hashed}) == 9


def test_suffixes_in_ranges_and_passes(spark, monkeypatch):
    """The order goes on from range to range; patterns are counted alike by all tasks and in a sort with the suffixes."""
    monkeypatch.setattr(dealt, "PART", 200)
    monkeypatch.setattr(dealt, "PASS", 600)
    rng = random.Random(4)
    unit = "".join(rng.choice("ACGT") for _ in range(400))
    seqs = [unit, unit + "A", "A" * 300, "", unit[100:], "".join(rng.choice("ACGTN") for _ in range(700))]
    refs = references.from_table(spark.createDataFrame(list(enumerate(seqs)), "id long, seq string"), "id", "id", "seq")
    sa = joined.suffix_array(refs).orderBy("place").collect()
    want = sorted((s[p:] + "$", i, p) for i, s in enumerate(seqs) for p in range(len(s) + 1))
    assert [(r["place"], r["ref_id"], r["pos"]) for r in sa] == [(k, i, p) for k, (_, i, p) in enumerate(want)]
    patterns = spark.createDataFrame([(x,) for x in ("A", "ACG", unit[:57], unit[-57:], unit[10:40], "A" * 57, "T" * 30, "CN")], "pattern string")
    both = [{r["pattern"]: (r["n"], r["first"] if r["n"] else None) for r in joined.pattern_rows(patterns, refs, few).collect()} for few in (100, 0)]
    assert both[0] == both[1]
    texts = [w for w, _, _ in want]
    for p, (n, first) in both[0].items():
        at = [k for k, w in enumerate(texts) if w.startswith(p)]
        assert p == "CN" or (n, first) == (len(at), at[0] if at else None)
