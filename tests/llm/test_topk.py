"""op13: exact top-k against brute force; bounds, parts and slices; edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandjoin.llm import topk
from strandjoin.llm.topk import bounds, nearest, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, asked, k, scale=64):
    """(query_id, rank, vec_id, score), for rows of (id, vector)."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q is not None and asked(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in whole if i != q)
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=5, **more):
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in top_k(d, F.col("vec_id") % 5 == 0, k=k, **more).collect()), key=str)


def clustered(rng, n, dim, clusters, spread):
    mids = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, spread) for x in mids[rng.randrange(clusters)]]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_brute_force(spark, spread):
    rows = clustered(random.Random(3), 400, 8, 12, spread)
    assert searched(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_groups_and_slices(spark, monkeypatch):
    """The same where groups of queries and what a task sees are small, with a vector that a third of all rows repeat."""
    rng = random.Random(4)
    rows = clustered(rng, 300, 6, 5, 0.3)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    monkeypatch.setattr(topk, "GROUP", 7)
    monkeypatch.setattr(topk, "SLICE", 50)
    assert searched(spark, rows, pivots=9) == brute(rows, lambda q: q % 5 == 0, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [None, 1.0]), (15, [nan, 1.0]), (20, [inf, 1.0]), (25, []), (30, [0.5]), (None, [3.0, 3.0]), (None, [-0.01, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (35, [1.0, 2.0, 3.0])]
    assert searched(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_ties_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(12)]
    got = searched(spark, rows, k=3)
    assert got == brute(rows, lambda q: q % 5 == 0, 3)
    assert len(searched(spark, rows[:3], k=20)) == 2
    assert searched(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0])]) == []


def test_repeated_ids(spark):
    """Rows that share the query's id aren't its candidates; each asks."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.5])]
    assert searched(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_large_components(spark):
    """Scores that doubles don't hold."""
    rows = [(i, [float(3_000_000 + i), float(40_000_000 - 3 * i), 1.0]) for i in range(40)]
    assert searched(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_bounds_hold_and_cut():
    """No needed cell is left out; of tight clusters far apart most are."""
    rng = np.random.default_rng(5)
    mids = rng.normal(size=(20, 16)) * 100
    m = np.round(mids[rng.integers(20, size=2000)] + rng.normal(size=(2000, 16)))
    cell, dist = nearest(m, mids)
    asked = np.arange(2000) % 20 == 0
    k = 5
    found = {}
    for j in range(20):
        own, q = dist[cell == j], dist[(cell == j) & asked]
        found[j] = {"n": len(own), "r": own.max(), "asked": len(q), "asked_r": q.max(initial=0), "near": np.sort(own)[: k + 1].tolist()}
    c = bounds(mids, found, k)
    scores = m[asked] @ m.T
    for q, s in zip(np.flatnonzero(asked), scores):
        s = s.copy()
        s[q] = -np.inf
        reach = np.sort(s)[-k]
        assert c.needed[cell[q], cell[s >= reach]].all()
    assert c.needed.mean() < 0.3
