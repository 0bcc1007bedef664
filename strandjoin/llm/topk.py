"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors and queries fall to the nearest of at most `pivots` distinct pivots, which are chosen by a
hash among the vectors. Two small tables sum the cells up: for data how many, the radius around the
pivot and the k + 1 smallest distances to it; for queries how many and their radius. With them each
group of queries gets, of scores alone,

* a floor: for x in cell j and any query q of group i, q.x is at least
  p_i.p_j - |p_i| d(x) - r_i |p_j| - r_i d(x); the k-th largest of these over all cells' nearest
  vectors is reached by k candidates of every query, and
* for each cell a ceiling, p_i.p_j + |p_i| R_j + r_i |p_j| + r_i R_j.

A cell is sent to a group only where its ceiling isn't under the group's floor. A group's task then
has the queries' own k best so far, takes the cells by decreasing ceiling, and multiplies a block only
for queries whose own ceiling q.p_j + |q| R_j reaches their k-th best. Bounds are made wider by more
than rounding can take away, and scores are integers, so nothing is lost; vectors that lie in all
directions alike leave the bounds little to cut, and then all cells go to all groups.

A group has at most about GROUP queries (larger ones are dealt out by a hash) and sees at most about
SLICE vectors in one task (more are dealt into slices, whose best are merged by a window), so no task
holds a cell, a group or a list of candidates whole. Bounds are of the size of the pivots' number
squared, in bits, which `pivots` limits.

Components are made integers by `scale`. Vectors that are null or hold a null or a component that
isn't finite take no part. An empty vector scores 0 with all; a shorter vector is as if zeros
followed. A query isn't its own candidate: rows with its id aren't. Null ids are candidates, after all
others where scores tie, and never queries. Rows that repeat are candidates each, and queries each.
Further columns are ignored, whatever their names. Empty tables give no rows. Scores have to fit a
LONG.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

GROUP, SLICE = 1024, 1 << 18
LAST = np.iinfo(np.int64).max
RESULT = "query_id long, rank int, vec_id long, score long"
BLOCK = "grp int, part int, slice int, place long, kind int, cell int, ids binary, keys binary, vectors binary"


@dataclass
class Cells:
    """pivots: a row each; for the data and queries of each cell how many there are and their radius; needed[i, j]: group i of queries needs cell j; rank[i, j]: the place of cell j by decreasing ceiling."""

    pivots: np.ndarray
    data_n: np.ndarray | None = None
    data_r: np.ndarray | None = None
    query_n: np.ndarray | None = None
    query_r: np.ndarray | None = None
    needed: np.ndarray | None = None
    rank: np.ndarray | None = None


def scaled(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (floor(scale * component) as doubles) and asked, whether it is a query; only whole vectors."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    whole = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    asked = F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), asked.alias("asked"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, with zeros behind the shorter ones."""
    offsets = np.asarray(col.offsets)
    flat = np.asarray(col.values.slice(0, offsets[-1]) if len(offsets) else [], dtype=np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def choose_pivots(vectors: DataFrame, most: int, width: int) -> np.ndarray:
    """At most so many distinct vectors, those with the smallest hashes; one row at least."""
    d = vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most)
    rows = d.collect()  # bounded by `most`
    out = np.zeros((max(1, len(rows)), width))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return out


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and its distance to the pivot."""
    square = (pivots * pivots).sum(1)
    cell = np.empty(len(m), dtype=np.int32)
    for k in range(0, len(m), 2048):
        cell[k : k + 2048] = (square - 2 * m[k : k + 2048] @ pivots.T).argmin(1)
    return cell, np.sqrt(((m - pivots[cell]) ** 2).sum(1))


def _summaries(vectors: DataFrame, pivots, width: int, k: int) -> dict:
    """What bounds are made of, by cell: a row for each cell and task, with k + 1 distances at most, and of them one for each cell."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        n, r = np.zeros((2, len(p)), dtype=np.int64), np.zeros((2, len(p)))
        near: dict[int, np.ndarray] = {}
        for b in batches:
            cell, dist = nearest(_matrix(b.column("v"), width), p)
            asked = np.asarray(b.column("asked").to_numpy(zero_copy_only=False), dtype=bool)
            for side, own in ((0, slice(None)), (1, asked)):
                n[side] += np.bincount(cell[own], minlength=len(p))
                np.maximum.at(r[side], cell[own], dist[own])
            order = np.lexsort((dist, cell))
            cell, dist = cell[order], dist[order]
            at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for a, z in zip(at, [*at[1:], len(cell)]):
                j = int(cell[a])
                near[j] = np.sort(np.r_[near.get(j, np.empty(0)), dist[a : min(z, a + k + 1)]])[: k + 1]
        rows = [(j, int(n[0, j]), float(r[0, j]), int(n[1, j]), float(r[1, j]), near.get(j, np.empty(0)).tolist()) for j in range(len(p)) if n[0, j]]
        yield pa.RecordBatch.from_pylist([dict(zip(("cell", "n", "r", "asked", "asked_r", "near"), x)) for x in rows], pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("r", pa.float64()), ("asked", pa.int64()), ("asked_r", pa.float64()), ("near", pa.list_(pa.float64()))]))

    parts = vectors.select("v", "asked").mapInArrow(of, "cell int, n long, r double, asked long, asked_r double, near array<double>")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
    sums = [f(c).alias(c) for f, c in ((F.sum, "n"), (F.max, "r"), (F.sum, "asked"), (F.max, "asked_r"))]
    # in two steps, so that no task gets the distances of all tasks
    some = parts.groupBy("cell", F.pmod(F.spark_partition_id(), F.lit(256)).alias("p")).agg(*sums, least)
    return {r["cell"]: r for r in some.groupBy("cell").agg(*sums, least).collect()}  # a row for each pivot


def bounds(pivots: np.ndarray, found: dict, k: int) -> Cells:
    """The cells' summaries with what each group of queries needs."""
    n = len(pivots)
    col = lambda name, kind: np.array([found[j][name] if j in found else 0 for j in range(n)], dtype=kind)
    c = Cells(pivots, col("n", np.int64), col("r", np.float64), col("asked", np.int64), col("asked_r", np.float64))
    dot, size = pivots @ pivots.T, np.sqrt((pivots * pivots).sum(1))
    slack = lambda x: 1 + 1e-9 * np.abs(x)  # noqa: E731  wider than rounding
    around = c.query_r[:, None] * size[None, :]
    reach = size[:, None] + c.query_r[:, None]
    ceiling = dot + reach * c.data_r[None, :] + around
    ceiling += slack(ceiling)
    c.rank = np.argsort(np.argsort(-ceiling, axis=1), axis=1).astype(np.int32)
    owner = np.concatenate([np.full(len(found[j]["near"]), j) for j in sorted(found)]) if found else np.empty(0, dtype=np.int64)
    dist = np.concatenate([np.asarray(found[j]["near"]) for j in sorted(found)]) if found else np.empty(0)
    c.needed = np.zeros((n, n), dtype=bool)
    for i in np.flatnonzero(c.query_n):
        low = dot[i, owner] - around[i, owner] - reach[i, 0] * dist
        # one of the k + 1 may be the query itself
        floor = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k else -np.inf
        c.needed[i] = (c.data_n > 0) & (ceiling[i] >= floor - slack(floor)) if np.isfinite(floor) else c.data_n > 0
    return c


def _blocks(cells, width: int, parts: np.ndarray, slices: np.ndarray):
    """Rows to packed blocks: queries to the task groups of their own group, data to those of all groups that need their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                yield from _of(b.slice(k, 4096), cells.value)

    def _of(b: pa.RecordBatch, c: Cells) -> Iterator[pa.RecordBatch]:
        ids = b.column("id").fill_null(LAST).to_numpy().astype(np.int64)
        keys = b.column("key").to_numpy().astype(np.int64)
        asked = np.asarray(b.column("asked").to_numpy(zero_copy_only=False), dtype=bool)
        m = _matrix(b.column("v"), width)
        cell, _ = nearest(m, c.pivots)
        hashed = (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))).view(np.uint64) >> np.uint64(33)
        rows = []
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]]) if len(order) else []
        for a, z in zip(edges, [*edges[1:], len(order)]):
            own = order[a:z]
            j = int(cell[own[0]])
            small = np.abs(m[own]).max(initial=0) < 2**15
            vectors = (b"s" + m[own].astype("<i2").tobytes()) if small else (b"d" + m[own].tobytes())
            at = int(hashed[own[0]])
            for i in np.flatnonzero(c.needed[:, j]):
                s = at % int(slices[i])
                rows += [(int(i), p, s, int(c.rank[i, j]), 1, j, ids[own].tobytes(), b"", vectors) for p in range(int(parts[i]))]
            q = own[asked[own]]
            for p in range(int(parts[j])) if len(q) else ():
                mine = q[hashed[q] % np.uint64(parts[j]) == p]
                if len(mine):
                    rows += [(j, p, s, -1, 0, j, ids[mine].tobytes(), keys[mine].tobytes(), b"d" + m[mine].tobytes()) for s in range(int(slices[j]))]
        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 3
        for k in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 256]), kinds)], names)

    return run


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    kind, body = raw[:1], raw[1:]
    n = len(body) // ((2 if kind == b"s" else 8) * width) if width else 0
    return np.frombuffer(body, dtype="<i2" if kind == b"s" else np.float64).astype(np.float64).reshape(n, width)


class _Group:
    """The queries of a task group, each with its k best so far."""

    def __init__(self, k: int, pivots: np.ndarray, radius: np.ndarray):
        self.k, self.pivots, self.radius = k, pivots, radius
        self.ids, self.keys, self.m, self.scores, self.found = [], [], [], None, None

    def start(self) -> None:
        self.ids, self.keys, self.m = np.concatenate(self.ids), np.concatenate(self.keys), np.concatenate(self.m)
        self.norm = np.sqrt((self.m * self.m).sum(1))
        self.near = self.m @ self.pivots.T
        self.exact = float(np.abs(self.m).sum(1).max(initial=0))
        shape = (len(self.ids), self.k)
        self.scores, self.found = np.full(shape, np.iinfo(np.int64).min), np.full(shape, LAST)
        self.n = np.zeros(len(self.ids), dtype=np.int64)

    def add(self, cell: int, ids: np.ndarray, m: np.ndarray) -> None:
        ceiling = self.near[:, cell] + self.norm * self.radius[cell]
        ceiling += 1 + 1e-9 * np.abs(ceiling)
        open_ = np.flatnonzero((self.n < self.k) | (ceiling >= self.scores[:, -1]))
        for a in range(0, len(open_), 256):
            self._best(open_[a : a + 256], ids, m)

    def _best(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        q = self.m[rows]
        if self.exact * float(np.abs(m).max(initial=0)) < 2**53:
            s = (q @ m.T).astype(np.int64)
        else:  # products that doubles can't hold
            s = q.astype(np.int64) @ m.astype(np.int64).T
        valid = ids[None, :] != self.ids[rows][:, None]
        for x, r in enumerate(rows):  # only candidates that reach the k-th best are looked at
            c = np.flatnonzero(valid[x] & ((s[x] >= self.scores[r, -1]) if self.n[r] >= self.k else True))
            if len(c) == 0:
                continue
            n = int(self.n[r])
            score, who = np.r_[self.scores[r, :n], s[x, c]], np.r_[self.found[r, :n], ids[c]]
            if len(score) > self.k:
                least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                near = score >= least
                score, who = score[near], who[near]
            best = np.lexsort((who, -score))[: self.k]
            self.n[r] = len(best)
            self.scores[r, : len(best)], self.found[r, : len(best)] = score[best], who[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 4096):
            part = slice(a, a + 4096)
            held = np.arange(self.k)[None, :] < self.n[part, None]
            who = self.found[part][held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(x[part], self.n[part])) for x in (self.keys, self.ids)] + [pa.array(who, mask=who == LAST), pa.array(self.scores[part][held])], ["key", "query_id", "vec_id", "score"]
            )


def _solve(cells, width: int, k: int):
    """Sorted blocks of task groups to each query's k best among what the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, key, group = cells.value, None, None
        for b in batches:
            for x in b.select(["grp", "part", "slice", "kind", "cell", "ids", "keys", "vectors"]).to_pylist():
                if (now := (x["grp"], x["part"], x["slice"])) != key:
                    if group is not None and group.scores is not None:
                        yield from group.rows()
                    key, group = now, _Group(k, c.pivots, c.data_r)
                ids, m = np.frombuffer(x["ids"], dtype=np.int64), _unpacked(x["vectors"], width)
                if len(m) < len(ids):  # vectors without components
                    m = np.zeros((len(ids), width))
                if x["kind"] == 0:
                    group.ids.append(ids), group.keys.append(np.frombuffer(x["keys"], dtype=np.int64)), group.m.append(m)
                elif group.ids is not None and len(group.ids):
                    if group.scores is None:
                        group.start()
                    group.add(x["cell"], ids, m)
        if group is not None and group.scores is not None:
            yield from group.rows()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query the k rows of highest integer inner product, all if there are fewer; ties go to the smaller id."""
    spark = vectors.sparkSession
    d = scaled(vectors, is_query, id_col, vec_col, scale)
    facts = d.agg(F.max(F.size("v")).alias("width"), F.sum(F.col("asked").cast("long")).alias("asked")).first()
    if not facts["asked"]:
        return spark.createDataFrame([], RESULT)
    width = max(1, facts["width"])
    # about half a group of queries for each cell
    p = choose_pivots(d, int(min(pivots, max(16, facts["asked"] // (GROUP // 2)))), width)
    sc = spark.sparkContext
    found = _summaries(d, sc.broadcast(p), width, k)
    c = bounds(p, found, k)
    parts = np.maximum(1, -(-c.query_n // GROUP))
    slices = np.maximum(1, -(-(c.needed * c.data_n[None, :]).sum(1) // SLICE))
    cells = sc.broadcast(c)
    blocks = d.withColumn("key", F.monotonically_increasing_id()).mapInArrow(_blocks(cells, width, parts, slices), BLOCK)
    blocks = blocks.repartition(partitions(spark), "grp", "part", "slice").sortWithinPartitions("grp", "part", "slice", "kind", "place")
    best = blocks.mapInArrow(_solve(cells, width, k), "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
