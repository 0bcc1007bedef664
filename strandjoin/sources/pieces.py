"""Text files in the order of their names and bytes, however Spark cuts and deals them.

A piece is what Spark's reader takes of a file as one split; its rows come one after the other in one
task, but pieces are dealt to tasks by size. So rows are placed by piece: a first pass counts what is
in each, the driver adds the counts up in order of file name and offset (a row for each split, of
which it holds the list anyway), and the second pass adds a piece's sum to the places within it.
Spark reads the files, so that any store and codec will do, and nothing is shuffled.

Rows that a piece's end cuts, as records of several lines are, are put together from the first and
last lines of pieces alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

FILE, BLOCK, PIECE = "__file", "__block", "__piece"
#: Splits up to which a piece's sums are broadcast (16 bytes each and what a hash table takes); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def scanned(spark: SparkSession, paths: list[str] | str, sep: str | None = None) -> DataFrame:
    """value, and the file, offset and key of the row's piece. Paths are in the order given, files of a folder or glob by name."""
    out = None
    for i, p in enumerate([paths] if isinstance(paths, str) else paths):
        r = spark.read.option("lineSep", sep) if sep else spark.read
        d = r.text(p).select("value", F.concat(F.lit(f"{i:06d} "), F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
        out = d if out is None else out.unionByName(d)
    return out.withColumn(PIECE, F.xxhash64(FILE, BLOCK))


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """scanned() with line instead of value, without a carriage return at the end."""
    return scanned(spark, paths).withColumn("line", F.regexp_replace("value", r"\r$", "")).drop("value")


def sums(facts: list[dict], *columns: str) -> dict[int, dict[str, int]]:
    """By piece the sums of each column over the pieces before it."""
    at, out = dict.fromkeys(columns, 0), {}
    for r in sorted(facts, key=lambda r: (r[FILE], r[BLOCK])):
        out[r[PIECE]] = dict(at)
        for c in columns:
            at[c] += r[c]
    return out


def with_values(d: DataFrame, values: dict[int, int], name: str) -> DataFrame:
    """d with a number by piece."""
    if len(values) == 1:
        return d.withColumn(name, F.lit(next(iter(values.values()))).cast("long"))
    side = d.sparkSession.createDataFrame(list(values.items()), f"{PIECE} long, {name} long")
    return d.join(F.broadcast(side) if len(values) <= MOST_BROADCAST else side, PIECE)


def with_ordinal(d: DataFrame, name: str = "ordinal") -> DataFrame:
    """d, rows of a scan, with the place of each row, from 0, in the order of file names and offsets instead of its piece."""
    d = d.withColumn("__id", F.monotonically_increasing_id())
    facts = d.groupBy(PIECE, FILE, BLOCK).agg(F.min("__id").alias("first"), F.count("*").alias("n")).collect()  # a row for each split
    before = sums(facts, "n")
    d = with_values(d, {r[PIECE]: before[r[PIECE]]["n"] - r["first"] for r in facts} or {0: 0}, "__shift")
    return d.withColumn(name, F.col("__id") + F.col("__shift")).drop("__id", "__shift", FILE, BLOCK, PIECE)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches that are of one piece, with its key."""
    for b in batches:
        keys = b.column(PIECE).to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if b.num_rows else []
        for a, z in zip(edges, [*edges[1:], b.num_rows]):
            yield int(keys[a]), b.slice(a, z - a)


def _ends(size: int):
    """A row for each piece: its number of lines, of lines up to the last that isn't blank, and the first and last lines, of which a record of `size` lines can be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where, n, full, head, tail = None, None, 0, 0, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{FILE: where[0], BLOCK: where[1], PIECE: now, "n": n, "full": full, "head": head, "tail": tail}], pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), (PIECE, pa.int64()), ("n", pa.int64()), ("full", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))]))

        for key, b in runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, where, n, full, head, tail = key, (b.column(FILE)[0].as_py(), b.column(BLOCK)[0].as_py()), 0, 0, [], []
            filled = np.flatnonzero(b.column("filled").to_numpy(zero_copy_only=False))
            own = b.column("line")
            head += own.slice(0, max(0, size - 1 - len(head))).to_pylist()
            tail = (tail + own.slice(max(0, len(own) - size + 1)).to_pylist())[-(size - 1) :]
            full = n + int(filled[-1]) + 1 if len(filled) else full
            n += len(own)
        if now is not None:
            yield row()

    return run


def _whole(size: int, at: dict[int, tuple[int, int]]):
    """Records of `size` lines that are in one piece: rec, l0, l1 ... at: by piece its first line's place in the file and the number of the file's first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, first, kept = None, 0, 0, None
        for key, b in runs(batches):
            own = b.column("line")
            if key != now:
                now, (line, first), kept = key, at[key], None
            else:
                own = pa.concat_arrays([kept, own])
            # line is the place of own's first one
            skip = -line % size
            n = max(0, len(own) - skip) // size
            if n:
                take = [own.take(pa.array(np.arange(n) * size + skip + k)) for k in range(size)]
                rec = first + (line + skip) // size + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(rec), *take], ["rec", *(f"l{k}" for k in range(size))])
            used = skip + n * size if len(own) >= skip else 0
            kept, line = own.slice(used), line + used

    return run


def records(spark: SparkSession, paths: list[str] | str, size: int) -> DataFrame:
    """rec (from 0, in the order of files and lines), l0 ... of records of `size` lines; a file's first line begins one. The last of a file may be short (null lines); blank lines at a file's end are none."""
    d = lines(spark, paths)
    scan = d.select("line", FILE, BLOCK, PIECE, (F.col("line") != "").alias("filled"))
    # the first and last lines of pieces, some for each split, stay in the shared folder
    ends = stored(scan.mapInArrow(_ends(size), f"{FILE} string, {BLOCK} long, {PIECE} long, n long, full long, head array<string>, tail array<string>"), "ends")
    facts = [r.asDict() for r in ends.select(FILE, BLOCK, PIECE, "n", "full").collect()]  # a row for each split
    files: dict[str, list[dict]] = {}
    for r in sorted(facts, key=lambda r: (r[FILE], r[BLOCK])):
        files.setdefault(r[FILE], []).append(r)
    at, first = {}, 0
    for f in files.values():
        line = full = 0
        for r in f:
            at[r[PIECE]] = (line, first)
            full = line + r["full"] if r["full"] else full
            line += r["n"]
        first += -(-full // size)
    names = [f"l{k}" for k in range(size)]
    schema = "rec long, " + ", ".join(f"{x} string" for x in names)
    if not at:
        return spark.createDataFrame([], schema)
    whole = d.select("line", PIECE).mapInArrow(_whole(size, at), schema)
    cut = with_values(with_values(ends, {k: v[0] for k, v in at.items()}, "from"), {k: v[1] for k, v in at.items()}, "first")
    line = lambda c, i: F.posexplode(F.transform(c, lambda x, k: F.struct((F.col("from") + i(k)).alias("at"), x.alias("line"))))
    head = cut.select("from", "n", "first", line("head", lambda k: k))
    tail = cut.select("from", "n", "first", F.size("head").alias("h"), line("tail", lambda k: F.col("n") - F.size("tail") + k)).filter(F.col("col.at") - F.col("from") >= F.col("h")).drop("h")
    both = head.unionByName(tail).withColumn("own", F.floor(F.col("col.at") / size))
    both = both.filter((F.col("own") * size < F.col("from")) | ((F.col("own") + 1) * size > F.col("from") + F.col("n")))
    pick = [F.max(F.when(F.col("col.at") % size == k, F.col("col.line"))).alias(x) for k, x in enumerate(names)]
    # records and their files' first number tell records apart
    cut = both.groupBy((F.col("first") + F.col("own")).alias("rec"), "first").agg(*pick).drop("first")
    return whole.unionByName(cut)
