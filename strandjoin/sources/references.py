"""Reference sequences.

Short ones are rows (ref_id, name, seq, len). Of any length they are tiles: (ref_id, t0, bases),
where a tile owns [t0, t0 + step) and bases also shows what follows, so that a read placed in it is
whole. No row holds more than a tile then, and a chromosome is many tasks' work from the scan on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import first_word, normalise_reference
from .pieces import BLOCK, FILE, PIECE, runs, scanned
from .reads import _finish, _records, existing, pieces
from .storage import running

STEP = 4096
#: Reads are at most so long; a fixed value.
LONGEST_READ = 1024


@dataclass
class Tiled:
    """refs: ref_id, name, len; tiles: ref_id, t0, bases; step bases a tile and what follows, up to `right`."""

    refs: DataFrame
    tiles: DataFrame
    step: int = STEP
    right: int = LONGEST_READ


def _name(named: Column, ref_id: Column) -> Column:
    return F.when(F.coalesce(named, F.lit("")) == "", ref_id.cast("string")).otherwise(named)


def _named(d: DataFrame, n_to_a: bool) -> DataFrame:
    d = d.select(F.col("ref_id").cast("long").alias("ref_id"), _name(F.col("name"), F.col("ref_id")).alias("name"), normalise_reference(F.coalesce("seq", F.lit("")), n_to_a).alias("seq"))
    return d.withColumn("len", F.length("seq").cast("long"))


def fasta(spark: SparkSession, paths: list[str] | str, n_to_a: bool = False) -> DataFrame:
    """References of FASTA files as rows, in order; unnamed ones are named by their place."""
    d = _records(spark, existing(spark, paths))
    return _named(d.select(F.col("ordinal").alias("ref_id"), "name", F.col("body").alias("seq")), n_to_a)


def literals(spark: SparkSession, seqs: str | list[str], n_to_a: bool = False) -> DataFrame:
    items = seqs.split(",") if isinstance(seqs, str) else seqs
    return _named(spark.createDataFrame([(i, None, s) for i, s in enumerate(items)], "ref_id long, name string, seq string"), n_to_a)


def from_table(df: DataFrame, id_col: str, name_col: str, seq_col: str, n_to_a: bool = False) -> DataFrame:
    return _named(df.select(F.col(id_col).alias("ref_id"), F.col(name_col).cast("string").alias("name"), F.col(seq_col).alias("seq")), n_to_a)


def tiled(refs: DataFrame, step: int = STEP, right: int = LONGEST_READ) -> Tiled:
    """Rows as tiles."""
    d = pieces(refs.select("ref_id", "seq"), "seq", step, right)
    return Tiled(refs.select("ref_id", "name", "len"), d.select("ref_id", (F.col("i").cast("long") * step).alias("t0"), F.col("piece").alias("bases")), step, right)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: its headers, and its bases before the first and behind the last of them."""
    now, where, heads, before, behind = None, None, 0, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*where, now, heads, before, behind)], [FILE, BLOCK, PIECE, "heads", "before", "behind"])

    for key, b in runs(batches):
        if key != now:
            if now is not None:
                yield row()
            now, where, heads, before, behind = key, (b.column(FILE)[0].as_py(), b.column(BLOCK)[0].as_py()), 0, 0, 0
        n = b.column("n").to_numpy()
        at = np.flatnonzero(b.column("head").to_numpy(zero_copy_only=False))
        if heads == 0:
            before += int(n[: at[0]].sum() if len(at) else n.sum())
        if len(at):
            heads, behind = heads + len(at), 0
        behind += int(n[at[-1] :].sum() if len(at) else n.sum()) if heads else 0
    if now is not None:
        yield row()


def _stretches(begun: dict[int, tuple[int, int]], step: int):
    """Lines to headers (ref_id, name) and bases in stretches that no tile's end cuts (ref_id, at, bases). begun: by piece the reference that its first line goes on, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ref, at = None, -1, 0
        for key, b in runs(batches):
            if key != now:
                now, (ref, at) = key, begun[key]
            col, names = b.column("bases"), b.column("value")
            heads = np.flatnonzero(b.column("head").to_numpy(zero_copy_only=False)).tolist()
            rows = []
            for a, z in zip([-1, *heads], [*heads, len(col)]):
                if a >= 0:
                    ref, at = ref + 1, 0
                    rows.append((ref, -1, None, names[a].as_py()[1:]))
                text = "".join(col.slice(max(a, 0), z - max(a, 0)).to_pylist()) if ref >= 0 else ""
                k = 0
                while k < len(text):
                    n = min(len(text) - k, step - at % step)
                    rows.append((ref, at, text[k : k + n], None))
                    k, at = k + n, at + n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["ref_id", "at", "bases", "name"])

    return run


def fasta_tiles(spark: SparkSession, paths: list[str] | str, n_to_a: bool = False, step: int = STEP, right: int = LONGEST_READ) -> Tiled:
    """FASTA files as tiles. A first pass counts headers and bases of each piece of the scan, the second gives lines their sequence and offset; stretches of bases are put together by tile in one shuffle."""
    lines = scanned(spark, existing(spark, paths)).withColumn("head", F.col("value").startswith(">"))
    lines = lines.withColumn("bases", F.when(~F.col("head"), normalise_reference("value", n_to_a)).otherwise(F.lit("")))
    measured = lines.select(FILE, BLOCK, PIECE, "head", F.length("bases").cast("long").alias("n"))
    facts = measured.mapInArrow(_facts, f"{FILE} string, {BLOCK} long, {PIECE} long, heads long, before long, behind long").collect()  # a row for each split
    begun, ref, at = {}, -1, 0
    for r in sorted(facts, key=lambda r: (r[FILE], r[BLOCK])):
        begun[r[PIECE]] = (ref, at)
        ref, at = ref + r["heads"], r["behind"] if r["heads"] else at + r["before"]
    rows = lines.select("value", "head", "bases", PIECE).mapInArrow(_stretches(begun, step), "ref_id long, at long, bases string, name string")
    names = rows.filter("at < 0").select("ref_id", F.trim(F.regexp_replace("name", r"\r", "")).alias("name"))
    body = rows.filter("at >= 0").select("ref_id", "at", "bases")
    size = F.length("bases").cast("long")
    lens = body.groupBy("ref_id").agg(F.sum(size).alias("len"))
    refs = names.join(lens, "ref_id", "left").select("ref_id", _name(F.col("name"), F.col("ref_id")).alias("name"), F.coalesce("len", F.lit(0).cast("long")).alias("len"))
    # a piece is in the tiles that own a part of it and in those before that show it
    low = F.greatest(F.floor((F.col("at") - right) / step), F.lit(0))
    parts = body.withColumn("t", F.explode(F.sequence(low, F.floor((F.col("at") + size - 1) / step))))
    parts = parts.groupBy("ref_id", "t").agg(F.array_sort(F.collect_list(F.struct("at", "bases"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["bases"]), "")
    t0 = F.col("t") * step
    begin = F.col("p")[0]["at"]
    tiles = parts.select("ref_id", t0.alias("t0"), begin.alias("begin"), whole.alias("bases")).filter(F.col("begin") + F.length("bases") > F.col("t0"))
    return Tiled(refs, tiles.select("ref_id", "t0", F.substring("bases", (F.col("t0") - F.col("begin") + 1).cast("int"), F.lit(step + right)).alias("bases")), step, right)


def continuous(spark: SparkSession, paths: list[str] | str, width: int, step: int) -> DataFrame:
    """FASTA sequences of any length as reads: windows of `width` every `step` bases, named <first word>_<offset>. Shorter sequences give none.

    Windows are cut from tiles; their places follow from the sequences' lengths, so no window is sorted.
    """
    t = fasta_tiles(spark, paths, step=STEP, right=max(width - 1, 1))
    n = F.when(F.col("len") >= width, F.floor((F.col("len") - width) / step) + 1).otherwise(F.lit(0)).cast("long")
    at = running(t.refs.select("ref_id", first_word("name").alias("word"), n.alias("n")), ["ref_id"], "n", "first")
    d = t.tiles.join(at.filter("n > 0"), "ref_id")
    low = F.ceil(F.col("t0") / step) * step
    high = F.least(F.col("t0") + t.step - 1, F.col("t0") + F.length("bases") - width)
    d = d.filter(low <= high).select("ref_id", "t0", "bases", "word", "first", F.explode(F.sequence(low, high, F.lit(step).cast("long"))).alias("off"))
    name = F.concat_ws("_", "word", F.col("off").cast("string"))
    d = d.select((F.col("first") + F.col("off") / step).cast("long").alias("read_id"), F.lit(0).alias("mate"), name.alias("name"), F.substring("bases", (F.col("off") - F.col("t0") + 1).cast("int"), F.lit(width)).alias("seq"))
    return _finish(d.withColumn("qual", F.lit(None).cast("string")).withColumn("raw", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq"))))


def fragments(refs: DataFrame | Tiled) -> DataFrame:
    """Stretches without N: ref_id, gap (Ns before it), frag_start, frag_len."""
    t = refs if isinstance(refs, Tiled) else tiled(refs, right=0)
    runs = t.tiles.select("ref_id", "t0", F.posexplode(F.regexp_extract_all(F.substring("bases", 1, t.step), F.lit("N+|[ACGT]+"), F.lit(0))).alias("i", "run"))
    runs = runs.select("ref_id", "t0", "i", F.length("run").cast("long").alias("n"), (~F.col("run").startswith("N")).alias("known"))
    order = Window.partitionBy("ref_id").orderBy("t0", "i")
    d = runs.withColumn("start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    # a run that a tile's end cuts goes on in the next tile
    d = d.withColumn("new", F.coalesce(F.lag("known").over(order) != F.col("known"), F.lit(True)).cast("int"))
    d = d.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy("ref_id", "g").agg(F.min("start").alias("frag_start"), F.sum("n").alias("frag_len"), F.first("known").alias("known"))
    gap = F.coalesce(F.lag("frag_len").over(Window.partitionBy("ref_id").orderBy("g")), F.lit(0).cast("long"))
    return d.withColumn("gap", gap).filter("known").select("ref_id", "gap", "frag_start", "frag_len")


def names(refs: DataFrame | Tiled) -> DataFrame:
    return (refs.refs if isinstance(refs, Tiled) else refs).select("ref_id", "name")

