"""Mixing sources to target weights by weighted fair queueing.

The mix holds `share` of all words. Each source offers its documents in a shuffled order, epoch after
epoch, each shuffled anew, at most max_epochs of them. A document is served in packets of at most
`packet` words; a packet's virtual finish time is the source's cumulative words up to its end divided
by its weight. Packets of all sources are sorted by it over the whole cluster and the mix ends where
their cumulative words reach the budget. That cut alone says what is taken: a source that has no more
to offer leaves its share to the others by weight, and each source's words come within about a packet
of its target. The targets of the result are computed beside it, from the sources' sizes alone; they
only spare the sort those packets that finish far behind the cut.

Places in a source's order and in the mix are running sums over range-partitioned sorts, so that a
source with a third of all rows is many tasks' work; a row for each partition and source comes to the
driver. Null text has no words; such documents are never taken. A null source is a source of its own,
the last. Rows that repeat a doc_id are further documents: those with other texts are shuffled by
their text too, equal ones are neighbours. Long texts are many packets. Columns to carry can have any
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, few, materialise, partitions

def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")).cast("long")


def carried(names: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(f"kept_{c}") for c in names]


def water_fill(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """sources (source, weight, source_size): adds target (double) and level, the common target per weight of the sources that aren't exhausted.

    Each round stops the sources whose share is above max_epochs times their size and shares what they leave by weight; only sums come to the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    full: Column = F.lit(False)
    left, weights, seen = budget, 0, -1
    while True:
        r = sources.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(F.when(full, 1)).alias("n")).first()
        left, weights = budget - (r["c"] or 0), r["w"] or 0
        if not weights or (r["n"] or 0) == seen:
            break
        seen = r["n"] or 0
        full = F.col("weight") * F.lit(left).cast("double") / F.lit(weights) > cap
    if not weights:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(left).cast("double") / F.lit(weights)))


def ranked_weights(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights dealt to the sources by code point order, null last, over and over. One row per source is ranked, not one per document."""
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def _running(by: list[str]):
    """Adds the partition's number and, for the run of equal `by`, the words before each row in the partition. Rows are sorted by `by` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, key, before = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            words = b["words"].to_numpy()
            out = np.cumsum(words) - words
            cols = [b[c].to_numpy() for c in by]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if cols else np.zeros(0, int)
            starts = np.concatenate([[0], new])
            # what ran before in the run of the batch's first row goes on; later runs start anew
            base = np.repeat(out[starts], np.diff(np.append(starts, len(out))))
            out = out - base
            first = tuple(c[0] for c in cols)
            if first == key or not cols:
                out[: starts[1] if len(starts) > 1 else len(out)] += before
            key, before = tuple(c[-1] for c in cols), int(out[-1] + words[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(out)], names=[*b.schema.names, "pid", "before"])

    return run


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with before: the words of the rows of equal `by` (integers) that come earlier in `order`. A range-partitioned sort, written once, and offsets for each partition."""
    spark = rows.sparkSession
    keys = [*by, *order]
    dealt = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    summed = materialise(dealt.mapInArrow(_running(by), T.StructType([*rows.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("before", T.LongType())])), name)
    at: dict[tuple, int] = {}
    offsets = []
    for r in sorted(tuple(r) for r in summed.groupBy("pid", *by).agg(F.sum("words")).collect()):  # a row for each partition and run
        offsets.append((*r[:-1], at.get(r[1:-1], 0)))
        at[r[1:-1]] = at.get(r[1:-1], 0) + r[-1]
    fields = [T.StructField("pid", T.IntegerType()), *[rows.schema[c] for c in by], T.StructField("offset", T.LongType())]
    known = F.broadcast(spark.createDataFrame(offsets, T.StructType(fields)))
    return summed.join(known, ["pid", *by]).withColumn("before", F.col("before") + F.col("offset")).drop("pid", "offset")


def place(docs: DataFrame, weights: DataFrame | None, share: float, max_epochs: int, seed: str, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Documents with row_id, rank (their source's place), size; sources with rank, weight, size and target; the budget."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.substring(F.md5(text), 1, 16).alias("text_hash"), *carried(carry))
    rows = materialise(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix_rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source is ranked, not one for each document
    sizes = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    if weights is None:
        sizes = ranked_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight"))
        sizes = sizes.join(w, sizes["source"].eqNullSafe(w["w_source"]), "left").drop("w_source").fillna({"weight": 0})
    sizes = materialise(sizes, "mix_sources")
    budget = int((sizes.agg(F.sum("source_size")).first()[0] or 0) * share)
    return rows, water_fill(sizes, budget, max_epochs), budget


def queue(rows: DataFrame, sources: DataFrame, budget: int, max_epochs: int, seed: str, packet: int = 64, prune: bool = True) -> DataFrame:
    """The mix as a stream: row_id, epoch, words, finish (virtual time), before (words before it in the mix).

    With prune, packets that surely begin behind the cut are left out before the sorts. At the virtual time to which
    all targets lead (the largest target by weight) plus a packet's at the least weight, a budget has been served.
    """
    s = sources.filter("weight > 0").select(F.col("source").alias("s_source"), "rank", "weight", "source_size", "target")
    d = rows.filter("size > 0").join(few(s), rows["source"].eqNullSafe(F.col("s_source")))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    ahead = F.lit(True)
    if prune:
        r = s.agg(F.max(F.col("target") / F.col("weight")).alias("level"), F.min("weight").alias("w")).first()
        latest = (r["level"] or 0.0) + packet / float(r["w"] or 1) + 1
        ahead = F.col("start") <= F.lit(latest) * F.col("weight")
        d = d.filter(F.col("epoch") * F.col("source_size") <= F.lit(latest) * F.col("weight"))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash"))
    d = d.select("row_id", "doc_id", "rank", "epoch", "weight", "source_size", F.col("size").alias("words"), key.alias("key"))
    d = prefix_sums(d, ["rank", "epoch"], ["key", "row_id"], "mix_order")
    d = d.withColumn("start", F.col("before") + F.col("epoch") * F.col("source_size")).filter(ahead)
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1, F.lit(packet).cast("long"))))
    words = F.least(F.lit(packet).cast("long"), F.col("words") - F.col("p"))
    finish = (F.col("start") + F.col("p") + words) / F.col("weight")
    # finish times of one source differ, so that the order is total
    packets = d.select("row_id", "epoch", "rank", words.alias("words"), finish.alias("finish"))
    served = prefix_sums(packets, [], ["finish", "rank"], "mix_stream").filter(F.col("before") < budget)
    return served.select("row_id", "epoch", F.least(F.col("words"), F.lit(budget) - F.col("before")).alias("words"), "finish", "before")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), packet: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken (words), parts (words served in each epoch that serves it, in order).

    weights: (source, weight) with a row for each source; by default 5, 2, 1 in turn. carry: columns to keep, as kept_<name>.
    """
    rows, sources, budget = place(docs, weights, share, max_epochs, seed, id_col, text_col, source_col, carry)
    stream = queue(rows, sources, budget, max_epochs, seed, packet)
    parts = stream.groupBy("row_id", "epoch").agg(F.sum("words").alias("words"))
    served = parts.groupBy("row_id").agg(F.sum("words").alias("taken"), F.transform(F.array_sort(F.collect_list(F.struct("epoch", "words"))), lambda x: x["words"]).alias("parts"))
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    out = rows.join(few(s), rows["source"].eqNullSafe(s["s_source"])).join(served, "row_id", "left")
    return out.select("doc_id", *[f"kept_{c}" for c in carry], "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("parts", F.array().cast("array<bigint>")).alias("parts"))


def mixed_documents(docs: DataFrame, seed: str = "mix", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, whole and with the columns of docs: a row for each epoch that serves at least half of one."""
    row = "__mix_row"
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix_docs")
    plan = mix(keyed, seed=seed, carry=(row,), text_col=text_col, **options).filter("taken > 0").select(F.col(f"kept_{row}").alias("__plan_row"), F.col("size").alias("__size"), F.explode("parts").alias("__words"))
    plan = plan.filter(2 * F.col("__words") >= F.col("__size")).select("__plan_row")
    return keyed.join(plan, keyed[row] == plan["__plan_row"]).select(*[keyed[c] for c in docs.columns])
