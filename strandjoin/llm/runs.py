"""Streaming over the runs of equal keys of a range-partitioned, sorted table.

Rows are range-partitioned by (key, order), so that a key with a third of all rows spreads over
several partitions; each partition is streamed once, and what a run in several partitions adds up
to is set right from a summary of two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, partitions


def _streamer(n_min: int, first_col: str | None):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: pa.Table | None = None
        # the open run: its key, how many of its rows have been given out, its first value, and whether it is the partition's first
        key, gone, first, head = (0, 0), 0, None, True

        def emit(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            """What can be given out of t, and what has to wait until more of its last run is known."""
            nonlocal key, gone, first, head
            n, k1, k2 = t.num_rows, t["k1"].to_numpy(), t["k2"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1])
            before = gone if gone and key == (k1[0], k2[0]) else 0
            if gone and not before:
                head = False
            lens = np.diff(np.append(starts, n))
            own, lens[0] = int(lens[0]), lens[0] + before
            cut = n if last or lens[-1] >= n_min else int(starts[-1])
            if not cut:
                return [], t
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            edge = np.zeros(n, np.int32)
            if head:
                edge[run == 0] |= 1
            if last:
                edge[run == run[-1]] |= 2
            t = t.append_column("run_big", pa.array((lens >= n_min)[run])).append_column("run_edge", pa.array(edge)).append_column("run_pid", pa.array(np.full(n, pid, np.int32)))
            if first_col:
                values = t[first_col].combine_chunks().take(pa.array(starts[run]))
                if before:
                    values = pa.concat_arrays([pa.array([first] * own, values.type), values.slice(own)])
                t = t.append_column("run_first", values)
                first = values[cut - 1].as_py()
            key, gone, head = (k1[cut - 1], k2[cut - 1]), int(lens[run[cut - 1]]), head and run[cut - 1] == 0
            return t.slice(0, cut).to_batches(), t.slice(cut).select(range(t.num_columns - 3 - bool(first_col))) if cut < n else None

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows > 1:  # the partition's last row is known only at its end, so one always waits
                out, rest = emit(held.slice(0, held.num_rows - 1), False)
                yield from out
                wait = held.slice(held.num_rows - 1)
                held = wait if rest is None else pa.concat_tables([rest, wait])
        if held is not None:
            yield from emit(held, True)[0]

    return stream


def key_runs(rows: DataFrame, order: list[str], n_min: int = 2, first_col: str | None = None, name: str = "runs", descending: bool = False, distinct: bool = False, only_big: bool = False) -> DataFrame:
    """rows (k1 long, k2 long, ...): adds run_big (the key has at least n_min rows) and, with first_col, run_first (its value in the key's first row).

    With only_big, rows of other keys are left out. With distinct, rows equal in key and order count once. Nulls in order come first, or last if descending. Empty tables give empty results.
    """
    spark = rows.sparkSession
    by = [F.col("k1"), F.col("k2"), *[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(partitions(spark), *by)
    if distinct:  # needs no further exchange
        dealt = dealt.dropDuplicates(["k1", "k2", *order])
    dealt = dealt.sortWithinPartitions(*by)
    schema = T.StructType([*rows.schema.fields, T.StructField("run_big", T.BooleanType()), T.StructField("run_edge", T.IntegerType()), T.StructField("run_pid", T.IntegerType())])
    if first_col:
        schema.add("run_first", rows.schema[first_col].dataType)
    out = dealt.mapInArrow(_streamer(n_min, first_col), schema)
    out = materialise(out.filter("run_big OR run_edge > 0") if only_big else out, name)
    # at most two runs of each partition touch its ends
    agg = [F.count("*").alias("n"), F.max("run_big").alias("big"), (F.first("run_first") if first_col else F.lit(None)).alias("f")]
    ends = out.filter("run_edge > 0").groupBy("run_pid", "k1", "k2").agg(*agg).collect()
    total: dict[tuple[int, int], list] = {}
    for r in sorted(ends, key=lambda r: r["run_pid"]):
        total.setdefault((r["k1"], r["k2"]), [0, r["f"]])[0] += n_min if r["big"] else r["n"]
    fix_type = T.StructType([T.StructField("f_k1", T.LongType()), T.StructField("f_k2", T.LongType()), T.StructField("f_n", T.LongType()), T.StructField("f_first", rows.schema[first_col].dataType if first_col else T.LongType())])
    fix = spark.createDataFrame([(k[0], k[1], n, f) for k, (n, f) in total.items()], fix_type)
    on = (out["k1"] == fix["f_k1"]) & (out["k2"] == fix["f_k2"]) & (out["run_edge"] > 0)
    done = out.join(F.broadcast(fix), on, "left").withColumn("run_big", F.col("run_big") | F.coalesce(F.col("f_n") >= n_min, F.lit(False)))
    if first_col:
        done = done.withColumn("run_first", F.when(F.col("f_n").isNotNull(), F.col("f_first")).otherwise(F.col("run_first")))
    if only_big:
        done = done.filter("run_big")
    done = done.drop("f_k1", "f_k2", "f_n", "f_first", "run_edge", "run_pid")
    done._own_table = out._own_table
    return done
