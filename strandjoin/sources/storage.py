"""Tables in the folder that driver and executors share, and places of rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session without it, as executors elsewhere wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir has to name a shared folder where the master is {master}")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="shared-"))
    return f"file://{_own_dir[0]}"


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spark then removes shuffle files as soon as what they were made for is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, onto: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back, with the rows of `onto`, a stored() table of the same columns, if given; gone when the driver ends. Rows come back in no order.

    Shuffle files go when the table is written, and numbers are written as differences, which are few bits where rows have an order.
    """
    spark = df.sparkSession
    path = onto._stored_at if onto is not None else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists" if onto is None else "append").option("parquet.writer.version", "v2").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes what stored() wrote for df, once all that was made from it is written."""
    p, fs = hadoop_path(df.sparkSession, df._stored_at)
    fs.delete(p, True)


def with_offsets(df: DataFrame, name: str) -> DataFrame:
    """__id is a row's partition (from bit 33 on) and place there; the place over all partitions takes its stead. A count for each partition comes to the driver."""
    df = df.withColumn("__part", F.shiftright("__id", 33).cast("int"))
    at, offsets = 0, []
    for part, n in sorted(tuple(r) for r in df.groupBy("__part").count().collect()):
        offsets.append((part, at))
        at += n
    own = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    if len(offsets) <= 1:
        return df.withColumn(name, own).drop("__id", "__part")
    off = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __offset long"))
    return df.join(off, "__part").withColumn(name, own + F.col("__offset")).drop("__id", "__part", "__offset")


def ranked(df: DataFrame, by: list[str], name: str, kept: list[str] | None = None) -> DataFrame:
    """df (or kept of its columns) with the place of each row, from 0, in the order of by; a range-partitioned sort.

    Ranges are sampled anew whenever such a plan runs, so places within partitions are written before they are counted.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).select(*(kept or df.columns), F.monotonically_increasing_id().alias("__id"))
    return with_offsets(stored(dealt, "ranked"), name)


def running(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before, in the order of by: sums within the ranges of a range-partitioned sort, and of ranges on the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    d = stored(dealt, "running").withColumn("__part", F.shiftright("__id", 33).cast("int"))
    at, before = 0, []
    for part, total in sorted(tuple(r) for r in d.groupBy("__part").agg(F.sum(value)).collect()):
        before.append((part, at))
        at += total or 0
    order = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(name, F.coalesce(F.sum(value).over(order), F.lit(0).cast("long")))
    off = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long"))
    return d.join(off, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__id", "__part", "__before")
