"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import hadoop_path, shared_dir

#: ASCII white space, which is what separates words everywhere in this subpackage; bytes.split() and Java's \s agree on it.
WS = r"[ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark then removes shuffle files as soon as what they were made for is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and lost executors cost nothing. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_table = path
    return out


def release(df: DataFrame) -> None:
    """Removes the table behind a result of materialise(), once all that was made from it is written."""
    p, fs = hadoop_path(df.sparkSession, df._own_table)
    fs.delete(p, True)


def few(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table that is cheap to read, as the side of a join: broadcast if it has at most so many rows, which are counted."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids tell rows apart: integers, none null, none repeated."""
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return False
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(col: Column | str) -> Column:
    """Text as UTF-8 bytes; null as none."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Memo(dict):
    """What make() says of short strings (or bytes), looked up where they have come before; of two generations the older one goes when the newer has `most`.

    Each task has its own: workers outlive tasks, and what one stage remembers would stay in memory while others run.
    """

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self.older = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches that don't depend on each other, a thousand rows at a time, as it makes Python objects of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                if (out := fn(b.slice(k, 1000))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal columns, where null equals null; the columns of on come from left."""
    names = {c: f"__r_{c}" for c in on}
    right = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    cond = None
    for c in on:
        term = left[c].eqNullSafe(right[names[c]])
        cond = term if cond is None else cond & term
    return left.join(right, cond, how).drop(*names.values())
