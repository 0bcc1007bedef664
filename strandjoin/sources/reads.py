"""Read sources. All give read_id, mate, name, seq, qual, raw, trimmed5, trimmed3.

read_id is the place in the source; mate is 0, or 1 and 2 for pairs, which share a read_id.
Compressed files (.gz, .bz2) are read as they are. Several paths follow each other in the order given, the files of
a folder or glob by name, also where Spark splits and deals them otherwise; see pieces.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import default, to_phred33
from ..functions.sequence import first_word, normalise_read, trim
from .pieces import records, scanned, with_ordinal

COLUMNS = ("read_id", "mate", "name", "seq", "qual", "raw", "trimmed5", "trimmed3")


def existing(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """Of the paths those that exist; a warning for others, an error if none does."""
    found = []
    for p in [paths] if isinstance(paths, str) else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            found.append(p)
        else:
            logging.getLogger(__name__).warning("no such input: %s", p)
    if not found:
        raise FileNotFoundError(f"no input exists: {paths}")
    return found


def _finish(rows: DataFrame, scale: str = "phred33", integers: bool = False, checked: bool = True) -> DataFrame:
    """rows: read_id, mate, name (or null), seq, qual (or null), raw."""
    seq = normalise_read("seq")
    d = rows.withColumn("seq", seq)
    d = d.withColumn("qual", F.when(F.col("qual").isNull(), default("seq")).otherwise(to_phred33(F.coalesce("qual", F.lit("")), scale, integers)))
    if checked:
        d = d.withColumn("qual", F.when(F.length("qual") != F.length("seq"), F.raise_error(F.concat(F.lit("qualities and bases differ in number: "), F.coalesce("name", F.lit(""))))).otherwise(F.col("qual")))
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.col("read_id").cast("string")).otherwise(F.col("name"))
    zero = F.lit(0)
    return d.select(F.col("read_id").cast("long").alias("read_id"), F.col("mate").cast("int").alias("mate"), name.alias("name"), "seq", "qual", "raw", zero.alias("trimmed5"), zero.alias("trimmed3"))


def union(sources: list[DataFrame]) -> DataFrame:
    """Sources one after the other, with ids that go on."""
    out, at = None, 0
    for s in sources:
        s_at = s.withColumn("read_id", F.col("read_id") + at)
        out = s_at if out is None else out.unionByName(s_at)
        if s is not sources[-1]:
            last = s.agg(F.max("read_id")).first()[0]
            at += 0 if last is None else last + 1
    return out


def fastq(spark: SparkSession, paths: list[str] | str, scale: str = "phred33", integers: bool = False, interleaved: bool = False) -> DataFrame:
    """Records of four lines; with interleaved, mate 1 and mate 2 alternate."""
    recs = records(spark, existing(spark, paths), 4).filter(F.coalesce("l0", F.lit("")) != "")
    head = F.when(F.col("l0").startswith("@"), F.substring("l0", F.lit(2), F.length("l0"))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("l0"))))
    raw = F.concat_ws("\n", *(F.coalesce(F.col(f"l{k}"), F.lit("")) for k in range(4)))
    mate = (F.col("rec") % 2 + 1) if interleaved else F.lit(0)
    rid = F.floor(F.col("rec") / 2) if interleaved else F.col("rec")
    rows = recs.select(rid.alias("read_id"), mate.alias("mate"), head.alias("name"), F.coalesce("l1", F.lit("")).alias("seq"), F.coalesce("l3", F.lit("")).alias("qual"), raw.alias("raw"))
    return _finish(rows, scale, integers)


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTA records: ordinal, name, body."""
    d = with_ordinal(scanned(spark, paths, "\n>").filter(F.trim("value") != ""))
    text = F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), r"\r", "")
    name = F.substring_index(text, "\n", 1)
    return d.select("ordinal", name.alias("name"), F.substring(text, F.length(name) + 2, F.length(text)).alias("body"), F.concat(F.lit(">"), text).alias("raw"))


def fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One read for each record; qualities are 40."""
    d = _records(spark, existing(spark, paths))
    return _finish(d.select(F.col("ordinal").alias("read_id"), F.lit(0).alias("mate"), "name", F.col("body").alias("seq"), F.lit(None).cast("string").alias("qual"), "raw"))


def pieces(d: DataFrame, seq: str, step: int, right: int = 0) -> DataFrame:
    """d without seq, with a row for each `step` characters of it: i (from 0) and piece, which also shows up to `right` characters of what follows. One walk over seq, however long."""
    others = [c for c in d.columns if c != seq]
    d = d.select(*others, F.regexp_extract_all(F.col(seq), F.lit(f".{{1,{step}}}"), F.lit(0)).alias("__cut"))
    if not right:
        return d.select(*others, F.posexplode("__cut").alias("i", "piece"))
    more = lambda i: F.substring(F.array_join(F.slice("__cut", i + 2, F.lit(-(-right // step))), ""), 1, right)
    return d.select(*others, F.posexplode(F.transform("__cut", lambda x, i: F.concat(x, more(i)))).alias("i", "piece"))


def windows(sequences: DataFrame, width: int, step: int, tile: int = 4096) -> DataFrame:
    """Sliding windows of (seq_id, name, seq): seq_id, name, off, seq. Sequences are cut into overlapping pieces first, so that no window costs more than a piece."""
    inner = -(-max(64, width) // step) * step  # windows are taken from small pieces of the pieces
    tile = -(-max(tile, inner) // inner) * inner
    d = pieces(sequences.filter(F.length("seq") >= width).select("seq_id", "name", "seq"), "seq", tile, width - 1)
    d = d.withColumn("__s", F.explode(F.sequence(F.lit(0), F.least(F.length("piece"), F.lit(tile)) - 1, F.lit(inner))))
    at = (F.col("i").cast("long") * tile + F.col("__s")).alias("__at")
    d = d.select("seq_id", "name", at, F.substring("piece", F.col("__s") + 1, F.lit(inner + width - 1)).alias("__tile")).filter(F.length("__tile") >= width)
    d = d.withColumn("__o", F.explode(F.sequence(F.lit(0), F.least(F.length("__tile") - width, F.lit(inner - 1)), F.lit(step))))
    return d.select("seq_id", "name", (F.col("__at") + F.col("__o")).alias("off"), F.substring("__tile", F.col("__o") + 1, F.lit(width)).alias("seq"))


def raw(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A sequence on each line, named by its place."""
    lines = with_ordinal(scanned(spark, existing(spark, paths)).filter(F.trim("value") != ""))
    value = F.regexp_replace("value", r"\r$", "")
    return _finish(lines.select(F.col("ordinal").alias("read_id"), F.lit(0).alias("mate"), F.lit(None).cast("string").alias("name"), value.alias("seq"), F.lit(None).cast("string").alias("qual"), value.alias("raw")))


def literals(spark: SparkSession, reads: str | list[str], scale: str = "phred33") -> DataFrame:
    """SEQ or SEQ:QUAL, comma-separated."""
    items = [x for x in (reads.split(",") if isinstance(reads, str) else reads)]
    rows = [(i, 0, None, x.partition(":")[0], x.partition(":")[2] if ":" in x else None, x) for i, x in enumerate(items)]
    return _finish(spark.createDataFrame(rows, "read_id long, mate int, name string, seq string, qual string, raw string"), scale)


def tabbed(spark: SparkSession, paths: list[str] | str, scale: str = "phred33", integers: bool = False) -> DataFrame:
    """Lines of three fields are unpaired, of five a pair; both may be mixed."""
    lines = scanned(spark, existing(spark, paths)).withColumn("line", F.regexp_replace("value", r"\r$", "")).filter(F.trim("line") != "")
    d = with_ordinal(lines.drop("value")).withColumn("f", F.split("line", "\t"))
    n = F.size("f")
    mate = lambda m, s, q: F.struct(F.lit(m).alias("mate"), F.col("f")[s].alias("seq"), F.col("f")[q].alias("qual"))
    both = F.when(n == 3, F.array(mate(0, 1, 2))).when(n == 5, F.array(mate(1, 1, 2), mate(2, 3, 4))).otherwise(F.raise_error(F.concat(F.lit("neither 3 nor 5 fields: "), F.col("line"))))
    d = d.withColumn("m", F.explode(both))
    return _finish(d.select(F.col("ordinal").alias("read_id"), "m.mate", F.col("f")[0].alias("name"), "m.seq", "m.qual", F.col("line").alias("raw")), scale, integers)


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources read in step; different numbers of reads are an error."""
    a, b = first.withColumn("mate", F.lit(1)), second.withColumn("mate", F.lit(2))
    both = a.unionByName(b)
    n = both.agg(F.sum((F.col("mate") == 1).cast("long")).alias("a"), F.sum((F.col("mate") == 2).cast("long")).alias("b")).first()
    if n["a"] != n["b"]:
        raise ValueError(f"{n['a']} first mates and {n['b']} second mates")
    return both


def quality_records(spark: SparkSession, paths: list[str] | str, mate: int = 0) -> DataFrame:
    """A file of qualities beside a FASTA file: records of a name line and lines of integers. read_id, mate, name, qual."""
    d = _records(spark, existing(spark, paths))
    qual = F.trim(F.regexp_replace("body", r"\s+", " "))
    return d.select(F.col("ordinal").alias("read_id"), F.lit(mate).alias("mate"), "name", qual.alias("qual"))


def with_qualities(reads: DataFrame, quals: DataFrame, scale: str = "phred33", integers: bool = True) -> DataFrame:
    """Reads with the qualities of another source (read_id, mate, qual)."""
    d = reads.drop("qual").join(quals.select("read_id", "mate", "qual"), ["read_id", "mate"], "left")
    out = _finish(d.select("read_id", "mate", "name", "seq", "qual", "raw"), scale, integers)
    return out


def select(reads: DataFrame, skip: int = 0, upto: int | None = None) -> DataFrame:
    """Without the first `skip` reads, and at most `upto` after those; by place, so that the choice is stable."""
    kept: Column = F.col("read_id") >= skip
    return reads.filter(kept if upto is None else kept & (F.col("read_id") < skip + upto))


def trimmed(reads: DataFrame, five: int = 0, three: int = 0) -> DataFrame:
    """Bases cut from both ends; how many were is recorded."""
    if not five and not three:
        return reads
    n5 = F.least(F.length("seq"), F.lit(five))
    n3 = F.least(F.length("seq") - n5, F.lit(three))
    return reads.select("read_id", "mate", "name", trim("seq", five, three).alias("seq"), trim("qual", five, three).alias("qual"), "raw", (F.col("trimmed5") + n5).alias("trimmed5"), (F.col("trimmed3") + n3).alias("trimmed3"))
