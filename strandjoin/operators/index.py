"""The reference index: references, fragments, tiles (as text and packed) and k-mers as tables in one folder, which alignment reads, and what can be read off it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import first_word
from ..sources.references import STEP, LONGEST_READ, Tiled, fragments, tiled
from ..sources.storage import ranked
from .search import K, kmers, with_words

TILES = "ref_id long, t0 long, bases string, words array<long>, ns array<long>"
KMERS = "kmer BIGINT, span INT, ref_id BIGINT, pos BIGINT"


@dataclass
class Index(Tiled):
    """An opened index: tiles as they are stored, and its k-mers: the stored ones, bucketed and sorted by k-mer, or made of the tiles where it has none."""

    spark: SparkSession | None = None
    path: str = ""
    meta: dict = field(default_factory=dict)

    def kmers(self) -> DataFrame:
        return self.spark.table(self.meta["table"]) if self.meta["kmers"] else kmers(self)

    def fragments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fragments") if self.meta["fragments"] else fragments(self)


def build(refs: DataFrame | Tiled, path: str, buckets: int | None = None, offrate: int = 5, ftab_chars: int = 10, only_tiles: bool = False) -> None:
    """Writes the index; with only_tiles fragments and k-mers are made of the tiles when they are asked for. k-mers are bucketed by k-mer, so that a join by k-mer shuffles the reads only, and sorted in each bucket.

    offrate and ftab_chars are what inspect's summary and the suffix sample go by.
    """
    t = refs if isinstance(refs, Tiled) else tiled(refs, STEP, LONGEST_READ)
    spark = t.tiles.sparkSession
    kept = f"{path}/tiles"
    with_words(t.tiles.select("ref_id", "t0", "bases")).write.mode("overwrite").parquet(kept)
    t = Tiled(t.refs, spark.read.schema(TILES).parquet(kept), t.step, t.right)
    own = F.col("t0") + F.least(F.length("bases"), F.lit(t.step))
    lens = t.tiles.groupBy("ref_id").agg(F.max(own).cast("long").alias("len"))  # of the tiles: lengths of rows would make each sequence anew
    t.refs.select("ref_id", "name").join(lens, "ref_id", "left").fillna({"len": 0}).write.mode("overwrite").parquet(f"{path}/refs")
    if t.tiles.filter(F.col("bases").rlike("[ACGT]")).isEmpty():
        raise ValueError("no reference has an unambiguous base")
    # the k-mers of two indexes differ, and so do their tables' names
    meta = {"k": K, "tile": t.step, "right": t.right, "offrate": offrate, "ftab_chars": ftab_chars, "table": "strandjoin_kmers_" + hashlib.md5(path.encode()).hexdigest()[:16]}
    meta["buckets"] = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    meta |= {"kmers": False, "fragments": not only_tiles}
    _write_meta(spark, path, meta)
    if not only_tiles:
        fragments(t).write.mode("overwrite").parquet(f"{path}/fragments")
        store_kmers(spark, path)


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def store_kmers(spark: SparkSession, path: str) -> None:
    """Adds the k-mers to an index of tiles, for searches with more keys than are broadcast."""
    t = load(spark, path)
    m = t.meta | {"kmers": True}
    spark.sql(f"DROP TABLE IF EXISTS {m['table']}")
    # a partition is a bucket; adaptive execution cuts one that a hot k-mer swells into several tasks, each of which writes a file of the bucket
    grams = kmers(t).hint("rebalance", m["buckets"], "kmer")
    grams.write.mode("overwrite").format("parquet").bucketBy(m["buckets"], "kmer").sortBy("kmer", "ref_id", "pos").option("path", f"{path}/kmers").saveAsTable(m["table"])
    _write_meta(spark, path, m)


def meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()["value"])


def load(spark: SparkSession, path: str) -> Index:
    """Opens an index; its k-mers become a table of this session's catalog, if they aren't one."""
    m = meta(spark, path)
    if m["kmers"] and not spark.catalog.tableExists(m["table"]):
        spark.sql(f"CREATE TABLE {m['table']} ({KMERS}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer, ref_id, pos) INTO {m['buckets']} BUCKETS LOCATION '{path}/kmers'")
    tiles = spark.read.schema(TILES).parquet(f"{path}/tiles")
    return Index(spark.read.parquet(f"{path}/refs"), tiles, m["tile"], m["right"], spark, path, m)


def sequences(t: Tiled) -> DataFrame:
    """refs (ref_id, name, seq, len) as rows again, for references that fit one."""
    own = F.struct("t0", F.substring("bases", 1, t.step).alias("bases"))
    joined = t.tiles.groupBy("ref_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["bases"]), "")
    return t.refs.join(joined, "ref_id", "left").select("ref_id", "name", F.coalesce(seq, F.lit("")).alias("seq"), "len")


def dump(refs: DataFrame | Tiled, width: int = 60) -> DataFrame:
    """FASTA lines by (ref_id, line_no): the name, then the sequence in lines of `width`; all-gap sequences are left out. A line comes from the tile that it starts in."""
    t = refs if isinstance(refs, Tiled) else tiled(refs, right=width)
    if t.right < width:
        raise ValueError(f"the tiles show {t.right} bases of what follows, a line has {width}")
    has = t.tiles.filter(F.col("bases").rlike("[ACGT]")).select("ref_id").distinct()
    head = t.refs.join(has, "ref_id", "left_semi").select("ref_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit(">"), F.col("name")).alias("line"))
    first = F.ceil(F.col("t0") / width)
    last = F.floor((F.col("t0") + F.least(F.length("bases"), F.lit(t.step)) - 1) / width)
    body = t.tiles.join(has, "ref_id", "left_semi").filter(first <= last).select("ref_id", "t0", "bases", F.explode(F.sequence(first, last)).alias("n"))
    line = F.substring("bases", (F.col("n") * width - F.col("t0") + 1).cast("int"), F.lit(width))
    return head.unionByName(body.select("ref_id", (F.col("n") + 1).alias("line_no"), line.alias("line")))


def summary(refs: DataFrame | Tiled) -> DataFrame:
    """Searchable sequences: sequence (from 1), name, len (bases and inner gaps), bases."""
    t = refs if isinstance(refs, Tiled) else tiled(refs, right=0)
    has = (t.fragments() if isinstance(t, Index) else fragments(t)).groupBy("ref_id").agg(F.sum("frag_len").alias("bases"))
    d = ranked(t.refs.join(has, "ref_id").select("ref_id", first_word("name").alias("name"), "len", "bases"), ["ref_id"], "place")
    return d.select((F.col("place") + 1).alias("sequence"), "name", "len", "bases")


def summary_lines(t: Index) -> DataFrame:
    """n, line: what inspecting an index prints: the suffix sample's rate, the lookup table's width, then each sequence's name and length."""
    m = t.meta
    heads = t.spark.createDataFrame([(0, f"SA-Sample\t1 in {1 << m['offrate']}"), (1, f"FTab-Chars\t{m['ftab_chars']}")], "n long, line string")
    rows = summary(t).select((F.col("sequence") + 1).cast("long").alias("n"), F.concat(F.lit("Sequence-"), F.col("sequence").cast("string"), F.lit("\t"), "name", F.lit("\t"), F.col("len").cast("string")).alias("line"))
    return heads.unionByName(rows)


def prefix_ranges(t: Tiled, width: int, k: int = 12) -> DataFrame:
    """The lookup table of k-mer prefixes: prefix, n and its first and last k-mer, packed."""
    full = kmers(t, k).filter(F.col("span") == k)
    return full.groupBy(F.shiftright("kmer", 2 * (k - width)).alias("prefix")).agg(F.count("*").alias("n"), F.min("kmer").alias("first"), F.max("kmer").alias("last"))
