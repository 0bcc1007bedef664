"""Read formats, references, index, sinks and scalar functions."""

import bz2
import gzip
import random as pyrandom
import re

import pytest
from pyspark.sql import functions as F

from strandjoin.functions import quality, random, sequence
from strandjoin.operators import analysis, index, search, suffixes
from strandjoin.plans.registry import QUERIES
from strandjoin.sources import reads as R
from strandjoin.sources import references, sinks
from strandjoin.sources.storage import ranked


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("read_id", "mate").select(*cols).collect()]


def put(tmp_path, name, text):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w", newline="")).write(text)
    return str(p)


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r0 x\r\nAC.GT\r\n+\r\nIIII5\r\n@\r\n\r\n+\r\n\r\n@r2\r\nACGU\r\n+\r\n!!!!\r\n")
    assert rows(R.fastq(spark, p), "read_id", "name", "seq", "qual") == [(0, "r0 x", "ACNGT", "IIII5"), (1, "1", "", ""), (2, "r2", "ACGN", "!!!!")]
    short = put(tmp_path, "b.fq", "@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in number"):
        R.fastq(spark, short).collect()


def test_interleaved_and_gzip(spark, tmp_path):
    p = put(tmp_path, "i.fq.gz", "@a/1\nAC\n+\nII\n@a/2\nGT\n+\nII\n")
    assert rows(R.fastq(spark, p, interleaved=True), "read_id", "mate", "seq") == [(0, 1, "AC"), (0, 2, "GT")]


def test_fasta_raw_tabbed(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">r1\nACG\nT\n>r2 more\nGG\n")
    assert rows(R.fasta(spark, p), "name", "seq", "qual") == [("r1", "ACGT", "IIII"), ("r2 more", "GG", "II")]
    p = put(tmp_path, "a.raw", "ACGT\n\nTT\n")
    assert rows(R.raw(spark, p), "name", "seq") == [("0", "ACGT"), ("1", "TT")]
    p = put(tmp_path, "a.tab", "r0\tAC\tII\nr1\tAC\tII\tGT\tI5\n\n")
    assert rows(R.tabbed(spark, p), "read_id", "mate", "seq", "qual") == [(0, 0, "AC", "II"), (1, 1, "AC", "II"), (1, 2, "GT", "I5")]
    both = R.union([R.raw(spark, str(tmp_path / "a.raw")), R.literals(spark, "AAA,CCC:III")])
    assert rows(both, "read_id", "seq") == [(0, "ACGT"), (1, "TT"), (2, "AAA"), (3, "CCC")]


def test_continuous(spark, tmp_path):
    p = put(tmp_path, "c.fa", ">seq1 x\nAGCATCGATCAGTATCTG\n>seq2\nAGCATCGATCAGTATCTGA\n")
    d = references.continuous(spark, p, 10, 9)
    assert rows(d, "name", "seq") == [("seq1_0", "AGCATCGATC"), ("seq2_0", "AGCATCGATC"), ("seq2_9", "CAGTATCTGA")]
    assert rows(R.select(d, 1, 1), "name") == [("seq2_0",)]
    long = "ACGTTGCAGT" * 900
    w = R.windows(spark.createDataFrame([(0, "s", long)], "seq_id long, name string, seq string"), 36, 7)
    assert [tuple(r) for r in w.orderBy("off").select("off", "seq").collect()] == [(o, long[o : o + 36]) for o in range(0, len(long) - 35, 7)]


def test_missing_and_unequal(spark, tmp_path):
    p = put(tmp_path, "a.raw", "ACGT\n")
    assert R.existing(spark, [p, str(tmp_path / "none")]) == [p]
    with pytest.raises(FileNotFoundError):
        R.existing(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        R.pairs(R.literals(spark, "A,C"), R.literals(spark, "A"))


REFS = ">a\nN\n>a\nNNNATCTAGNN\n>b\nNNN\n>c\nNNNNNN\n>\nNNRNNA\n"


def test_references_round_trip(spark, tmp_path):
    refs = references.fasta(spark, put(tmp_path, "r.fa", REFS))
    assert [tuple(r) for r in refs.orderBy("ref_id").select("name", "seq", "len").collect()] == [("a", "N", 1), ("a", "NNNATCTAGNN", 11), ("b", "NNN", 3), ("c", "NNNNNN", 6), ("4", "NNNNNA", 6)]
    assert sorted(tuple(r) for r in references.fragments(refs).collect()) == [(1, 3, 3, 6), (4, 5, 5, 1)]
    path = str(tmp_path / "idx")
    index.build(refs, path)
    again = index.load(spark, path)
    assert sorted(tuple(r) for r in index.sequences(again).collect()) == sorted(tuple(r) for r in refs.collect())
    assert [r["line"] for r in index.dump(again, 4).orderBy("ref_id", "line_no").collect()] == [">a", "NNNA", "TCTA", "GNN", ">4", "NNNN", "NA"]
    assert [tuple(r) for r in index.summary(again).orderBy("sequence").collect()] == [(1, "a", 11, 6), (2, "4", 6, 1)]
    assert [r["line"] for r in index.summary_lines(again).orderBy("n").collect()] == ["SA-Sample\t1 in 32", "FTab-Chars\t10", "Sequence-1\ta\t11", "Sequence-2\t4\t6"]
    got = {tuple(r) for r in again.kmers().filter("ref_id = 1").select(search.kmer_text(F.col("kmer"), search.K), "span", "pos").collect()}
    assert got == {("ATCTAG"[k:].ljust(search.K, "A"), 6 - k, 3 + k) for k in range(6)}
    spark.sql(f"DROP TABLE {again.meta['table']}")  # as in another session
    assert index.load(spark, path).kmers().count() == 7
    with pytest.raises(ValueError):
        index.build(references.literals(spark, "NNN"), str(tmp_path / "none"))


def test_fasta_tiles_are_the_rows_cut(spark, tmp_path):
    rng = pyrandom.Random(3)
    text = ""
    for k in range(6):
        text += f">s{k} x\n" + "\n".join("".join(rng.choice("ACGTNRacgt-5 ") for _ in range(rng.choice([0, 7, 60, 300]))) for _ in range(rng.randint(0, 40))) + "\n"
    paths = [put(tmp_path, "1.fa", text), put(tmp_path, "2.fa", ">t\n" + "ACGTN" * 50 + "\n>\nA\n")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # headers and lines in different partitions
    try:
        rows = references.fasta(spark, paths)
        whole = references.tiled(rows, 64, 30)
        cut = references.fasta_tiles(spark, paths, step=64, right=30)
        key = lambda d: sorted(tuple(r) for r in d.collect())
        assert key(cut.tiles) == key(whole.tiles)
        assert key(cut.refs.filter("len > 0")) == key(whole.refs.filter("len > 0"))
        want = []
        for r in rows.collect():
            ends = 0
            for m in re.finditer("[ACGT]+", r["seq"]):
                want.append((r["ref_id"], m.start() - ends, m.start(), m.end() - m.start()))
                ends = m.end()
        assert key(references.fragments(cut)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_places_are_dense_over_many_uneven_partitions(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        d = spark.range(300_000).select((F.xxhash64("id") % 50).alias("a"), "id").repartition(13, "a")
        got = ranked(d, ["a", "id"], "place").collect()
        assert sorted(r["place"] for r in got) == list(range(300_000))
        got.sort(key=lambda r: r["place"])
        assert all((x["a"], x["id"]) < (y["a"], y["id"]) for x, y in zip(got, got[1:], strict=False))
        fa = put(tmp_path, "c.fa", "".join(f">s{k}\n{'ACGTT' * (k % 90)}\n" for k in range(900)))
        reads = references.continuous(spark, fa, 12, 2).select("read_id", "name").collect()
        assert sorted(r["read_id"] for r in reads) == list(range(len(reads))) and len({r["name"] for r in reads}) == len(reads)
        reads.sort(key=lambda r: r["read_id"])
        assert [r["name"] for r in reads] == [f"s{k}_{o}" for k in range(900) for o in range(0, 5 * (k % 90) - 11, 2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bz2_and_qualities(spark, tmp_path):
    p = tmp_path / "a.raw.bz2"
    p.write_bytes(bz2.compress(b"ACGT\nGG\n"))
    reads = R.raw(spark, str(p))
    quals = spark.createDataFrame([(0, 0, "40 30 20 10"), (1, 0, "2 3")], "read_id long, mate int, qual string")
    assert rows(R.with_qualities(reads, quals), "seq", "qual") == [("ACGT", "I?5+"), ("GG", "#$")]


def test_suffix_array(spark):
    texts = ["ACGTACGTACGTACGTACGTACGTACGTACGTACGT", "AAAAAAA", "G"]
    sa = suffixes.suffix_array(references.literals(spark, texts), start=4)
    got = [(r["ref_id"], r["pos"]) for r in sa.orderBy("ref_id", "place").collect()]
    assert got == [(i, p) for i, t in enumerate(texts) for p in sorted(range(len(t) + 1), key=lambda k, t=t: t[k:])]
    assert {r["ref_id"]: r["bwt"] for r in suffixes.bwt(sa).collect()}[1] == "AAAAAAA$"
    assert {(r["ref_id"], r["place"]) for r in suffixes.suffix_sample(sa, 2).collect()} == {(i, p) for i, t in enumerate(texts) for p in range(0, len(t) + 1, 4)}


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(sequence.reverse_complement(F.lit("ACGNt"))) == ("aNCGT",)
    assert pick(*[quality.rounded(F.lit(q)) for q in (0, 4, 5, 14, 15, 24, 25, 40)]) == (0, 0, 10, 10, 20, 20, 30, 30)
    assert pick(*[quality.solexa_to_phred(F.lit(q)) for q in (-11, -10, -9, -1, 0, 9, 10, 40)]) == (0, 0, 1, 3, 3, 10, 10, 40)
    assert pick(quality.to_phred33(F.lit("40 3  93 99"), integers=True)) == ("I$~~",)
    assert pick(quality.to_phred33(F.lit("h@"), "phred64")) == ("I!",)
    state, seen = 7, []
    col = F.lit(7).cast("long")
    for _ in range(3):
        value, col = random.draw(col)
        a = (1664525 * state + 1013904223) & 0xFFFFFFFF
        state = (1664525 * a + 1013904223) & 0xFFFFFFFF
        seen.append((one.select(value).first()[0], (a >> 16) ^ state))
    assert all(x == y for x, y in seen)
    assert pick(sequence.packed_mismatches(sequence.pack_2bit(F.lit("ACGTT")), sequence.pack_2bit(F.lit("ACTTA")))) == (2,)
    assert pick(sequence.mate_name(F.lit("r"), F.lit(1)), sequence.mate_name(F.lit("r/2"), F.lit(2)), sequence.query_name(F.lit("r x/1"), F.lit(1))) == ("r/1", "r/2", "r")


def test_sinks(spark, tmp_path):
    assert sinks.with_mate("/x/a.fq", 1) == "/x/a_1.fq"
    refs = references.literals(spark, "ACGT")
    assert [r["line"] for r in sinks.sam_header(refs, "ID:x").orderBy("ordinal").collect()] == ["@HD\tVN:1.0\tSO:unsorted", "@SQ\tSN:0\tLN:4", "@RG\tID:x", "@PG\tID:strandjoin\tVN:1"]
    sinks.write_lines(spark.createDataFrame([(1, "b"), (0, "a")], "read_id long, line string"), str(tmp_path / "o"), ("read_id",))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]


def test_running_counts_over_tiles(spark):
    refs = references.literals(spark, "ACGT" * 10)
    m = spark.createDataFrame([(0, o, o % 3 == 0) for o in range(36)], "ref_id long, off long, mapable boolean")
    want = [sum(1 for k in range(max(0, o - 4), o + 1) if k < 36 and k % 3 == 0) for o in range(40)]
    got = {r["off"]: r["covering"] for r in analysis.running(m, refs, 5, tile=8).collect()}
    assert got == dict(enumerate(want))


def test_stream(spark, tmp_path):
    from strandjoin.options import AlignOptions
    from strandjoin.streaming.batches import READS, align_stream

    R.literals(spark, "ACGTT,GGGGG").write.parquet(str(tmp_path / "in"))
    out = []
    q = align_stream(spark.readStream.schema(READS).parquet(str(tmp_path / "in")), references.literals(spark, "TTACGTTAA"), AlignOptions(mode="v", v=0), lambda d, n: out.extend((r["read_id"], r["off"]) for r in d.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert out == [(0, 2)]


def test_a_hot_kmer_is_written_by_several_tasks(spark, tmp_path):
    """One long run of a base fills a bucket; its rows are cut into several files, and a bucketed join still finds all of them."""
    path, n = str(tmp_path / "idx"), 8 * (9_000 - 13)
    refs = references.literals(spark, ",".join(["A" * 9_000 + "CGTACGTTACGTAC"] * 8)).repartition(4, "ref_id")
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        index.build(refs, path, buckets=4)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    grams = index.load(spark, path).kmers()
    files = grams.filter("kmer = 0 AND span = 14").groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == n
    buckets = {r["file"].rsplit("_", 1)[1].split(".")[0] for r in files}
    assert len(buckets) == 1
    keys = spark.createDataFrame([(0,), (5,)], "kmer long").hint("merge")
    found = grams.filter("span = 14").join(keys, "kmer")
    assert found.count() == n and "Bucketed: true" in found._jdf.queryExecution().toString()


def test_kmers_of_an_index_of_tiles_are_the_stored_ones(spark, tmp_path):
    """idx_kmers counts those that tiles make; none of them is written or shuffled before they are counted."""
    rng = pyrandom.Random(8)
    refs = references.literals(spark, ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (9000, 30, 5)])
    for name, alone in (("tiles", True), ("all", False)):
        index.build(refs, f"file://{tmp_path}/{name}", buckets=2, only_tiles=alone)
    made, kept = (index.load(spark, f"file://{tmp_path}/{name}").kmers().select("kmer", "span", "ref_id", "pos") for name in ("tiles", "all"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, kept.collect()))
    d = QUERIES["idx_kmers"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "kmers" not in plan and plan.count("Exchange hashpartitioning") == 1
