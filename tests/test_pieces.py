"""Sources of several files, of which Spark makes several splits and deals them by size."""

import random

import pytest
from pyspark.sql import functions as F

from strandjoin.operators import index
from strandjoin.sources import reads as R
from strandjoin.sources import references


@pytest.fixture(params=[700])
def split(spark, request):
    """Splits of so many bytes, a few of which share a task."""
    conf = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def folder(tmp_path, name, texts):
    """Files of very different sizes, so that their order by size isn't that by name."""
    d = tmp_path / name
    d.mkdir()
    for i, t in enumerate(texts):
        (d / f"part-{i:02d}.txt").write_text(t)
    return str(d)


def dealt(rng, items):
    """items in five stretches of unequal length, one of them empty."""
    cuts = sorted([0, 3, 3, len(items) // 2, len(items) - 20, len(items)])
    assert rng is not None
    return [items[a:z] for a, z in zip(cuts, cuts[1:])]


def made(rng, n=60):
    return [(f"read{i}", "".join(rng.choice("ACGTN") for _ in range(k)), "".join(chr(33 + rng.randrange(40)) for _ in range(k))) for i in range(n) for k in [rng.randint(1, 60)]]


def got(d, *columns):
    return [tuple(r) for r in d.orderBy("read_id", "mate").select(*columns).collect()]


def test_fastq(spark, tmp_path, split):
    rng = random.Random(1)
    reads = made(rng)
    text = lambda part: "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in part)
    parts = [text(p) for p in dealt(rng, reads)]
    parts[0] += "\n"  # a blank line at a file's end
    parts[-1] = parts[-1].rstrip("\n")
    path = folder(tmp_path, "q", parts)
    want = [(i, *r) for i, r in enumerate(reads)]
    for paths in (path, f"{path}/part-*.txt", [f"{path}/part-{i:02d}.txt" for i in range(5)]):
        assert got(R.fastq(spark, paths), "read_id", "name", "seq", "qual") == want
    both = got(R.fastq(spark, path, interleaved=True), "read_id", "mate", "name")
    assert both == [(i // 2, i % 2 + 1, r[0]) for i, r in enumerate(reads)]


def test_fastq_plan_has_no_shuffle_of_reads(spark, tmp_path):
    path = folder(tmp_path, "q", ["@a\nAC\n+\nII\n", "@b\nAC\n+\nII\n"])
    d = R.records(spark, path, 4)
    plan = d._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("Union", 1)[1].split("LocalTableScan", 1)[0] if "Union" in plan else plan
    assert whole.index("MapInArrow") < whole.index("Exchange hashpartitioning") if "Exchange hashpartitioning" in whole else True
    assert d.count() == 2


def test_lines_and_records(spark, tmp_path, split):
    rng = random.Random(2)
    reads = made(rng)
    stretches = dealt(rng, reads)
    raw = folder(tmp_path, "raw", ["".join(f"{s}\n" + "\n" * (len(s) % 2) for _, s, _ in p) for p in stretches])
    assert got(R.raw(spark, raw), "read_id", "seq") == [(i, r[1]) for i, r in enumerate(reads)]
    fasta = folder(tmp_path, "fa", ["".join(f">{n} x\n{s[:20]}\n{s[20:]}\n" for n, s, _ in p) for p in stretches])
    assert got(R.fasta(spark, fasta), "read_id", "name", "seq") == [(i, f"{r[0]} x", r[1]) for i, r in enumerate(reads)]
    tab = folder(tmp_path, "tab", ["".join(f"{n}\t{s}\t{q}\n" for n, s, q in p) for p in stretches])
    assert got(R.tabbed(spark, tab), "read_id", "name", "qual") == [(i, r[0], r[2]) for i, r in enumerate(reads)]
    quals = folder(tmp_path, "quals", ["".join(f">{n}\n{' '.join(str(ord(c) - 33) for c in q)}\n" for n, _, q in p) for p in stretches[::-1]])
    back = [r for p in stretches[::-1] for r in p]
    other = folder(tmp_path, "fa2", ["".join(f">{n}\n{s}\n" for n, s, _ in back)])
    assert got(R.with_qualities(R.fasta(spark, other), R.quality_records(spark, quals)), "name", "qual") == [(r[0], r[2]) for r in back]


def test_mates_that_files_cut_elsewhere(spark, tmp_path, split):
    rng = random.Random(3)
    reads = made(rng)
    text = lambda part: "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in part)
    one = folder(tmp_path, "1", [text(p) for p in dealt(rng, reads)])
    two = folder(tmp_path, "2", [text(reads[:40]), text(reads[40:41]), text(reads[41:])])
    d = R.pairs(R.fastq(spark, one), R.fastq(spark, two))
    assert got(d, "read_id", "mate", "name") == [(i, m, r[0]) for i, r in enumerate(reads) for m in (1, 2)]


def test_references(spark, tmp_path, split):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 7, 300, 1500]))) for _ in range(23)]
    lines = [f">s{i} x\n" + "".join(f"{s[k : k + 60]}\n" for k in range(0, len(s), 60)) for i, s in enumerate(seqs)]
    path = folder(tmp_path, "fa", ["".join(p) for p in dealt(rng, lines)])
    t = references.fasta_tiles(spark, path, step=128, right=64)
    found = index.sequences(t).orderBy("ref_id").select("ref_id", "name", "seq", "len").collect()
    assert [tuple(r) for r in found] == [(i, f"s{i} x", s, len(s)) for i, s in enumerate(seqs)]
    for r in t.tiles.collect():
        assert r["bases"] == seqs[r["ref_id"]][r["t0"] : r["t0"] + 192]
    d = references.continuous(spark, path, 40, 7)
    assert got(d, "read_id", "name", "seq") == [(i, *x) for i, x in enumerate((f"s{k}_{o}", s[o : o + 40]) for k, s in enumerate(seqs) for o in range(0, len(s) - 39, 7))]
    rows = references.fasta(spark, path).orderBy("ref_id").select("ref_id", "name", "seq").collect()
    assert [tuple(r) for r in rows] == [(i, f"s{i} x", s) for i, s in enumerate(seqs)]


def test_one_read_sources(spark, tmp_path):
    a, b = (folder(tmp_path, n, [f"{s}\n"]) for n, s in (("a", "AC"), ("b", "GT")))
    assert got(R.union([R.raw(spark, a), R.raw(spark, b)]), "read_id", "seq") == [(0, "AC"), (1, "GT")]
    assert got(R.raw(spark, [b, a]), "read_id", "seq") == [(0, "GT"), (1, "AC")]
    none = folder(tmp_path, "none", [""])
    assert R.fastq(spark, none).count() == R.raw(spark, none).count() == R.fasta(spark, none).count() == 0
    assert references.fasta_tiles(spark, none).refs.count() == 0


def test_codecs(spark, tmp_path, split):
    import bz2
    import gzip

    reads = made(random.Random(5))
    d = tmp_path / "z"
    d.mkdir()
    for i, (part, pack) in enumerate(((reads[:50], gzip.compress), (reads[50:53], bz2.compress), (reads[53:], bytes))):
        (d / f"part-{i}.fq{['.gz', '.bz2', ''][i]}").write_bytes(pack("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in part).encode()))
    assert got(R.fastq(spark, str(d)), "read_id", "name", "qual") == [(i, r[0], r[2]) for i, r in enumerate(reads)]
    assert R.fastq(spark, str(d)).filter(F.col("mate") != 0).count() == 0
