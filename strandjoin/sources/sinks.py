"""Rows of alignments as text: default columns, partitioned layout, SAM; and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import first_word, mate_name, query_name


def _with_names(d: DataFrame, refs: DataFrame | None, full: bool, index: bool) -> DataFrame:
    if refs is None or index:
        return d.withColumn("ref", F.col("ref_id").cast("string"))
    name = F.col("name") if full else first_word("name")
    r = refs.select(F.col("ref_id"), name.alias("ref"))
    return d.join(r, "ref_id")


def edits(mms: Column | str) -> Column:
    """pos:ref>read, comma-separated."""
    return F.array_join(F.transform(mms, lambda m: F.concat(m["pos"].cast("string"), F.lit(":"), m["ref"], F.lit(">"), m["read"])), ",")


def default_rows(hits: DataFrame, refs: DataFrame | None = None, base: int = 0, full_ref: bool = False, ref_index: bool = False, cost: bool = False, show_seed: bool = False) -> DataFrame:
    """read, strand, ref, off0, seq, qual, oms, mms (and stratum, cost, seed); read_id, mate and rank stay for ordering."""
    d = _with_names(hits, refs, full_ref, ref_index)
    more = ([F.col("stratum"), F.col("cost")] if cost else []) + ([F.col("read_seed").alias("seed")] if show_seed else [])
    return d.select("read_id", "mate", "rank", mate_name("name", "mate").alias("read"), F.when(F.col("fw"), "+").otherwise("-").alias("strand"), "ref", (F.col("off") + base).alias("off0"), "seq", "qual", "oms", edits("mms").alias("mms"), *more)


DEFAULT = ("read", "strand", "ref", "off0", "seq", "qual", "oms", "mms")


def text_lines(rows: DataFrame, columns: tuple[str, ...] = DEFAULT, suppress: tuple[int, ...] = ()) -> DataFrame:
    """Tab-separated lines without the columns numbered (from 1) in suppress."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(columns, 1) if i not in suppress]
    return rows.select(*[c for c in ("read_id", "mate", "rank") if c in rows.columns], F.concat_ws("\t", *kept).alias("line"))


def partition_rows(hits: DataFrame, size: int, refs: DataFrame | None = None, base: int = 0, full_ref: bool = False) -> DataFrame:
    """Keyed by reference and partition of |size| bases: ref, part, off, strand, read, seq, qual, oms, mms, label. With size over 0 a read that reaches the partition's end is in the next ones too."""
    d = _with_names(hits, refs, full_ref, False)
    width = abs(size)
    at = F.col("off") + base
    # the test is one base early: a read that ends right at the border counts as crossing it
    last = F.floor((at % width + F.col("len")) / width).cast("int") if size > 0 else F.lit(0)
    d = d.withColumn("spill", F.explode(F.sequence(F.lit(0), last)))
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    mms = F.when(F.size("mms") == 0, F.lit("-")).otherwise(edits("mms"))
    label = F.regexp_extract("name", r"(?:^|;)LB:([^;]*)", 1)
    zeroed = lambda c, n: F.when(c == 0, F.repeat(F.lit("0"), F.lit(n + 1))).otherwise(pad(c, n))  # noqa: E731  a zero prints itself after n padding zeros
    return d.select("read_id", "mate", "rank", "ref", zeroed(F.floor(at / width) + F.col("spill"), 10).alias("part"), zeroed(at, 9).alias("off"), F.when(F.col("fw"), "+").otherwise("-").alias("strand"), F.col("name").alias("read"), "seq", "qual", "oms", mms.alias("mms"), label.alias("label"))


def sam_header(refs: DataFrame, read_group: str | None = None, program: str = "strandjoin", version: str = "1") -> DataFrame:
    """line, by ordinal: @HD, an @SQ for each reference, @RG, @PG."""
    spark = refs.sparkSession
    sq = refs.select((F.col("ref_id") + 1).alias("ordinal"), F.concat(F.lit("@SQ\tSN:"), first_word("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("line"))
    ends = [(0, "@HD\tVN:1.0\tSO:unsorted")] + ([(1 << 61, f"@RG\t{read_group}")] if read_group else []) + [(1 << 62, f"@PG\tID:{program}\tVN:{version}")]
    return spark.createDataFrame(ends, "ordinal long, line string").unionByName(sq)


def md(mms: Column, length: Column, fw: Column) -> Column:
    """Runs of matches with the reference's base at each mismatch, in the order of the forward reference."""
    at = F.array_sort(F.transform(mms, lambda m: F.struct(F.when(fw, m["pos"]).otherwise(length - 1 - m["pos"]).alias("i"), m["ref"].alias("ref"))))
    zero = F.struct(F.lit(0).alias("next"), F.lit("").alias("s"))
    run = F.aggregate(at, zero, lambda a, m: F.struct((m["i"] + 1).alias("next"), F.concat(a["s"], (m["i"] - a["next"]).cast("string"), m["ref"]).alias("s")))
    return F.concat(run["s"], (length - run["next"]).cast("string"))


def sam_records(hits: DataFrame, refs: DataFrame | None = None, mapq: int = 255, full_ref: bool = False, ref_index: bool = False) -> DataFrame:
    """The SAM columns and tags of reported hits, or of mates (with mate_off, mate_fw, mate_len)."""
    d = _with_names(hits, refs, full_ref, ref_index)
    paired = "mate_off" in hits.columns
    if not paired:
        d = d.withColumn("mate_off", F.lit(None).cast("long")).withColumn("mate_fw", F.lit(True)).withColumn("mate_len", F.lit(None).cast("int"))
    pair = F.col("mate") > 0 if paired else F.lit(False)
    flag = F.when(pair, F.when(F.col("mate") == 1, F.lit(67)).otherwise(F.lit(131))).otherwise(F.lit(0))
    flag = flag + F.when(F.col("fw"), 0).otherwise(16) + F.when(pair & ~F.col("mate_fw"), 32).otherwise(0)
    insert = F.when(F.col("off") > F.col("mate_off"), -(F.col("off") - F.col("mate_off") + F.col("len"))).otherwise(F.col("mate_off") - F.col("off") + F.col("mate_len"))
    xm = F.when(F.col("sampled"), F.col("oms") + 1)
    return d.select(
        "read_id", "mate", query_name("name", "mate").alias("qname"), flag.alias("flag"), "ref", (F.col("off") + 1).alias("pos"),
        F.when(F.col("sampled"), F.lit(0)).otherwise(F.lit(mapq)).alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.when(pair, "=").otherwise("*").alias("rnext"), F.when(pair, F.col("mate_off") + 1).otherwise(F.lit(0)).alias("pnext"), F.when(pair, insert).otherwise(F.lit(0)).alias("tlen"),
        "seq", "qual", F.col("stratum").alias("xa"), md(F.col("mms"), F.col("len"), F.col("fw")).alias("md"), F.size("mms").alias("nm"), xm.alias("xm"),
    )


def sam_unaligned(reads: DataFrame, states: DataFrame) -> DataFrame:
    """Records of reads that failed to align; those over -m have none."""
    d = reads.join(states.filter("status = 'unaligned'"), "read_id", "left_semi")
    flag = F.when(F.col("mate") == 1, 77).when(F.col("mate") == 2, 141).otherwise(4)
    zero, null = F.lit(0).cast("long"), F.lit(None)
    return d.select(
        "read_id", "mate", query_name("name", "mate").alias("qname"), flag.alias("flag"), F.lit("*").alias("ref"), zero.alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"),
        F.lit("*").alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), "seq", "qual", null.cast("int").alias("xa"), null.cast("string").alias("md"), null.cast("int").alias("nm"), zero.alias("xm"),
    )


def sam_lines(records: DataFrame) -> DataFrame:
    """line: eleven columns and the tags that are set."""
    tag = lambda name, kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), F.col(c).cast("string")))
    cols = [F.col(c).cast("string") for c in ("qname", "flag", "ref", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    return records.select("read_id", "mate", F.concat_ws("\t", *cols, tag("XA", "i", "xa"), tag("MD", "Z", "md"), tag("NM", "i", "nm"), tag("XM", "i", "xm")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A folder of text files; with order, sorted over all of them."""
    d = lines.orderBy(*order) if order else lines
    d.select("line").write.mode("overwrite").text(path)


def with_mate(path: str, mate: int) -> str:
    """_1 or _2 before the last dot of the file's name."""
    head, dot, tail = path.rpartition(".")
    return f"{head}_{mate}.{tail}" if dot and "/" not in tail else f"{path}_{mate}"


def write_routed(routes: dict[str, DataFrame], paths: dict[str, str]) -> None:
    """The reads' original text to the paths of al, un and max; mates to files of their own."""
    for kind, path in paths.items():
        d = routes[kind]
        for mate in (0, 1, 2):
            own = d.filter(F.col("mate") == mate)
            if mate == 0 or not own.isEmpty():
                own.select("raw").write.mode("overwrite").text(with_mate(path, mate) if mate else path)


def counter_lines(row, pairs: int = 0, singles: int | None = None) -> list[str]:
    """The lines that a run ends with, from a row of counters; pairs and singles: reported pairs, and reported placements that aren't of pairs."""
    out = [f"# reads processed: {row['processed']}", f"# reads with at least one alignment: {row['aligned']} ({row['pct_aligned']:.2f}%)", f"# reads that failed to align: {row['failed']} ({row['pct_failed']:.2f}%)"]
    if row["suppressed"]:
        how = "sampled due to -M" if "sampling" in row and row["sampling"] else "suppressed due to -m"
        out.append(f"# reads with alignments {how}: {row['suppressed']} ({row['pct_suppressed']:.2f}%)")
    alone = row["reported"] if singles is None else singles
    if pairs:
        return [*out, f"Reported {pairs} paired-end alignments" + (f" and {alone} singleton alignments" if singles else "")]
    return [*out, f"Reported {alone} alignments" if alone else "No alignments"]


def hadoop_lines(row, singles: int, pairs: int, group: str = "Strandjoin") -> list[str]:
    """Counter lines for a streaming job's log; a pair counts as two alignments."""
    counts = {"Reads with reported alignments": row["aligned"], "Reads with no alignments": row["failed"], "Reads exceeding -m limit": row["suppressed"], "Unpaired alignments reported": singles, "Paired alignments reported": 2 * pairs}
    return [f"reporter:counter:{group},{what},{n}" for what, n in counts.items()]
