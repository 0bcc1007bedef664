"""MinHash near-dedup by a multi-index Hamming join.

A document is its set of distinct shingles of `words` consecutive words (words are lower-cased
A-Z, split at ASCII white space; with fewer words the whole sequence is one shingle; without words
the set is empty and linked with nothing). Its signature has chunks * 5 symbols of 16 bits, each the
low bits of a minimum hash. Two signatures that differ in at most 2 * chunks - 1 symbols have, by
pigeonhole, a chunk with at most one error; every chunk is indexed under the five keys that leave
one symbol out, so that all such pairs meet. At a similarity of 0.8 a pair differs in 20 of 100
symbols on average with a deviation of 4; the bound of 39 is missed by about one pair in a million.

Documents with equal sets are one class, of which only the first takes part. A bucket's members are
compared with two pivots, its first member and the one that shares most keys; after the components
of those links, members of a bucket that are still in different components are compared in blocks
of about four thousand members or a million shingles, a pair of blocks in a task, but for blocks of one
and the same component, and each pair in the first bucket that it shares; what leaves a block are the partners under the distance bound. So all links between components are
found, and no table of all pairs within a group is made. Candidates under the distance bound are
confirmed on the full sets.

Null text is empty. Rows without doc_id are linked with nothing; rows that repeat a doc_id are one
node, and each has the component of its own text's class. Very long texts are hashed whole. Further
columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, as_bytes, few, map_batches, materialise, partitions, unique_ids
from .components import components
from .runs import key_runs

CHUNK = 5
SALTS = 16
#: So many partners of a pivot are compared with it in one place.
PARTNERS = 256
SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, sig binary"


class WordHashes(Memo):
    def make(self, word: bytes) -> bytes:
        return xxhash.xxh3_64_digest(word)


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes."""
    w = np.frombuffer(b"".join(map(hashes.__getitem__, text.lower().split())), np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(31)))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20240229)
    return r.randint(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), r.randint(0, 1 << 32, n, np.uint64).astype(np.uint32)


def signature(s: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = None
    for a in range(0, len(x), 1024):
        h = np.multiply.outer(mult, x[a : a + 1024])
        h += add[:, None]
        m = h.min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return (least & np.uint32(0xFFFF)).astype("<u2")


def _sign(words: int, chunks: int):
    mult, add = multipliers(chunks * CHUNK)
    hashes = WordHashes()  # a task's own, as each unpickles this

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sets, sigs = [], [], []
        for raw in b["raw"].to_pylist():
            s = shingles(raw, words, hashes)
            n.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s, mult, add).tobytes() if len(s) else b"")
        k = np.frombuffer(b"".join(sets), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(n, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(sigs, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])

    return of


def _keys(chunks: int):
    """The index: for each chunk, a key for each symbol left out."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b["sig"].to_pylist()), "<u2").reshape(-1, chunks, CHUNK)
        out = []
        with np.errstate(over="ignore"):
            for w in range(CHUNK):
                left = np.ascontiguousarray(np.delete(sig, w, axis=2)).view("<u8").reshape(-1, chunks)
                h = (left ^ (left >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(w + 1)) * np.uint64(0xD6E8FEB86659FD93)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                out.append((h ^ (h >> np.uint64(29))).view(np.int64))
        keys = np.concatenate(out, axis=1).ravel()
        ids = np.repeat(b["doc_id"].to_numpy(), chunks * CHUNK)
        slots = np.tile((np.arange(chunks) * CHUNK)[None, :] + np.arange(CHUNK)[:, None], (b.num_rows, 1, 1)).ravel().astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), pa.array(ids), pa.array(slots)], names=["k1", "k2", "id", "slot"])

    return of


def _near(most: int):
    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y = (np.frombuffer(b"".join(b[c].to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("u_sig", "v_sig"))
        keep = pa.array((x != y).sum(axis=1) <= most)
        out = pa.RecordBatch.from_arrays([b["u"], b["v"]], names=["u", "v"]).filter(keep)
        return out if out.num_rows else None

    return of


def _confirm(words: int, percent: int):
    """Links of a pivot, whose row comes before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()

        def full(raw: bytes) -> set:
            w = raw.lower().split()
            return set(zip(*(w[j:] for j in range(words)), strict=False)) if len(w) >= words else {tuple(w)}

        for b in batches:
            keep = []
            for partner, raw in zip(b["partner"].to_pylist(), b["raw"], strict=True):
                other = full(raw.as_py())
                if not partner:
                    own = other
                both = len(own & other)
                keep.append(partner and 100 * both >= percent * (len(own) + len(other) - both))
            out = pa.RecordBatch.from_arrays([b["pivot"], b["id"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return run


def texts_of(ids: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, raw of these documents. A bitmap of their ids' hashes, at most 16 MB, keeps nearly all other texts from being shuffled."""
    keys = materialise(first.select("doc_id", "text_hash").join(ids, "doc_id", "left_semi"), "text_keys")
    bits = min(27, max(15, (8 * keys.count()).bit_length()))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's buckets begin with the value 1
    maps = keys.select(F.bitmap_bucket_number(place).alias("__b"), F.bitmap_bit_position(place).alias("at")).groupBy("__b").agg(F.bitmap_construct_agg("at").alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1
    maybe = texts.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__b")).filter(held).drop("__b", "__bits")
    # keys are distinct; a semi join would be pushed below the bitmap's join and shuffle all texts
    return maybe.join(keys, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "raw")


def confirmed(pairs: DataFrame, first: DataFrame, texts: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """The links among pairs (u, v): first those within the distance bound, then those whose full sets are similar enough."""
    sig = first.select("doc_id", "sig")
    near = pairs.join(sig.select(F.col("doc_id").alias("u"), F.col("sig").alias("u_sig")), "u").join(sig.select(F.col("doc_id").alias("v"), F.col("sig").alias("v_sig")), "v")
    near = materialise(map_batches(near.select("u", "v", "u_sig", "v_sig"), _near(most), "u long, v long"), "near")
    ids = near.select(F.col("u").alias("doc_id")).unionByName(near.select(F.col("v").alias("doc_id"))).distinct()
    used = materialise(texts_of(ids, first, texts), "near_texts")
    # the document with more pairs is the pivot; its text goes once to each share of its partners
    n_pairs = near.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    near = near.join(n_pairs.select(F.col("id").alias("u"), F.col("n").alias("n_u")), "u").join(n_pairs.select(F.col("id").alias("v"), F.col("n").alias("n_v")), "v")
    more = F.col("n_u") >= F.col("n_v")
    near = near.select(F.when(more, F.col("u")).otherwise(F.col("v")).alias("pivot"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("id"), F.ceil(F.greatest("n_u", "n_v") / PARTNERS).alias("shares"))
    near = materialise(near.select("pivot", F.pmod(F.xxhash64("id"), "shares").alias("share"), "id"), "pivots")
    own = near.select("pivot", "share").distinct().select("pivot", "share", F.col("pivot").alias("id"), F.lit(False).alias("partner"))
    rows = near.select("pivot", "share", "id", F.lit(True).alias("partner")).unionByName(own).join(used.withColumnRenamed("doc_id", "id"), "id")
    dealt = rows.repartition(partitions(first.sparkSession), "pivot", "share").sortWithinPartitions("pivot", "share", "partner")
    return materialise(dealt.select("pivot", "id", "partner", "raw").mapInArrow(_confirm(words, percent), "u long, v long"), "confirmed")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *new.tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[x] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _partners(chunks: int, most: int):
    """For each open bucket (or pair of its blocks), the members' partners: of other components, within the distance bound, and not met in an earlier bucket."""
    names = ["k1", "pa", "pb", "id", "partners"]

    def rows(t: pa.Table) -> pa.RecordBatch | None:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        ids, comp, block = (t[c].to_numpy()[order] for c in ("id", "component", "block"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(ids), -1)[order]
        pa_, pb, own = (t[c][0].as_py() for c in ("pa", "pb", "slot"))
        chunk, out = divmod(own, CHUNK), {}
        for a in range(0, len(ids), 64):
            top = slice(a, min(a + 64, len(ids)))
            pair = (comp[top, None] != comp[None, :]) & (ids[top, None] < ids[None, :])
            if pa_ != pb:
                pair &= block[top, None] != block[None, :]
            i, j = np.nonzero(pair)
            for k in range(0, len(i), 200_000):
                x, y = i[k : k + 200_000] + a, j[k : k + 200_000]
                bad = sig[x] != sig[y]
                close = bad.sum(axis=1) <= most
                x, y, bad = x[close], y[close], bad[close].reshape(-1, chunks, CHUNK)
                # the first chunk with at most one error, and the symbol left out there, say where a pair is met first
                errors = bad.sum(axis=2)
                at = (errors <= 1).argmax(axis=1)
                left = bad[np.arange(len(at)), at].argmax(axis=1) if len(at) else at
                here = (at == chunk[0]) & (left == chunk[1])
                for u, v in zip(x[here].tolist(), y[here].tolist(), strict=True):
                    out.setdefault(u, []).append(int(ids[v]))
        if not out:
            return None
        used = sorted(set(out) | {int(np.searchsorted(ids, v)) for vs in out.values() for v in vs})
        n = len(used)
        return pa.RecordBatch.from_arrays([pa.array([t["k1"][0].as_py()] * n, pa.int64()), pa.array([pa_] * n, pa.int32()), pa.array([pb] * n, pa.int32()), pa.array(ids[used], pa.int64()), pa.array([out.get(u, []) for u in used], pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["k1", "pa", "pb"]):
            if (b := rows(t)) is not None:
                yield b

    return run


def _confirm_runs(words: int, percent: int):
    """Links among the partners of a bucket, on the full sets; what a link has joined isn't compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["k1", "pa", "pb"]):
            codes: dict[tuple, int] = {}
            sets: dict[int, frozenset] = {}
            for i, raw in zip(t["id"].to_pylist(), t["raw"], strict=True):
                w = raw.as_py().lower().split()
                grams = zip(*(w[j:] for j in range(words)), strict=False) if len(w) >= words else [tuple(w)]
                sets[i] = frozenset([codes.setdefault(g, len(codes)) for g in grams])
            root = {i: i for i in sets}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            us, vs = [], []
            for u, partners in zip(t["id"].to_pylist(), t["partners"].to_pylist(), strict=True):
                own = sets[u]
                for v in partners:
                    other = sets.get(v)
                    if other is None or find(u) == find(v):
                        continue
                    n, m = len(own), len(other)
                    if 100 * min(n, m) >= percent * max(n, m):
                        both = len(own & other)
                        if 100 * both >= percent * (n + m - both):
                            us.append(u)
                            vs.append(v)
                            root[find(v)] = find(u)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def blocks(placed: DataFrame, most_members: int, most_shingles: int) -> DataFrame:
    """The rows of buckets with several components (k1, slot, id, component, n_shingles), dealt to pairs of blocks: k1, pa, pb, slot, block, id, component.

    A block has about most_members members and most_shingles shingles. A component that fills a
    quarter of one has blocks of its own, the others share theirs, so that no two blocks of one
    component are ever paired, nor such a block with itself.
    """
    keys = placed.groupBy("k1").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).filter("a <> b")
    keys = materialise(keys.select("k1", F.expr(f"n > {most_members} OR s > {most_shingles}").alias("wide")), "open_keys")
    weight = F.greatest(F.count("*") / most_members, F.sum("n_shingles") / most_shingles)
    parts = placed.join(keys.filter("wide").select("k1"), "k1", "left_semi").groupBy("k1", "component").agg(weight.alias("weight"))
    parts = materialise(parts.withColumn("own", F.col("weight") >= 0.25), "parts")
    of_own = F.when(F.col("own"), F.ceil("weight"))
    sizes = parts.groupBy("k1").agg(F.coalesce(F.ceil(F.sum(F.when(~F.col("own"), F.col("weight")))), F.lit(0)).alias("mixed"), F.coalesce(F.sum(of_own), F.lit(0)).alias("n_own"))
    # read afresh, so that a hot bucket's rows can be split
    keys = materialise(keys.join(sizes, "k1", "left").select("k1", F.coalesce("mixed", F.lit(1)).alias("mixed"), (F.coalesce("mixed", F.lit(1)) + F.coalesce("n_own", F.lit(0))).alias("blocks")), "block_counts")
    before = F.coalesce(F.sum("n_own").over(Window.partitionBy("k1").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owned = parts.filter("own").select("k1", "component", F.ceil("weight").alias("n_own")).withColumn("before", before)
    owned = materialise(owned.join(sizes.select("k1", "mixed"), "k1").select("k1", "component", (F.col("mixed") + F.col("before")).alias("from"), "n_own"), "own_blocks")
    rows = placed.join(keys, "k1").join(few(owned, 100_000), ["k1", "component"], "left")
    own, shared = F.col("from") + F.pmod(F.xxhash64("id"), F.col("n_own")), F.pmod(F.xxhash64("component"), F.greatest("mixed", F.lit(1)))
    rows = rows.withColumn("block", F.when(F.col("from").isNotNull(), own).otherwise(shared))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = F.when(F.col("from").isNull(), every).otherwise(F.filter(every, lambda j: (j < F.col("from")) | (j >= F.col("from") + F.col("n_own"))))
    rows = rows.withColumn("j", F.explode(met))
    return rows.select("k1", F.least("block", "j").cast("int").alias("pa"), F.greatest("block", "j").cast("int").alias("pb"), "slot", F.col("block").cast("int").alias("block"), "id", "component")


def across(buckets: DataFrame, links: DataFrame, first: DataFrame, texts: DataFrame, words: int, percent: int, chunks: int, most_members: int = 4_000, most_shingles: int = 1_000_000) -> DataFrame:
    """Links between members of a bucket that the given links leave in different components.

    A bucket is compared in blocks inside a task and only partners leave it, as lists; a bucket over
    most_members or most_shingles is dealt to several tasks by pairs of blocks.
    """
    n_parts = partitions(buckets.sparkSession)
    nodes = first.select(F.col("doc_id").alias("id"), "n_shingles").dropDuplicates(["id"])
    nodes = nodes.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = buckets.select("k1", "slot", "id").join(nodes, "id")
    rest = blocks(placed, most_members, most_shingles)
    rest = rest.join(first.select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id"]), "id")
    by = ["k1", "pa", "pb"]
    dealt = rest.repartition(n_parts, *by).sortWithinPartitions(*by)
    near = materialise(dealt.mapInArrow(_partners(chunks, 2 * chunks - 1), "k1 long, pa int, pb int, id long, partners array<long>"), "partners")
    own = texts_of(near.select(F.col("id").alias("doc_id")).distinct(), first, texts)
    own = materialise(own.select(F.col("doc_id").alias("id"), "raw").dropDuplicates(["id"]), "partner_texts")
    both = near.join(own, "id").select(*by, "id", "partners", "raw").repartition(n_parts, *by).sortWithinPartitions(*by)
    return materialise(both.mapInArrow(_confirm_runs(words, percent), "u long, v long"), "late")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to), kept: a row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), as_bytes(text).alias("raw"))
    signed = materialise(map_batches(texts, _sign(words, chunks), SIGNED), "signed")
    # classes of equal sets; the first of a class takes part
    classes = key_runs(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL"), ["doc_id", "text_hash"], 2, "doc_id", "classes")
    first = materialise(classes.filter("doc_id = run_first").dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "text_hash", "k1", "k2", "n_shingles", "sig"), "first")
    buckets = key_runs(map_batches(first.select("doc_id", "sig"), _keys(chunks), "k1 long, k2 long, id long, slot int"), ["id"], 2, "id", "buckets", only_big=True)
    buckets = buckets.select("k1", "k2", "id", "slot", F.col("run_first").alias("pivot"))
    shared = buckets.groupBy("id").agg((-F.count("*")).alias("rank"))
    central = key_runs(buckets.join(shared, "id").select("k1", "k2", "id", "rank"), ["rank", "id"], 2, "id", "central", only_big=True)
    pairs = buckets.select(F.least("pivot", "id").alias("u"), F.greatest("pivot", "id").alias("v")).unionByName(central.select(F.least("run_first", "id").alias("u"), F.greatest("run_first", "id").alias("v")))
    most = 2 * chunks - 1
    links = confirmed(materialise(pairs.filter("u <> v").distinct(), "pairs"), first, texts, words, percent, most)
    late = across(buckets, links, first, texts, words, percent, chunks)
    linked = components(links.unionByName(late))
    # a class may hold a third of all rows, so that its component goes to several places
    salted = materialise(linked.select(F.col("node").alias("first_id"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "salted")
    member = classes.select("doc_id", "text_hash", F.col("run_first").alias("first_id"), "n_shingles", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    member = member.join(salted, ["first_id", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component", "first_id").alias("component_id"))
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; that with the smallest id, or where ids are null or repeat the first row."""
    own = id_col
    if not unique_ids(docs, id_col):
        own = "__row"
        docs = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "near_docs")
    kept = near_duplicates(docs, words, percent, chunks, own, text_col).filter("kept").select(F.col("doc_id").alias("__kept"))
    out = docs.join(kept, docs[own] == kept["__kept"], "left_semi")
    return out.drop("__row") if own == "__row" else out
