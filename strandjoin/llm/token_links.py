"""Alignment of two tokenizers over a corpus, and how consistent it is.

A text, with a space before it, is encoded by both: A is a byte-level BPE, B a piece model that adds the
space itself. Where tokens of both end at the same byte a group ends; tokens whose bytes overlap are
linked. How often a pair of ids is linked over all texts is its count, and a pair is best if no other
A id has a higher count with its B id.

Both tokenizers encode what lies between a character that isn't white space and a space or line break
behind it independently of the rest (pieces that cross such a place would be found when they are
loaded; texts are then taken whole), so a segment's tokens, groups and links are made once while it is
remembered. A worker remembers about `remembered` segments; then those that came seldom are forgotten.

Counting is dense, striped by B id: stripe s has the ids b with b % STRIPES = s, and a stripe's counts
are one block of (B ids) x (A ids), to which np.add.at adds the sums that map tasks have made; row maxima
give the best. Blocks are bounded by the vocabularies. A stripe whose partial sums are many is summed in
parts first. Scoring sends a stripe's links to where its counts are; a stripe whose links are many is
dealt into parts, each of which gets the counts. Sums come back by batch of documents.

A null or empty text, and one whose joined A or B bytes differ from space and text, has no tokens: zeros
and no groups. Null and repeated ids are documents like others, very long texts are encoded segment by
segment, further columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, partitions

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
STRIPES = 256
#: Documents that a batch has at most, links that a task holds before it writes them, bytes of links that score in one part, partial sums of a stripe that are added in one part.
BATCH, HELD, PART, SUMS = 1 << 15, 1 << 21, 32 << 20, 4096
#: Documents that are added to a batch at once.
ADDED = 256
#: Characters from which on a text is encoded by itself, and of the texts that are encoded together.
LONG = 1 << 20
SPACES = " \n"
SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Any white space but SPACES, and what some tables count as such.
_OTHERS = "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
OTHER_WHITE = re.compile(f"[{_OTHERS}]")
#: Where texts with those are cut: behind what is no white space in any table.
CAREFUL = re.compile(rf"(?<=[^ \n{_OTHERS}])(?=[ \n])")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each as narrow as it can be, compressed."""
    heads, bodies = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        top = int(x.max(initial=0))
        kind = next(k for k, most in enumerate((1 << 8, 1 << 16, 1 << 32, 1 << 63)) if top < most)
        heads.append(struct.pack("<BQ", kind, len(x)))
        bodies.append(x.astype(f"<u{1 << kind}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(heads + bodies))


def unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    heads = [struct.unpack_from("<BQ", data, 1 + 9 * k) for k in range(data[0])]
    out, at = [], 1 + 9 * len(heads)
    for kind, n in heads:
        out.append(np.frombuffer(data, f"<u{1 << kind}", n, at).astype(np.int64))
        at += n << kind
    return out


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: themselves where they print, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class _Numbers(dict):
    """Numbers of segments in the order in which they first come; `new` has those whose tokens are still to be made."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


class Segments:
    """Segments of text with the tokens of both, remembered: arrays by number, and codes, the linked pairs one segment after the other."""

    def __init__(self, a_path: str, b_path: str, remembered: int = 500_000, held_bytes: int = 32 << 20):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own, vocabulary = byte_level(), self.a.get_vocab()
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # the three ways in which an id is followed by another
        self.marks = np.array([f"{k}{c}" for c in ",|;" for k in range(max(self.n_a, self.n_b))], dtype=object)
        self.whole = any(re.search(f"[^{SPACES}][{SPACES}]", self.b.id_to_piece(k).replace("\u2581", " ")) for k in range(self.n_b))
        self.skip = len(self.b.encode("a"))
        self.rows = -(-self.n_b // STRIPES)
        self.remembered, self.held_bytes = remembered, held_bytes
        self.number, self.texts, self.held = _Numbers(), [], 0
        self.facts = np.empty((0, 5), dtype=np.int64)  # A tokens, B tokens, groups, links, whether bytes are the text's
        self.starts, self.codes, self.uses = (np.empty(0, dtype=np.int64) for _ in range(3))

    def forget(self) -> None:
        """Room for new segments; of the known ones stay those of the most uses, at most half as many as there may be."""
        if len(self.number) <= self.remembered and self.held <= self.held_bytes:
            return
        sizes = np.fromiter(map(len, self.number), dtype=np.int64, count=len(self.number))
        least = max(2, int(np.sort(self.uses)[-self.remembered // 2])) if len(self.uses) > self.remembered // 2 else 2
        keep = np.flatnonzero((self.uses > least) & (sizes < 200))[: self.remembered // 2]
        names = list(self.number)
        self.number = _Numbers((names[k], n) for n, k in enumerate(keep))
        self.texts = [self.texts[k] for k in keep]
        n = self.facts[keep, 3]
        self.codes = self.codes[np.arange(n.sum()) + np.repeat(self.starts[keep] - (n.cumsum() - n), n)]
        self.facts, self.starts, self.uses = self.facts[keep], n.cumsum() - n, self.uses[keep] // 2
        self.held = int(sizes[keep].sum())

    def cut(self, text: str) -> Iterator[list[str]]:
        """Lists of a text's segments."""
        if self.whole:
            yield [text]
        elif OTHER_WHITE.search(text):
            yield CAREFUL.split(text)
        elif len(text) < LONG:
            yield SEGMENT.findall(text)
        else:
            found = (m.group() for m in SEGMENT.finditer(text))
            while part := list(itertools.islice(found, 100_000)):
                yield part

    def numbers(self, part: list[str]) -> np.ndarray:
        return np.array(list(map(self.number.__getitem__, part)), dtype=np.int64)

    def learn(self) -> None:
        """Makes the tokens of the segments that are new."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        ia = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        if self.whole:
            ib = self.b.encode([s[1:] for s in new], num_threads=1)
        else:  # behind a letter the model adds no space
            ib = [x[self.skip :] for x in self.b.encode(["a" + s for s in new], num_threads=1)]
        raw = [s.encode() for s in new]
        same = self._same(ia, ib, raw)
        for k in np.flatnonzero(~same):
            ia[k], ib[k] = [], []
        na, nb = (np.fromiter(map(len, x), dtype=np.int64, count=len(new)) for x in (ia, ib))
        a, b = (np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((ia, na), (ib, nb)))
        ends_a, ends_b = self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum()
        ends = np.union1d(ends_a, ends_b)  # behind each overlap of two tokens
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        owner_a = np.repeat(np.arange(len(new)), na)
        links = np.bincount(owner_a[at_a], minlength=len(new))
        both = np.isin(ends_a, ends_b, assume_unique=True)
        groups = np.bincount(owner_a[both], minlength=len(new))
        codes = ((b[at_b] % STRIPES) * self.rows + b[at_b] // STRIPES) * self.n_a + a[at_a]
        # ids in the order in which they are written: by group, A before B
        group, side, ids = (np.concatenate(x) for x in ((np.searchsorted(ends_a[both], ends_a), np.searchsorted(ends_a[both], ends_b)), (np.zeros(len(a), np.int64), np.ones(len(b), np.int64)), (a, b)))
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], ids[order]
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        written = self.marks[mark * (len(self.marks) // 3) + ids].tolist()
        to = [0, *(na + nb).cumsum().tolist()]
        self.texts += ["".join(written[x:y])[:-1] for x, y in zip(to, to[1:])]
        self.held += sum(map(len, raw))
        self.facts = np.concatenate([self.facts, np.stack([na, nb, groups, links, same], axis=1)])
        self.starts = np.concatenate([self.starts, len(self.codes) + links.cumsum() - links])
        self.codes = np.concatenate([self.codes, codes])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])

    def _same(self, ia: list, ib: list, raw: list[bytes]) -> np.ndarray:
        """Whether both tokenizers' bytes are the segment's."""
        sizes = list(map(len, raw))
        flat = b"".join(raw)
        for ids, names in ((ia, self.a_bytes), (ib, self.b_bytes)):
            if [sum(map(len, map(names.__getitem__, x))) for x in ids] != sizes or b"".join(map(names.__getitem__, itertools.chain.from_iterable(ids))) != flat:
                return np.array([b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(ia, ib, raw)], dtype=bool)
        return np.ones(len(raw), dtype=bool)


@functools.cache
def segments(a_path: str, b_path: str) -> Segments:
    """A worker's own, kept from task to task. Files that the driver has sent are where it has put them."""
    found = [SparkFiles.get(os.path.basename(p)) for p in (a_path, b_path)]
    return Segments(*[f if os.path.exists(f) else p for f, p in zip(found, (a_path, b_path))])


class _Batches:
    """Rows of kind 0, one for each document, and of kind 1, links by batch and stripe."""

    def __init__(self, s: Segments, first_key: int):
        self.s, self.key, self.docs = s, first_key, 0
        self.numbers, self.owners, self.links = [], [], 0

    def add(self, texts: list[str | None]) -> Iterator[dict]:
        """Rows of the texts; new segments of many short texts get their tokens together."""
        waiting, chars = [], 0
        for text in texts:
            if text and len(text) >= LONG:
                yield from self._made(waiting)
                yield self._long(text)
                waiting, chars = [], 0
                continue
            waiting.append(text)
            chars += len(text or "")
            if chars > LONG:
                yield from self._made(waiting)
                waiting, chars = [], 0
        yield from self._made(waiting)

    def _row(self) -> dict:
        self.docs += 1
        return {"kind": 0, "key": self.key, "idx": self.docs - 1, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}

    def _made(self, texts: list[str | None]) -> Iterator[dict]:
        s = self.s
        own = [s.numbers(next(s.cut(" " + t))) if t else None for t in texts]
        s.learn()
        for numbers in own:
            row = self._row()
            if numbers is not None:
                facts = s.facts[numbers]
                if facts[:, 4].all():
                    self._keep(row, [numbers], facts.sum(axis=0), hashlib.sha256(";".join(map(s.texts.__getitem__, numbers.tolist())).encode()))
            yield row

    def _long(self, text: str) -> dict:
        """The same for a text whose segments come in parts."""
        s, row = self.s, self._row()
        facts, digest, kept, between = np.zeros(5, dtype=np.int64), hashlib.sha256(), [], ""
        for part in s.cut(" " + text):
            kept.append(s.numbers(part))
            s.learn()
            f = s.facts[kept[-1]]
            if not f[:, 4].all():
                return row
            facts += f.sum(axis=0)
            digest.update((between + ";".join(map(s.texts.__getitem__, kept[-1].tolist()))).encode())
            between = ";"
        self._keep(row, kept, facts, digest)
        return row

    def _keep(self, row: dict, numbers: list[np.ndarray], facts: np.ndarray, digest) -> None:
        self.numbers += numbers
        self.owners.append((row["idx"], sum(map(len, numbers))))
        self.links += int(facts[3])
        row |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), facts.tolist())) | {"groups_sha256": digest.hexdigest()}

    def flush(self) -> Iterator[dict]:
        """The held links, a row for each stripe and at most about HELD of them."""
        s = self.s
        if self.links:
            w = np.concatenate(self.numbers)
            s.uses += np.bincount(w, minlength=len(s.uses))
            owner = np.repeat([d for d, _ in self.owners], [n for _, n in self.owners])
            ends = s.facts[w, 3].cumsum()
            for k in range(0, int(ends[-1]), HELD):
                a, z = np.searchsorted(ends, [k, k + HELD], side="right")
                yield from self._rows(w[a:z], owner[a:z])
        self.numbers, self.owners, self.links = [], [], 0
        s.forget()

    def _rows(self, w: np.ndarray, owner: np.ndarray) -> Iterator[dict]:
        s = self.s
        n = s.facts[w, 3]
        total = int(n.sum())
        if not total:
            return
        at = np.arange(total) + np.repeat(s.starts[w] - (n.cumsum() - n), n)
        keys, times = np.unique(s.codes[at] * BATCH + np.repeat(owner, n), return_counts=True)
        codes = keys // BATCH
        width = s.rows * s.n_a
        edges = np.searchsorted(codes, np.arange(STRIPES + 1) * width)
        for stripe in np.flatnonzero(edges[1:] > edges[:-1]):
            x, z = edges[stripe], edges[stripe + 1]
            own, docs, t = codes[x:z] - stripe * width, keys[x:z] % BATCH, times[x:z]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            per = np.diff(np.r_[first, len(own)])
            yield {"kind": 1, "key": self.key, "stripe": int(stripe), "sums": pack(np.diff(own[first], prepend=0), np.add.reduceat(t, first)), "links": pack(per, docs, t)}

    def next(self) -> None:
        self.key, self.docs = self.key + 1, 0


DOC = ("key", "idx", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
LINKED = "kind int, key long, idx int, {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, sums binary, links binary"


def linked(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind 0, a document's numbers, and of kind 1, links of a batch of documents in a stripe: sums (pairs and how often they are linked) and links (each pair's documents and times)."""
    spark = docs.sparkSession
    for p in (a_path, b_path):
        spark.sparkContext.addFile(p)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("idx", pa.int32()), ("id", to_arrow_type(kind)), *[(c, pa.int64()) for c in DOC[2:6]], ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("sums", pa.binary()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, held = _Batches(segments(a_path, b_path), TaskContext.get().partitionId() << 33), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0

        for b in batches:
            for k in range(0, b.num_rows, ADDED):
                part = b.slice(k, ADDED)
                ids = iter(part.column(0).to_pylist())
                for row in out.add(part.column(1).to_pylist()):
                    rows.append(row | {"id": next(ids)})
                full = out.docs + ADDED > BATCH  # record batches end within ADDED, so counts of documents aren't its multiples
                if out.links >= HELD or full:
                    for r in out.flush():
                        rows.append(r)
                        held += len(r["sums"]) + len(r["links"])
                        if held > 8 << 20:
                            yield from sent()
                if full:
                    out.next()
                if len(rows) >= 2048:
                    yield from sent()
        rows += out.flush()
        yield from sent()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, LINKED.format(id=f"id {kind.simpleString()}"))


def _summed(shape: tuple[int, int], final: bool):
    """Sorted partial sums of stripes to one row for each: a dense block, to which they are added."""
    rows, n_a = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe, part = np.zeros(rows * n_a, dtype=np.int64), None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(block)
            n = block[at]
            best = n == block.reshape(rows, n_a).max(axis=1)[at // n_a] if final else np.zeros(len(at), dtype=np.int64)
            block[at] = 0
            return pa.RecordBatch.from_pylist([{"stripe": stripe, "part": part, "sums": pack(np.diff(at, prepend=0), n, best.astype(np.int64))}], pa.schema([("stripe", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]))

        for b in batches:
            for x in b.to_pylist():
                if (x["stripe"], x["part"]) != (stripe, part):
                    if stripe is not None:
                        yield done()
                    stripe, part = x["stripe"], x["part"]
                steps, n = unpack(x["sums"])[:2]
                np.add.at(block, steps.cumsum(), n)
        if stripe is not None:
            yield done()

    return run


def counted(links: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """stripe, sums: each stripe's pairs with their counts and whether they are best. shape: B ids of a stripe, A ids."""
    spark = links.sparkSession
    n = links.filter("kind = 1").groupBy("stripe").count().agg(F.max("count")).first()[0] or 0
    d = links.filter("kind = 1").select("stripe", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // SUMS)))).cast("int").alias("part"), "sums")
    for final in (False, True) if n > SUMS else (True,):
        d = d if not final else d.withColumn("part", F.lit(0))
        dealt = d.repartition(partitions(spark), "stripe", "part").sortWithinPartitions("stripe", "part")
        d = dealt.mapInArrow(_summed(shape, final), "stripe int, part int, sums binary")
    return d.select("stripe", "sums")


def _by_stripe(stripe: Column, values: dict[int, int]) -> Column:
    """An integer for each stripe, from STRIPES literals."""
    return F.element_at(F.array(*[F.lit(values.get(k, 1)) for k in range(STRIPES)]), stripe + 1)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stripe's counts, then its links: sums of each batch's documents."""
    codes = counts = best = None
    for b in batches:
        rows = []
        for x in b.to_pylist():
            if x["kind"] == 0:
                steps, counts, best = unpack(x["sums"])
                codes = steps.cumsum()
                continue
            own = np.searchsorted(codes, unpack(x["sums"])[0].cumsum())
            per, docs, times = unpack(x["links"])
            n, top = np.repeat(counts[own], per), np.repeat(best[own], per)
            who, at = np.unique(docs, return_inverse=True)
            sums = np.zeros((2, len(who)), dtype=np.int64)
            np.add.at(sums[0], at, times * top)
            np.add.at(sums[1], at, times * n)
            rows.append({"key": x["key"], "scores": pack(np.diff(who, prepend=0), sums[0], sums[1])})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("scores", pa.binary())]))


def scores(links: DataFrame, counts: DataFrame) -> DataFrame:
    """key, scores: of a batch's documents in one stripe the links that are best and the sum of the links' counts."""
    spark = links.sparkSession
    own = links.filter("kind = 1")
    sizes = own.groupBy("stripe").agg(F.sum(F.length("sums") + F.length("links")).alias("n")).collect()  # a row for each stripe
    parts = {r["stripe"]: max(1, -(-r["n"] // PART)) for r in sizes}
    n = lambda: _by_stripe(F.col("stripe"), parts)
    a = own.select("stripe", F.pmod(F.xxhash64("key"), n()).cast("int").alias("part"), F.lit(1).alias("kind"), "key", "sums", "links")
    b = counts.select("stripe", F.explode(F.sequence(F.lit(0), n() - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), "sums", F.lit(None).cast("binary").alias("links"))
    dealt = a.unionByName(b).repartition(partitions(spark), "stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    return dealt.select("kind", "key", "sums", "links").mapInArrow(_scored, "key long, scores binary")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's scores, then its documents, which get their sums."""
    key, sums = None, np.zeros((2, BATCH), dtype=np.int64)
    for b in batches:
        keys, kinds = b.column("key").to_numpy(), b.column("kind").to_numpy()
        edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])]) if b.num_rows else []
        for a, z in zip(edges, [*edges[1:], b.num_rows]):
            if keys[a] != key:
                key, sums[:] = keys[a], 0
            part = b.slice(a, z - a)
            if kinds[a] == 0:
                for raw in part.column("scores").to_pylist():
                    steps, best, total = unpack(raw)
                    sums[:, steps.cumsum()] += np.stack([best, total])
            else:
                own = sums[:, part.column("idx").to_numpy()]
                names = ["id", *DOC[2:]]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(own[0]), pa.array(own[1])], [*names, "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links that are best for their B id), count_sum (over links)."""
    spark = docs.sparkSession
    links = materialise(linked(docs, a_path, b_path, id_col, text_col), "token_links")
    vocabulary = Segments(a_path, b_path)
    counts = materialise(counted(links, (vocabulary.rows, vocabulary.n_a)), "token_counts")
    found = scores(links, counts).withColumn("kind", F.lit(0))
    own = links.filter("kind = 0").select(*DOC, "id").withColumn("kind", F.lit(1))
    both = found.unionByName(own, allowMissingColumns=True).repartition(partitions(spark), "key").sortWithinPartitions("key", "kind")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(_gathered, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col)


def best_pairs(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """b_id, a_id, n, best: every linked pair of ids with its count."""
    s = Segments(a_path, b_path)
    n_a = s.n_a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                steps, n, best = unpack(x["sums"])
                at = steps.cumsum()
                yield pa.RecordBatch.from_arrays([pa.array(at // n_a * STRIPES + x["stripe"]), pa.array(at % n_a), pa.array(n), pa.array(best == 1)], ["b_id", "a_id", "n", "best"])

    links = materialise(linked(docs, a_path, b_path, id_col, text_col), "token_links")
    return counted(links, (s.rows, n_a)).mapInArrow(run, "b_id long, a_id long, n long, best boolean")
