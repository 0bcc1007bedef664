"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words within a sentence) and units after a number become typed
placeholders; words are lower-cased and punctuation goes. Windows of `window` template tokens of whole
documents are hash-joined with the benchmark's, and so are windows of the tokens as they are but for
their case, by which a copy in capitals or without any matches too. Matches on the same diagonal
(document position minus item position) count only if their slots are consistent: wherever a number,
name or unit of the item recurs, the document has one value for it. A document is contaminated by an
item if the windows matched so are at least `similarity` of the item's; it is re-parameterised if a
slot differs. Windows with fewer than two literal words match as they are only, as any table of
numbers would match their template; they count where an item has no others.

The join is Spark's. Before it, documents drop the windows that a bitmap of the benchmark's hashes
(2^BITS bits, whatever the benchmark's size) excludes. Items under `window` tokens match as a whole
and as they are, from min_tokens on. Null and empty texts match nothing; null ids and repeated rows
are rows like any other (repeated items are one); very long texts are many windows. Columns that are
named as the operator's stay as they are. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialise, unique_ids

FOUND = "doc_id long, item_id long, n_matched int, n_windows int, similarity double, reparameterised boolean"
PIECE = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:;|\n]| ")
#: Bytes of texts whose tokens are made together.
PART = 4 << 20
#: A chunk's end among tokens' codes, of none of their kinds.
SPACE = 5
# Units that become placeholders after a number.
UNITS = frozenset("mm cm dm m km mg g kg t ml cl dl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years inch inches ft foot feet yard yards mile miles oz ounce ounces lb lbs pound pounds percent dollar dollars usd eur euro euros cent cents gbp mph kmh kwh wh w kw mw v kv a ma hz khz mhz ghz c f k b kb mb gb tb bit bits byte bytes litre litres liter liters meter meters metre metres gram grams kilogram kilograms kilometer kilometers tonne tonnes".split())
END, NUMBER, NAME, UNIT = (xxhash.xxh3_64_intdigest(x) | 1 for x in ("\0end", "\0number", "\0name", "\0unit"))
MULT = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


def token_code(token: str) -> int:
    """hash << 3 | kind: kind 0 a word, 1 a number, 2 capitalised, 3 a possible unit, 4 an end of a sentence."""
    low, c = token.lower(), token[0]
    if c in ".!?:;|\n":
        kind = 4
    elif c.isdigit():
        kind = 1
    elif len(token) > 1 and c.isupper() and token[1:].islower():
        kind = 2
    else:
        kind = 3 if low in UNITS else 0
    return (xxhash.xxh3_64_intdigest(low) << 3 & 0xFFFFFFFFFFFFFFFF) | kind


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the texts' tokens, one text after the other, and where each text's begin (and the last one's end).

    Texts are cut at spaces, and of equal chunks one is looked at.
    """
    chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n "), " ")
    per = chunks.flatten().dictionary_encode()
    found = PIECE.findall("".join([f"{c} " for c in per.dictionary.to_pylist()]))
    raw = np.array([SPACE if t == " " else token_code(t) for t in found], np.uint64)
    ends = np.flatnonzero(raw == SPACE)
    first = np.concatenate([[0], ends + 1])
    which = per.indices.to_numpy()
    n = np.diff(first)[which] - 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = raw[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])]
    starts = np.asarray(chunks.offsets) - chunks.offsets[0].as_py()
    return out, at[starts]


def templates(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(template hashes, original hashes, slot flags) of each text's tokens."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    # so many bytes of texts at a time that their chunks are little memory
    group = np.cumsum(size) // PART
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        raw, starts = text_codes(texts.slice(a, b - a))
        for x, y in zip(starts.tolist(), starts[1:].tolist()):
            yield template(raw[x:y])


def template(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, original hashes, slot flags) of a text's codes."""
    kind = (raw & np.uint64(7)).astype(np.int8)
    end = kind == 4
    opens = np.ones(len(raw), bool)  # the first token of a sentence is capitalised anyway
    opens[1:] = end[:-1]
    number_before = np.zeros(len(raw), bool)
    number_before[1:] = kind[:-1] == 1
    own = raw >> np.uint64(3)
    name, unit, number = (kind == 2) & ~opens, (kind == 3) & number_before, kind == 1
    out = own.copy()
    out[number], out[name], out[unit] = NUMBER, NAME, UNIT
    keep = ~end
    return out[keep], own[keep], (number | name | unit)[keep]


def windows(t: np.ndarray, w: int) -> np.ndarray:
    """Hashes of the windows of w tokens."""
    n = len(t) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(w):
            h = (h ^ (h >> np.uint64(29))) * MULT + t[k : k + n]
        h = (h ^ (h >> np.uint64(32))) * MULT
        return h ^ (h >> np.uint64(29))


def literals(slot: np.ndarray, w: int) -> np.ndarray:
    """How many tokens of each window of w aren't slots."""
    return np.convolve(~slot, np.ones(w, int), "valid")


ITEM_ROWS = "item long, item_id long, n int, w int, h long, p int, mine array<long>, slot array<boolean>"
DOC_ROWS = "doc long, w int, h long, d int, theirs array<long>"
AS_IS = np.uint64(0xD6E8FEB86659FD93)


def item_windows(items: DataFrame, window: int, min_tokens: int) -> DataFrame:
    """A row for each window of each item and hash that it is looked up by. items: item (unique), item_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, (t, own, slot) in zip(batch["item"].to_pylist(), batch["item_id"].to_pylist(), templates(batch["text"]), strict=True):
                w = min(window, len(t))
                if w < min_tokens:
                    continue
                good = literals(slot, w) >= 2 if w == window else np.zeros(len(t) - w + 1, bool)
                places = np.flatnonzero(good) if good.any() else np.arange(len(good))
                for h, at in ((windows(t, w), np.flatnonzero(good)), (windows(own, w) ^ AS_IS, places)):
                    rows += [(item, item_id, len(places), w, int(h[p].view(np.int64)), p, own[p : p + w].view(np.int64), slot[p : p + w]) for p in at.tolist()]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in ITEM_ROWS.split(", ")])

    return items.mapInArrow(run, ITEM_ROWS)


def bitmap(items: DataFrame) -> np.ndarray:
    """Whether a window's hash ends with these BITS bits, of 2^BITS; what comes to the driver has that size."""
    at = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1  # Spark's buckets begin with the value 1
    parts = items.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("at")).groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros(1 << BITS, bool)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        out[(r["b"] - 1) * len(bits) :][: len(bits)] = bits
    return out


def doc_windows(docs: DataFrame, widths: list[int], known) -> DataFrame:
    """The windows of the documents that may be an item's. docs: doc (unique), text; known: a broadcast bitmap."""
    mask = np.uint64((1 << BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            docs, ws, hs, ds, theirs = [], [], [], [], []
            for doc, (t, own, slot) in zip(batch["doc"].to_pylist(), templates(batch["text"]), strict=True):
                for w in widths:
                    if len(t) < w:
                        continue
                    # where no token is a slot a template is the same as the tokens
                    for h in (windows(t, w), windows(own, w) ^ AS_IS):
                        at = np.flatnonzero(bits[(h & mask).astype(np.int64)])
                        if len(at):
                            docs.append(np.full(len(at), doc))
                            ws.append(np.full(len(at), w, np.int32))
                            hs.append(h[at].view(np.int64))
                            ds.append(at.astype(np.int32))
                            theirs.append(own[at[:, None] + np.arange(w)].view(np.int64))
            if docs:
                n = np.concatenate(ws)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([x.ravel() for x in theirs])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(n), pa.array(np.concatenate(hs)), pa.array(np.concatenate(ds)), values], names=[x.split()[0] for x in DOC_ROWS.split(", ")])

    return docs.mapInArrow(run, DOC_ROWS)


def consistent(found: list[dict]) -> tuple[int, bool]:
    """How many of an item's windows the document has with slots that agree on their diagonal; whether a slot differs from the item's. found: p, d, mine, theirs, slot of each match."""
    matched: set[int] = set()
    differs = False
    diagonals: dict[int, list[dict]] = defaultdict(list)
    for m in found:
        diagonals[m["d"] - m["p"]].append(m)
    for matches in diagonals.values():
        slots = {m["p"] + k: (a, b) for m in matches for k, (a, b, s) in enumerate(zip(m["mine"], m["theirs"], m["slot"], strict=True)) if s}
        value: dict[int, int] = {}
        broken: set[int] = set()
        for x in sorted(slots):
            mine, theirs = slots[x]
            if value.setdefault(mine, theirs) != theirs:
                broken.add(x)
            differs |= mine != theirs
        matched |= {m["p"] for m in matches if broken.isdisjoint(range(m["p"], m["p"] + len(m["mine"])))}
    return len(matched), differs


def _verdicts(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
        for batch in batches:
            out = []
            for doc, item_id, n, found in zip(*(batch[c].to_pylist() for c in ("doc", "item_id", "n", "found")), strict=True):
                matched, differs = consistent(found)
                if matched >= similarity * n:
                    out.append((doc, item_id, matched, n, matched / n, differs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float, min_tokens: int) -> DataFrame:
    """FOUND, with docs' key for doc_id. docs: doc (unique), text."""
    spark = docs.sparkSession
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    b = materialise(b.withColumn("item", F.monotonically_increasing_id()), "items")
    items = materialise(item_windows(b, window, min_tokens), "item_windows")
    widths = [r[0] for r in items.select("w").distinct().collect()]  # window and those under it
    known = spark.sparkContext.broadcast(bitmap(items))
    joined = doc_windows(docs, widths, known).join(items, ["h", "w"])
    pairs = joined.groupBy("doc", "item", "item_id", "n").agg(F.collect_set(F.struct("p", "d", "mine", "theirs", "slot")).alias("found"))
    # a pair with too few of the item's windows needs no look at its slots
    pairs = pairs.filter(F.size(F.array_distinct(F.transform("found", lambda m: m["p"]))) >= similarity * F.col("n"))
    return pairs.select("doc", "item_id", "n", "found").mapInArrow(_verdicts(similarity), FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8, min_tokens: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, similarity, reparameterised: a row for each document and item that contaminates it."""
    own = unique_ids(docs, id_col)
    if own:
        return matches(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), benchmark, window, similarity, min_tokens)
    # rows are identified by place, so that null and repeated ids do no harm
    keyed = materialise(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "decontaminate")
    found = matches(keyed, benchmark, window, similarity, min_tokens).withColumnRenamed("doc_id", "doc")
    names = [x.split()[0] for x in FOUND.split(", ")]
    return found.join(keyed.select("doc", F.col("id").alias("doc_id")), "doc").select(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8, min_tokens: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows."""
    row = id_col
    if not unique_ids(docs, id_col):
        row = "__row"
        docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    bad = matches(docs.select(F.col(row).cast("long").alias("doc"), F.col(text_col).alias("text")), benchmark, window, similarity, min_tokens)
    bad = materialise(bad.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    out = docs.join(few(bad), docs[row] == bad["__bad"], "left_anti")
    return out.drop(row) if row == "__row" else out
