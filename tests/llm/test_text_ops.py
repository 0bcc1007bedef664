"""Mixing, decontamination, line and suffix dedup, near-duplicates against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandjoin.llm import decontaminate as D
from strandjoin.llm import line_dedup as L
from strandjoin.llm import near_dup as N
from strandjoin.llm.components import components
from strandjoin.llm.induced import sorted_suffixes
from strandjoin.llm.mixing import mix, mixed_documents
from strandjoin.llm.runs import key_runs
from strandjoin.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, source string, key string, size int"


def docs(spark, rows):
    """rows of (doc_id, text[, source]); with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 7) for r in rows], DOCS).repartition(3)


def test_key_runs_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(5 if rng.random() < 0.6 else rng.randrange(40), 0, i) for i in range(400)]
    want = collections.Counter(r[0] for r in rows)
    first = {k: min(r[2] for r in rows if r[0] == k) for k in want}
    df = spark.createDataFrame(rows, "k1 long, k2 long, id long")
    for n in (2, 10):
        got = key_runs(df, ["id"], n, "id").collect()
        assert len(got) == len(rows)
        assert all(r["run_big"] == (want[r["k1"]] >= n) and r["run_first"] == first[r["k1"]] for r in got)
    assert key_runs(df.limit(0), ["id"], 2, "id").count() == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    rows += [(None, "x y z", "b"), (3, None, "a"), (3, "  \t\n", "a"), (4, "q r", "b"), (4, "q r", "b")]
    got = mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(r["parts"]) == r["taken"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in got)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    free = [s for s in size if target[s] < 3 * size[s] - 1e-9]
    assert len({round(target[s] / weight[s], 6) for s in free}) == 1
    assert sum(taken.values()) == sum(size.values())
    # the queue decides: a packet at most from the targets, and not to the word
    assert all(abs(taken[s] - target[s]) <= 64 for s in size)
    again = mix(docs(spark, rows).repartition(5)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(again)
    assert mix(docs(spark, rows).limit(0)).count() == 0
    out = mixed_documents(docs(spark, rows))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    texts = {t for _, t, _ in rows}
    out = out.collect()
    assert all(r["text"] in texts for r in out)
    assert abs(sum(len(r["text"].split()) for r in out) - sum(taken.values())) <= 30 * len(size)


def queue_expected(rows, packet, epochs=3):
    """Words taken of each (doc_id, text), by a list of all packets sorted by finish time."""
    words = lambda t: len((t or "").split())
    ranks = {s: k for k, s in enumerate(sorted({r[2] for r in rows}, key=lambda s: (s is None, s or "")))}
    weight = {s: (5, 2, 1)[k % 3] for s, k in ranks.items()}
    packets = []
    for s in ranks:
        at = 0
        for e in range(epochs):
            mine = sorted((hashlib.md5(f"mix/{e}/{'' if d is None else d}/{hashlib.md5((t or '').encode()).hexdigest()[:16]}".encode()).hexdigest(), k) for k, (d, t, x) in enumerate(rows) if x == s)
            for _, k in mine:
                n = words(rows[k][1])
                for a in range(0, n, packet):
                    w = min(packet, n - a)
                    at += w
                    packets.append((at / weight[s], ranks[s], k, w))
    left, taken = sum(words(r[1]) for r in rows), collections.Counter()
    for _, _, k, w in sorted(packets):
        taken[k] += min(w, left)
        left -= min(w, left)
    return sorted((str(rows[k][0]), words(rows[k][1]), taken[k]) for k in range(len(rows)))


def test_mix_is_what_the_queue_serves(spark):
    rng = random.Random(21)
    rows = [(i, " ".join("w" for _ in range(rng.choice([3, 20, 150, 900]))), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(90)]
    rows += [(None, "x y z", "b"), (None, "x y", "b"), (None, "x y z", "b"), (3, None, "a")]
    for packet in (64, 7):
        got = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mix(docs(spark, rows), packet=packet).collect())
        assert got == queue_expected(rows, packet)


ITEM = "When John Smith has 5 apples and gives Mary 3 apples of 12 kg each before John goes home again"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "the quick brown fox jumps over the lazy dog near the river bank"), (2, "the quick brown fox jumps over the lazy dog near the river bank"), (3, None), (None, "short one")], "item_id long, text string")
    rows = [
        (10, "Well then. when John Smith has 5 apples and gives Mary 3 apples of 12 kg each before John goes home again, they say"),
        (11, "Now when Peter Jones has 7 apples and gives Anna 4 apples of 30 lb each before Peter goes home again."),
        (12, "Now when Peter Jones has 7 apples and gives Anna 4 apples of 30 lb each before Robert goes home again."),
        (13, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG NEAR THE RIVER BANK"),
        (14, "nothing of the kind is here"), (15, None), (16, ""), (None, "x the quick brown fox jumps over the lazy dog near the river bank"), (13, "again the quick brown fox jumps over the lazy dog near the river bank"),
    ]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in D.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(10, 1, False), (11, 1, True), (13, 2, False), (None, 2, False)}
    left = D.decontaminate(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [12, 14, 15, 16] and left.columns == docs(spark, []).columns
    # copies in other case match as they are; so do numbers alone, and items under a window
    bench = spark.createDataFrame([(1, ITEM), (4, "12 34 56 78 90 11 22"), (5, "Is it so?")], "item_id long, text string")
    rows = [(1, "x " * 200_000 + ITEM.upper()), (2, ITEM.lower()), (3, "a 12 34 56 78 90 11 22 b"), (4, "a 12 34 56 78 91 11 22 b"), (5, "well, is it so or not"), (6, "is it not so"), (7, "12 35 56 79 90 12 22")]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 4), (5, 5)}
    assert D.contaminated(docs(spark, []), bench).count() == 0
    assert D.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_equal_chunks_are_coded_once(monkeypatch):
    """Texts' tokens are made together, and of equal chunks once; how texts are put together changes nothing."""
    calls, plain = [], D.token_code
    monkeypatch.setattr(D, "token_code", lambda t: calls.append(t) or plain(t))
    got = list(D.templates(pa.array(["one two, Three", None, "one two, Three one"] * 40)))
    assert sorted(calls) == ["Three", "one", "two"] and [len(t) for t, _, _ in got[:3]] == [3, 0, 4]
    rng = random.Random(8)
    texts = ["".join(rng.choice(["5 km ", "Mary ", "he ", "THE", "\n", " ", "1.5,3", ". ", "\xe9_\u0130"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    alone = [next(D.templates(pa.array([t]))) for t in texts]
    for part in (1, 50, 1 << 20):
        monkeypatch.setattr(D, "PART", part)
        together = list(D.templates(pa.array(["x", *texts, None]).slice(1, 300)))
        assert all(np.array_equal(a, b) for x, y in zip(alone, together, strict=True) for a, b in zip(x, y, strict=True))


def contaminated_expected(rows, items, window, similarity):
    """By comparing every window of every document with every window of every item, on strings."""

    def tokens(text):
        out, start = [], True
        for m in re.finditer(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:;|\n]", text):
            x = m[0]
            if x in ".!?:;|\n":
                start = True
                continue
            kind = "word"
            if x[0].isdigit():
                kind = "number"
            elif len(x) > 1 and x[0].isupper() and x[1:].islower() and not start:
                kind = "name"
            elif x.lower() in D.UNITS and out and out[-1][0] == "number" and not start:
                kind = "unit"
            out.append((kind, x.lower()))
            start = False
        return out

    shape = lambda t: [k if k != "word" else x for k, x in t]
    found = set()
    for i, item in items:
        a = tokens(item)
        literal = [sum(k == "word" for k, _ in a[p : p + window]) for p in range(len(a) - window + 1)]
        good = [p for p, n in enumerate(literal) if n >= 2]
        for d, text in rows:
            b = tokens(text)
            hits = collections.defaultdict(set)
            for p in good or range(len(literal)):
                for q in range(len(b) - window + 1):
                    x, y = a[p : p + window], b[q : q + window]
                    if (p in good and shape(x) == shape(y)) or [t for _, t in x] == [t for _, t in y]:
                        hits[q - p].add(p)
            matched, differs = set(), False
            for shift, places in hits.items():
                value, broken = {}, set()
                for k in sorted({k for p in places for k in range(p, p + window) if a[k][0] != "word"}):
                    mine, theirs = a[k][1], b[k + shift][1]
                    differs |= mine != theirs
                    if value.setdefault(mine, theirs) != theirs:
                        broken.add(k)
                matched |= {p for p in places if not broken & set(range(p, p + window))}
            n = len(good) or len(literal)
            if n > 0 and len(matched) >= similarity * n:
                found.add((d, i, len(matched), n, differs))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(41)
    names, nums, words = ["Ann", "Bob", "Carl"], ["3", "4", "1.5"], ["has", "and", "gives", "kg", "to", "the", "apples"]
    sentence = lambda: " ".join(rng.choice(rng.choice([names, nums, words, words])) for _ in range(rng.randint(4, 14))) + rng.choice([".", "", "!"])
    items = [(i, " ".join(sentence() for _ in range(rng.randint(1, 2)))) for i in range(12)]
    rows = []
    for k in range(70):
        text = rng.choice(items)[1]
        for old, new in ((n, rng.choice(names)) for n in names if rng.random() < 0.5):
            text = text.replace(old, new)
        if rng.random() < 0.5:
            text = text.replace(rng.choice(nums), rng.choice(nums))
        if rng.random() < 0.3:
            text = text.upper() if rng.random() < 0.5 else text.lower()
        rows.append((k, f"{sentence()} {text} {sentence()}"))
    for window, similarity in ((5, 0.8), (3, 0.5)):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"], r["n_matched"], r["n_windows"], r["reparameterised"]) for r in D.contaminated(docs(spark, rows), bench, window, similarity, min_tokens=window).collect()}
        want = contaminated_expected(rows, items, window, similarity)
        assert got == want and len({x[4] for x in want}) == 2


def lines_expected(rows, n):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    at = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            at[low(x.strip(strip))].add((d, t or ""))
    hot = {k for k, v in at.items() if k and len(v) >= n}
    out = []
    for d, t in rows:
        xs = (t or "").split("\n")
        kept = [x for x in xs if low(x.strip(strip)) not in hot]
        out.append((d, len(xs), len(xs) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = ["Hot line", " hot LINE\t", "É big", "é big", "", "  ", "rare", "x" * 5000]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(0, 12)))) for i in range(60)] + [(7, None), (None, "hot line\nz"), (None, "hot line\nz"), (8, "\n")]
    for n in (3, 10):
        got = L.apply_bitmaps(docs(spark, rows), L.line_dedup(docs(spark, rows), min_docs=n), digest=True).collect()
        key = lambda r: str(tuple(r))
        assert sorted((tuple(r) for r in got), key=key) == sorted(lines_expected(rows, n), key=key)
    first = L.apply_bitmaps(docs(spark, [(1, "a\nb\na"), (2, "B\nc"), (3, "a")]), L.line_dedup(docs(spark, [(1, "a\nb\na"), (2, "B\nc"), (3, "a")]), min_docs=1, keep_first=True))
    assert {r["doc_id"]: r["text"] for r in first.collect()} == {1: "a\nb", 2: "c", 3: ""}
    assert L.line_dedup(docs(spark, [])).count() == 0


def test_induced_sorting():
    rng = random.Random(4)
    for k in range(300):
        n, top = rng.randint(1, 60), rng.choice([1, 2, 3, 5])
        t = [rng.randint(1, top) for _ in range(n)]
        t = (t * 3)[:n] if k % 5 == 0 else t
        got, lcp = [], []
        for p, x in sorted_suffixes(np.array(t), 7, memory=rng.choice([0, 100, 1 << 20]), base=rng.choice([0, 1, 4, 1000])):
            got += p.tolist()
            lcp += x.tolist()
        assert got == sorted(range(n), key=lambda i, t=t: t[i:], reverse=True)
        common = lambda a, b: next((x for x in range(7) if a + x >= n or b + x >= n or t[a + x] != t[b + x]), 7)  # noqa: B023, E731
        assert lcp[1:] == [common(a, b) for a, b in zip(got, got[1:], strict=False)]


def spans_expected(rows, length):
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[d, t] = (d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return [out[d, t or ""] for d, t in rows]


@pytest.mark.parametrize("case", range(3))
def test_suffix_dedup(spark, case):
    rng = random.Random(case)
    base = "".join(rng.choice("abcé \0") for _ in range(400))
    rows = [(i, base[(a := rng.randrange(380)) : a + rng.randint(0, 120)] + rng.choice(["", "zz", "é" * 30]) + base[(b := rng.randrange(380)) : b + rng.randint(0, 60)]) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 500), (102, "ab" * 100), (103, rows[5][1]), (104, "")]
    if case:
        rows += [(105, None), (None, rows[3][1])]
    if case == 2:
        rows += [rows[7], rows[7]]
    key = lambda r: str(tuple(r))
    for most in (20_000, 3):  # the second has its hot minimizers' windows dealt out
        got = suffix_dedup(docs(spark, rows), length=20, gram=8, memory=2000, most_pieces=most).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(spans_expected(rows, 20), key=key)
    assert suffix_dedup(docs(spark, []), length=20, gram=8).count() == 0


def test_suffix_dedup_with_the_parameters_in_use(spark):
    """Length 100, gram 32, and queues that hold far less than a shard."""
    rng = random.Random(8)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(90))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(rng.randint(0, 200)) + rng.choice([passage[(a := rng.randrange(500)) : a + 200], phrase + noise(9), ""]) + noise(30)) for i in range(150)]
    rows += [(900, "ab" * 400), (901, "xab" * 300), (902, passage + passage)]
    key = lambda r: str(tuple(r))
    for memory in (10_000, 64 << 20):
        got = suffix_dedup(docs(spark, rows), memory=memory).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(spans_expected(rows, 100), key=key)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(9, 9), (500, 501), (500, 501)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def near_expected(rows, words):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(*(w[j:] for j in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for g in range(4):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(14):  # copies with up to a fifth of their words changed: stars, chains and mere relatives
            w = [x if rng.random() > 0.06 * g else word() for x in base]
            rows.append((len(rows), " ".join(w)))
    rows += [(100, "One"), (101, "one "), (102, ""), (103, None), (104, rows[3][1].upper()), (105, "a b"), (106, "A\tb"), (107, "b a")]
    want = near_expected(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs(spark, rows), words=2).collect()}
    assert got == want
    more = [*rows, (None, rows[0][1]), rows[1]]
    got = N.near_duplicates(docs(spark, more), words=2).collect()
    assert len(got) == len(more)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(d, v[1]) for d, v in want.items()}
    left = N.near_dedup(docs(spark, rows), words=2)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, v in want.items() if v[2]) and left.columns == docs(spark, []).columns
    assert N.near_duplicates(docs(spark, [])).count() == 0


def test_relatives_in_blocks(spark):
    """Buckets dealt in blocks give the same links."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(x if rng.random() > 0.09 else f"c{i}{k}" for k, x in enumerate(base))) for i in range(40)]
    texts = docs(spark, rows).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    first = N.map_batches(texts, N._sign(2, 20), N.SIGNED)
    buckets = N.map_batches(first.select("doc_id", "sig"), N._keys(20), "k1 long, k2 long, id long, slot int")
    none = spark.createDataFrame([], "u long, v long")
    want = near_expected(rows, 2)
    for most in (4_000, 7):
        links = N.across(buckets, none, first, texts, 2, 80, 20, most)
        got = {r["node"]: r["component"] for r in components(links).collect()}
        assert {d: got.get(d, d) for d, _ in rows} == {d: v[1] for d, v in want.items()}


def test_blocks_of_one_component_are_not_paired(spark):
    rows = [(1, 0, i, 0, 10) for i in range(400)] + [(1, 0, 1000 + i, 1000 + i // 3, 10) for i in range(30)] + [(2, 1, i, i, 10) for i in range(5)] + [(3, 1, i, 7, 10) for i in range(50)]
    placed = spark.createDataFrame(rows, "k1 long, slot int, id long, component long, n_shingles long")
    got = N.blocks(placed, 40, 10_000).collect()
    assert {r["k1"] for r in got} == {1, 2}
    runs = {}
    for r in got:
        runs.setdefault((r["k1"], r["pa"], r["pb"]), []).append(r)
    met = {(k1, *sorted((x["id"], y["id"]))) for (k1, a, b), m in runs.items() for x in m for y in m if x["id"] < y["id"] and x["component"] != y["component"] and (a == b or x["block"] != y["block"])}
    component = {(k, i): c for k, _, i, c, _ in rows}
    assert met == {(k, i, j) for k, i in component for m, j in component if k == m and i < j and component[k, i] != component[k, j]}
    # the large component's members go to the one block of the others, not to the nine of their own
    assert sum(r["id"] < 400 and r["k1"] == 1 for r in got) == 400
    tight = N.blocks(placed, 40, 100).collect()  # long documents make more blocks
    assert len({(r["pa"], r["pb"]) for r in tight if r["k1"] == 1}) > len({(r["pa"], r["pb"]) for r in got if r["k1"] == 1})
    assert N.blocks(placed.limit(0), 40, 100).count() == 0


def test_workers_keep_no_words(spark):
    """What a task remembers of words goes with it, and isn't more than two generations."""

    def kept(batches):
        import gc

        gc.collect()
        yield from (b for b in batches if not b.num_rows)
        n = sum(len(x) for x in gc.get_objects() if isinstance(x, dict) and type(x).__module__.startswith("strandjoin.llm"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["id"])

    rows = docs(spark, [(i, f"w{i} v{i} u{i} t{i} s{i}") for i in range(3000)])
    assert N.near_dedup(rows).count() == 3000
    assert D.decontaminate(rows, spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string")).count() == 3000
    assert {r["id"] for r in spark.range(8, numPartitions=8).mapInArrow(kept, "id long").collect()} == {0}
    memo = N.WordHashes(most=10)
    assert [memo[b"%d" % i] for i in range(100)] == [N.WordHashes()[b"%d" % i] for i in range(100)]
    assert len(memo) + len(memo.older) <= 20
