"""op12: alignment of two tokenizers, against whole texts encoded by both and links counted in Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandjoin.llm import token_links
from strandjoin.llm.queries import op12_token_alignment
from strandjoin.llm.token_links import align_tokenizers, best_pairs


def brute(texts):
    """By text: n_a, n_b, n_groups, links as pairs of ids, the groups as written."""
    s = token_links.Segments(token_links.A_PATH, token_links.B_PATH)
    out = []
    for text in texts:
        ia = s.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = s.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(s.a_bytes[i] for i in ia) != raw or b"".join(s.b_bytes[i] for i in ib) != raw:
            out.append((0, 0, 0, [], None))
            continue
        spans, ends = [], []
        for ids, names in ((ia, s.a_bytes), (ib, s.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(own)
            ends.append({z for _, z, _ in own})
        links, j = [], 0
        for a0, a1, a in spans[0]:
            while spans[1][j][1] <= a0:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < a1:
                links.append((a, spans[1][k][2]))
                k += 1
        groups, low = [], 0
        for z in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for x, _, i in own if low <= x < z) for own in spans))
            low = z
        out.append((len(ia), len(ib), len(groups), links, ";".join(groups)))
    return out


def expected(texts):
    found = brute(texts)
    count = Counter(x for f in found for x in f[3])
    top = {}
    for (a, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(f[0], f[1], f[2], len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest() if f[4] is not None else "") for f in found], count, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts_of(seed):
    rng = random.Random(seed)
    parts = ["the ", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "​", "\x1c", "▁", "été ", "naïve", "中文 ", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "</s> ", "it's ", "don't", "1234567", " 12,3.5", "....", "é ", "x" * 60, "\x00", "ﬁ ", "Ａ", "antidisestablishmentarianism "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)] + [None, "", " ", "\n", "a", "  a  ", "a b " * 3000, "x" * 20000]


@pytest.mark.parametrize("seed", [1, 2])
def test_align_tokenizers(spark, seed, monkeypatch):
    texts = texts_of(seed)
    want, _, _ = expected(texts)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, stripe string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(d).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_parts_and_batches(spark, monkeypatch):
    """The same where batches, held links, parts of stripes and partial sums are small; workers take the module's values anew from the driver's closure only if patched there, so the DataFrame stages are checked."""
    texts = texts_of(5)[:60]
    want, count, top = expected(texts)
    monkeypatch.setattr(token_links, "PART", 1000)
    monkeypatch.setattr(token_links, "SUMS", 1)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(d).collect()} == dict(enumerate(want))
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in best_pairs(d).collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in count.items()}


def test_small_batches_in_a_worker(monkeypatch):
    """Links are written in several parts of one batch, and segments forgotten, without other results."""
    monkeypatch.setattr(token_links, "HELD", 50)
    texts = texts_of(7)[:40]
    s = token_links.Segments(token_links.A_PATH, token_links.B_PATH, remembered=5)
    out, rows, docs = token_links._Batches(s, 0), [], []
    monkeypatch.setattr(token_links, "LONG", 40)  # so that some are encoded by themselves
    for k in range(0, len(texts), 3):
        docs += out.add(texts[k : k + 3])
        if out.links >= token_links.HELD:
            rows += out.flush()
    rows += out.flush()
    links = Counter()
    for r in rows:
        codes = token_links.unpack(r["sums"])[0].cumsum()
        per, who, times = token_links.unpack(r["links"])
        for c, d, t in zip(codes.repeat(per), who, times):
            links[int(d), int(c % s.n_a), int(c // s.n_a * token_links.STRIPES + r["stripe"])] += int(t)
    want = Counter((i, a, b) for i, f in enumerate(brute(texts)) for a, b in f[3])
    assert links == want
    assert [d["n_links"] for d in docs] == [len(f[3]) for f in brute(texts)]


def test_more_documents_in_a_task_than_a_batch_has(spark):
    """A task's record batches end where they do, and no batch of documents is larger than its numbers."""
    texts = ["the cat", "a b", "it's ", "a b c"]
    n = token_links.BATCH + 1000
    want, _, _ = expected([texts[i % 4] for i in range(n)])
    names = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    d = spark.range(n).selectExpr("id AS doc_id", "id % 4 AS k").join(names, "k").select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(d).collect()}
    assert got == dict(enumerate(want))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(empty).count() == 0
    d = spark.createDataFrame([(None, "the cat"), (None, "the cat"), (7, "the cat"), (7, None)], "doc_id long, text string")
    rows = align_tokenizers(d).collect()
    assert sorted((r["doc_id"] is None, r["n_a"]) for r in rows) == [(False, 0), (False, 2), (True, 2), (True, 2)]
    names = spark.createDataFrame([("x", "the cat", 5)], "name string, body string, doc_id int")
    assert align_tokenizers(names, id_col="name", text_col="body").first()["name"] == "x"


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want, _, _ = expected([r["text"] for r in docs])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_token_alignment(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(docs, want)}
