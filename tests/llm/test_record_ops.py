"""Quality rules, packing, chat formatting, WARC, HTML extraction and the pipeline."""

import collections
import gzip
import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from strandjoin.llm import chat, html_extract, packing, quality, warc

WS = "[ \t\n\x0b\x0c\r]+"


def test_measures(spark):
    rng = random.Random(1)
    unit = [f"w{k}" for k in range(9)]
    texts = [None, "", " \n\t", "a#b $c\n\nx\nx\n x", " ".join(unit) + "\n" + " ".join(unit[:8]), "z " * 40, "é " * 9 + "ünd " * 3]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["long " * 30000]
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split(WS, t) if x]
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {x for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.sub(WS, "", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 50), (40, 1000), (5, 5), (0, 100000), (900, 100000)]
    d = spark.createDataFrame(cases, "r long, n long")
    got = d.withColumn("p", quality.binomial_tail(F.col("r"), F.col("n"), 0.01)).collect()
    for x in got:
        terms = [math.lgamma(x["n"] + 1) - math.lgamma(k + 1) - math.lgamma(x["n"] - k + 1) + k * math.log(0.01) + (x["n"] - k) * math.log(0.99) for k in range(x["r"] + 1)]
        want = math.exp(max(terms)) * sum(math.exp(t - max(terms)) for t in terms)
        assert abs(x["p"] - min(1, want)) <= 1e-6 * want + 1e-300


def test_quality_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("%" if bad else "") for _ in range(40)), "en" if i % 3 else None, "kept"))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, None, "en", "k"), (None, " ".join(word() for _ in range(30)), "xx", "k"), (5001, " ".join(word() + "%" for _ in range(30)), "xx", "k")]
    labels += [(None, 1), (1, None), (1, 0), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, marks).collect()}
    assert len(got) == len(rows)
    good = [i for i in range(3000) if i % 10 and i % 3]
    assert sum(not got[i]["kept"] for i in good) <= 0.025 * len(good)
    assert not any(got[i]["kept"] for i in range(0, 3000, 10) if i % 3)
    # the stratum null has too few labels for alpha; xx has none: nothing but the base rule rejects there
    assert got[5001]["kept"] and got[None]["kept"] and not got[5000]["kept"] and got[5000]["base_failed"]
    assert quality.quality_rules(docs.limit(0), marks).count() == 0
    # the input's own columns, also those that are named as the operator's
    left = quality.accepted(docs.withColumn("symbol_ratio", F.lit("mine")).withColumn("n_words", F.lit(None)), marks)
    assert left.columns == [*docs.columns, "symbol_ratio", "n_words"] and {(r["kept"][0], r["symbol_ratio"], r["n_words"]) for r in left.collect()} == {("k", "mine", None)}
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"]}
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_rules(docs, marks.limit(0)).collect())


def test_quality_cutoffs_of_small_strata(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for lang, n, sign in (("big", 2000, ""), ("small", 400, ""), ("tiny", 30, ""), ("odd", 300, "%")):
        for i in range(n):
            bad = i % 10 == 0
            rows.append((len(rows), " ".join(word() + ("%" if bad else sign if i in (1, 2) else "") for _ in range(20)), lang))
            labels.append((rows[-1][0], 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    bad, good = collections.defaultdict(set), collections.defaultdict(set)
    for r in quality.quality_rules(docs, marks).collect():
        (good if labels[r["doc_id"]][1] else bad)[r["lang"]].add(r["kept"])
    # small has its cutoff from the pool; tiny has too few labels, and more than alpha of the good documents of odd look bad
    assert bad == {"big": {False}, "small": {False}, "tiny": {True}, "odd": {True}}
    assert set(map(tuple, good.values())) == {(True,)}
    pooled = {r["stratum"]: r["pooled"] for r in quality.select_cutoffs(quality.measures(docs), marks).filter("rule = 'symbol_ratio' and rejected > 0").collect()}
    assert pooled == {"big": False, "small": True}


def upto_tail(k, n, p):
    """P(X <= k), exactly."""
    from fractions import Fraction

    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_selected_cutoffs_against_brute_force(spark):
    rng = random.Random(31)
    strata = {"a": 1500, "b": 700, "c": 300, None: 60}
    rows, labels = [], []
    for lang, n in strata.items():
        for i in range(n):
            good = rng.random() < 0.8
            noise = rng.choice([0, 0, 0, 1, 2]) if good else rng.choice([2, 6, 20])
            words = [rng.choice(["ab", "abcde", "abcdefghij"]) for _ in range(40)]
            lines = [" ".join(words[k : k + 8]) for k in range(0, 40, 8)]
            if not good and rng.random() < 0.5:
                lines += [lines[0]] * rng.randint(1, 9)
            rows.append((len(rows), "\n".join(lines) + " " + "% " * noise, lang))
            if rng.random() < 0.9:
                labels.append((rows[-1][0], int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    alpha, delta, pooled = 0.02, 0.05, 0.08
    got = {(r["stratum"], r["rule"]): (r["cutoff"], r["pooled"]) for r in quality.select_cutoffs(quality.measures(docs), marks, alpha, delta, pooled_alpha=pooled).collect()}
    said, of = dict(labels), {}
    for i, text, lang in rows:
        if i in said:
            w = text.split()
            seen = [x for x in text.split("\n") if x.strip()]
            n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            covered = {x for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
            mean = sum(map(len, w)) / len(w)
            of[i] = (lang, said[i], {"symbol_ratio": text.count("%") / len(w), "dup_line_ratio": (len(seen) - len(set(seen))) / len(seen), "repeat_ratio": len(covered) / len(w), "long_word_mean": mean, "short_word_mean": -mean})
    level = delta / (len(quality.CUTOFFS) * (2 * len(strata) + 1))
    good = lambda s: [x for x in of.values() if x[1] and (s == "all" or x[0] == s)]
    want = {}
    for s in strata:
        for rule, cuts in quality.CUTOFFS.items():
            options = []
            for c in cuts:
                bad = {x: sum(d[2][rule] > c for d in good(x)) for x in (s, "all")}
                fine = lambda x, p: bad[x] < p * len(good(x)) and upto_tail(bad[x], len(good(x)), p) <= level  # noqa: B023, E731
                own = fine(s, alpha)
                if own or (fine("all", alpha) and bad[s] <= alpha * len(good(s)) and fine(s, pooled)):
                    hit = sum(d[2][rule] > c for d in of.values() if own is False or d[0] == s)
                    options.append((own, hit, c))
            if options:
                own, _, c = max(options)
                want[s, rule] = (c, not own)
    assert got == want and len({x[1] for x in want.values()}) == 2
    # each document's verdict follows
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, marks, alpha, delta).collect()}
    cut = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.select_cutoffs(quality.measures(docs), marks, alpha, delta).collect()}
    for i, (lang, _, m) in of.items():
        n_words = len(rows[i][1].split())
        base = n_words < 20 or m["repeat_ratio"] > 0.3
        assert kept[i] == (not base and not any(m[r] > cut.get((lang, r), math.inf) for r in quality.CUTOFFS))


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        top = rng.choice([1, 2, 7, 16, 33])
        sizes = [rng.randint(1, top) for _ in range(rng.randint(0, 40))]
        rows = packing.best_fit_decreasing(sizes, top)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes))) and all(sum(sizes[k] for k in r) <= top for r in rows)
        room: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [x for x in room if x >= n]
            if fit:
                room[room.index(min(fit))] -= n
            else:
                room.append(top - n)
        assert len(room) == len(rows)


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")
def test_packing_round_trip(spark):
    rng = random.Random(4)
    al = " \n\t'stremdlv09a.,!é\xa0\x1c ²_日"
    rows = [(i, "".join(rng.choice(al) for _ in range(rng.randint(0, 90)))) for i in range(80)] + [(80, None), (None, "x"), (81, "word " * 900), (7, "a"), (7, "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pack_id int, ids string").repartition(3)
    enc = packing.encoder(packing.VOCABULARY)
    for block in (100, 1_000_000):
        packed = packing.pack(docs, length=64, block_tokens=block)
        for r in packed.collect():
            assert len(r["ids"]) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64 and r["position_resets"] == r["cu_seqlens"][:-1]
        parts = packing.unpack(packed).filter("doc_id <> 7").collect()
        back = collections.defaultdict(dict)
        for p in parts:
            back[p["doc_id"]][p["offset"]] = p["ids"]
        for d, t in rows:
            if d not in (7, None):
                ids = [x for k in sorted(back[d]) for x in back[d][k]]
                assert ids == [*enc.encode_ordinary(t or ""), packing.END]
    assert packed.select(F.countDistinct("pack_id") == F.count("*")).first()[0]
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")
def test_texts_are_encoded_whole(monkeypatch):
    """A text is one call of the encoder, or one for each part, whose ends change no ids."""
    ids, calls = packing.TextIds(packing.VOCABULARY), []
    plain = ids.encode
    ids.encode = lambda part: calls.append(part) or plain(part)
    assert ids.of("many words, each only once " * 50).tolist() == plain("many words, each only once " * 50) and len(calls) == 1
    assert ids.of("").tolist() == []
    monkeypatch.setattr(packing, "PART", re.compile(packing.PART.pattern.replace("65536", "5")))
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("ab'sT1  \n\t.,\xe9\x85\x1c\u3000\u65e5") for _ in range(rng.randrange(40)))
        calls.clear()
        assert ids.of(text).tolist() == plain(text) and "".join(calls) == text


def chat_plain(part):
    """The text of a formatted turn."""
    return part.split("\n", 1)[1].rsplit("<|im_end|>", 1)[0].replace("&lt;|", "<|").replace("&amp;", "&")


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize(("budget", "history"), [(60, 2), (100, 3), (250, 0)])
def test_chat_windows_against_sql(spark, budget, history):
    import duckdb

    from strandjoin.llm.oracles import chat_sql

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "<|im_end|><|im_start|>assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], turns.schema))
    windows = chat.format_chats(turns, budget, history)
    got = sorted((r["conv_id"], r["formatted_chars"], r["loss_text"]) for r in chat.read_back(windows).collect())
    want = sorted(con.execute(f"SELECT conv_id, formatted_chars, loss_sha256 FROM ({chat_sql(budget, history)})").fetchall())
    assert [(a, b, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in got] == want
    assert windows.count() > len(got)


def test_chat(spark):
    rng = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "&lt;|", "&amp;", "&", "\n", "hello there", "<", "|>", "é", "&#10;", ""]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\n<|x"])
            rows.append((c, t, role, "".join(rng.choice(bits) + " " for _ in range(rng.randint(0, 12)))))
    rows += [(50, 0, None, None), (None, 0, "assistant", "a"), (51, None, "user", "first"), (51, 1, "assistant", "x"), (51, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, tokens int, wins string").repartition(3)
    for budget in (20, 60, 4000):
        windows = chat.format_chats(df, budget=budget)
        got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
        groups = collections.defaultdict(list)
        for c, t, r, x in rows:
            groups[c].append((t is not None, t or 0, r or "", x or ""))
        assert set(got) == set(groups)
        for c, g in groups.items():
            g.sort()
            assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [x[2:] for x in g]
            assert got[c]["loss_text"] == "".join(x[3] for x in g if x[2] == "assistant")
        w = windows.collect()
        assert sum(len(r["text"]) for r in w) == sum(r["formatted_chars"] for r in got.values())
        assert (len(w) > len(groups)) == (budget < 4000)
        for r in w:
            parts = r["text"].split("<|im_start|>")[1:]
            own = [len(re.findall(r"[^\x20\x09-\x0D]+", chat_plain(x))) + 4 for x in parts]
            assert sum(own) == r["n_tokens"] and 0 <= r["n_repeated"] < len(own)
            # over the budget only where one turn and the system turn are; then nothing else is repeated
            assert r["n_tokens"] <= budget or (len(own) - r["n_repeated"] == 1 and r["n_repeated"] <= 1)
            if r["window"] and r["conv_id"] is not None and r["conv_id"] % 3 == 0 and r["conv_id"] < 30:
                assert r["text"].startswith("<|im_start|>system\n")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/é", big), (5, "u", big), (3, None, big), (2, "a\r\nb%0A", "small"), (4, "u", "small"), (6, "u", None), (None, "u", "z"), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "é" * 40000), (9, "u", "é" * 40000)]
    pages = spark.createDataFrame([(*r, "mine", b"x") for r in rows], "page_id long, url string, html string, digest string, payload binary").repartition(3)
    archives = warc.write_archives(warc.plan_records(pages))
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    for i, u, h in rows:
        r = next(r for r in got if r["page_id"] == i)
        b = (h or "").encode()
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (u, len(b), hashlib.sha1(b).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if i in (1, 3) else ("response", None))
        assert r["payload"] == (None if i in (1, 3) else b)
    name = tmp_path / "x.warc.gz"
    name.write_bytes(b"".join(r["data"] for r in archives.orderBy("archive", "part").collect()))
    assert warc.read_files(spark, str(name)).count() == len(rows) and gzip.open(name).read().count(b"WARC/1.1\r\n") == len(rows)
    key = lambda d: sorted((r["page_id"] or 0, r["url"] or "", r["record_type"], r["payload_digest"], bytes(r["payload"] or b"")) for r in d.collect())
    assert key(warc.read_files(spark, str(name))) == key(warc.read_archives(archives))
    two = tmp_path / "many"
    two.mkdir()
    for k in range(3):  # small files share a task
        (two / f"{k}.warc.gz").write_bytes(name.read_bytes())
    assert key(warc.read_files(spark, str(two))) == sorted(key(warc.read_archives(archives)) * 3)
    (two / "0.warc.gz").write_bytes(gzip.compress(gzip.decompress(name.read_bytes())[:-40]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_files(spark, str(two)).collect()
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    plain = gzip.decompress(good)
    assert len(list(warc.members([good[:9], good[9:] + good]))) == 2
    for wrong in (plain.replace(b"payload\r", b"Payload\r"), plain.replace(b"Length: 8", b"Length: 9"), plain[:-3]):
        with pytest.raises((ValueError, IndexError)):
            list(warc.parse(wrong))
    with pytest.raises(ValueError):
        list(warc.members([good[:-5]]))
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.limit(0)))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</ul></nav><!-- c <p>no -->
<div class="cookie-notice">we use</div><article><header><h1>Head &amp;
 line</h1></header><p>one <b>t</b>wo<br>three<script>var t="</p>";</script><p>four&nbsp;&lt;x&gt;<form>f</form><aside>side</aside><section class="comments"><p>said</section></article><div id="sidebar">s</div><footer>&copy;</footer>"""


def test_extract(spark):
    rows = [(1, "http://h/1", PAGE), (2, "not a url", "<p>a<p>b  c"), (3, None, None), (4, "http://h/2", ""), (5, "http://h/3", "<script>x"), (1, "http://h/1", PAGE), (6, "http://h/4", "< 3 <a"), (None, "http://h/5", "<div>" * 300 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text == {1: "Head & line one two three four <x>", 2: "a b c", 3: "", 4: "", 5: "", 6: "< 3 <a", None: "deep"}


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "end", "<article>" * 100_000 + "end", "<p><td>" + "<b>" * 30_000 + "<h1>" * 30_000 + "end", "<a<a" * 250_000 + ">end", "<a \"'>" * 100_000 + "end", '<a ">" ' * 100_000 + "'>end", "<ul><li>" * 50_000 + "end", "<a" * 500_000 + " end"])
def test_deep_and_malformed_pages(page):
    import time

    began = time.time()
    top = html_extract.parse(page)
    assert html_extract.article_text(top).endswith("end") and sum(1 for _ in html_extract.style_rows(top)) < 1000
    assert time.time() - began < 30


def test_articles_and_class_words(spark):
    body = lambda x: f"<html><body><div class='share-buttons'>post</div>{x}<div class='related-links'>more</div></body></html>"
    pages = {
        1: ("<main><article><p>first</p></article><article><p>second <i>one</i></p></article></main>", "first second one"),
        2: ("<article><p class='share-price'>rose</p><p class='notice'>of a will</p><div class='search'>for words</div><div class='comments-list'>said</div><div role='alert'>go</div></article>", "rose of a will for words"),
        3: ("<div class='share-price'>fell</div><div class='alert box'>x</div><p>end</p>", "fell end"),
        4: ("<main><header><h1>Title</h1></header><p>text</p></main>", "Title text"),
        5: ("<p>a<table><tr><td>b<td>c<tr><td>d</table></p><div>e</span>f", "a b c d ef"),
    }
    rows = [(i, "u", body(x), "kept", 1) for i, (x, _) in pages.items()]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, removed string, salt int"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: want for i, (_, want) in pages.items()}


def test_importances_against_brute_force(spark):
    rng = random.Random(9)
    pages = []
    for i in range(9):  # one host: a menu, a teaser with few variants, paragraphs of their own
        body = "".join(f"<p>{rng.random()}</p>" + "<h2>x</h2>" * rng.randint(0, 1) for _ in range(rng.randint(1, 3)))
        pages.append(f"<div class='top'><p>All</p></div><div class='tease'><p>{rng.choice('abc')}</p></div><div class='body'>{body}</div>")
    docs = spark.createDataFrame([("h", i, x) for i, x in enumerate(pages)], "host string, page_hash long, html string")
    got = {r["path"]: (r["m"], r["importance"]) for r in html_extract.importances(html_extract.style_keys(docs), 5, 0.9).collect()}
    have, shapes, texts = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for page in pages:
        top = html_extract.parse(page)
        found, said = collections.defaultdict(set), collections.defaultdict(set)

        def walk(n, found=found, said=said):
            for c in n.children:
                if isinstance(c, str):
                    for path in n.chain[1:]:
                        said[path].add(c)
                else:
                    found[c.chain[-1]].add(tuple(x.label for x in c.children if not isinstance(x, str)))
                    walk(c)

        walk(top)
        for path, x in found.items():
            have[path] += 1
            shapes[path][frozenset(x)] += 1
        for path, x in said.items():
            texts[path].update(x)
    want = {}
    for path, m in have.items():
        if m >= 5 and texts[path]:
            shown = -sum(n / m * math.log(n / m, m) for n in shapes[path].values())
            own = 1 - sum(math.log(n, m) for n in texts[path].values()) / len(texts[path])
            want[path] = (m, 0.1 * shown + 0.9 * own)
    assert set(got) == set(want) and len(want) >= 6
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def test_style_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(20))
    bodies = [[prose() for _ in range(rng.randint(1, 4))] for _ in range(12)]
    rows = [(i, f"http://h/{i}", "<div class='top'><p>All the news</p><p>of today</p></div><div class='text'>" + "".join(f"<p>{x}</p>" for x in b) + "</div>") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (50_000, -1):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, max_broadcast_nodes=most).collect()}
        assert got == {i: " ".join(b) for i, b in enumerate(bodies)}


def test_style_tree_keeps_unique_and_shared_articles(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(8):  # every page has a paragraph for each of 15 shapes
        parts = [[prose(4) for _ in range(k + 1)] for k in range(15)]
        rows.append((i, f"http://rich/{i}", "<div class='top'><p>All the news</p></div><div class='text'>" + "".join("<p>" + " ".join(f"<a>{x}</a>" for x in p) + "</p>" for p in parts) + "</div>"))
        want[i] = " ".join(x for p in parts for x in p)
    shared = prose(30)
    for i in range(100, 108):
        rows.append((i, f"http://shared/{i}", f"<div><p>copy {i}</p></div><article><p>{shared}</p></article>"))
        want[i] = shared
    for i in range(200, 206):  # a branch of repeated blocks with one of its own
        own = prose(12)
        rows.append((i, f"http://mixed/{i}", "<div>" + "".join(f"<p>block {k} of all pages</p>" for k in range(80)) + f"<p>{own}</p></div>"))
        want[i] = own
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it left, with clashing columns, nulls and repeats."""
    import corpus_pipeline
    from test_text_ops import contaminated_expected, near_expected, queue_expected

    rng = random.Random(51)
    word = lambda: rng.choice(["Ann", "Bob", "12", "7.5"]) if rng.random() < 0.05 else "".join(rng.choice("abcde") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(18))) for i in range(4)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(10, 70))]
        if rows and i % 3 == 0:  # a copy, more or less near
            w = [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.08]) else word() for x in rng.choice(rows)[1].split()]
        if i % 11 == 5:
            w += rng.choice(items)[1].replace("Ann", "Bob").split()
        if i % 13 == 1:
            w = w[:12] * 5
        rows.append((i, " ".join(w), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    rows.append((500, None, "en", "a"))
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, 9, "mine", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string, key double")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    at = {r[0]: r for r in rows}

    def step(name, d):
        out = spark.createDataFrame(stages[name](spark, d, folder).collect(), docs.schema)
        assert all(tuple(r)[4:] == (9, "mine", 0.5) and tuple(r)[:4] == at[r["doc_id"]] for r in out.collect())
        return out, sorted(r["doc_id"] for r in out.select("doc_id").collect())

    def base(t):
        w = (t or "").split()
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {x for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    d, got = step("quality_rules", docs)  # so few labels select no cutoff
    assert got == sorted(i for i, r in at.items() if base(r[1]))
    want = near_expected([(i, at[i][1]) for i in got], 5)
    assert len(got) > len({v[1] for v in want.values()})
    d, got = step("near_dup", d)
    assert got == sorted(i for i, v in want.items() if v[2])
    bad = {x[0] for x in contaminated_expected([(i, at[i][1]) for i in got], items, 5, 0.8)}
    d, left = step("decontamination", d)
    assert bad and left == [i for i in got if i not in bad]
    mixed, got = step("mixing", d)
    served = queue_expected([(i, at[i][1], at[i][3]) for i in left], 64)
    for i, size, taken in served:  # whole epochs, and the one that the cut ends if half of it is served
        assert got.count(int(i)) == taken // size + (2 * (taken % size) >= size)
    packed = stages["token_packing"](spark, mixed, folder)
    parts = collections.defaultdict(int)
    for r in packing.unpack(packed).collect():
        parts[r["doc_id"]] += len(r["ids"])
    enc = packing.encoder(packing.VOCABULARY)
    assert parts == {i: got.count(i) * (len(enc.encode_ordinary(at[i][1])) + 1) for i in set(got)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, rows[3][1] + " more", "en", "s0"), (101, rows[3][1], "en", "s0"), (102, rows[9][1] + " " + item, "en", "s1"), (103, "too short", "en", "s1"), (104, None, None, None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    d, seen = docs, {}
    for name, f in corpus_pipeline.STAGES:
        d = f(spark, d, folder)
        if name != "token_packing":
            assert d.columns == docs.columns
            seen[name] = [r["doc_id"] for r in d.collect()]
    assert sorted(seen["quality_rules"]) == [*range(60), 100, 101, 102]
    assert sorted(seen["near_dup"]) == [*range(60), 102]
    assert sorted(seen["decontamination"]) == list(range(60))
    assert set(seen["mixing"]) <= set(range(60)) and max(collections.Counter(seen["mixing"]).values()) <= 3
    assert corpus_pipeline.run(spark, folder).count() == d.count() > 0
