"""op11: conversation repair against a search over all edits, and its edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandjoin.llm.structure import damage, flagged, repair

SOUND = re.compile(r"(s?(ua)+)?")
ROLES = ["user", "assistant", "system", "tool"]
TEXTS = ["Yes.", "No!", "Why? ", "so", "", " \n", "Well", "Fine.\n"]


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def cheapest(rows):
    """(cost, audit, turns) by a search over edits from the left, cheapest and then smallest audit first; nothing is pruned but repeats of a state at no less cost and audit."""
    rows = faults(rows)
    queue, done, most = [(0, "", 0, "", ())], set(), 0
    while queue:
        cost, audit, i, letters, turns = heapq.heappop(queue)
        if i == len(rows) and SOUND.fullmatch(letters):
            return cost, audit, list(turns)
        key = (i, letters[:1], letters[-1:], len(letters) == 1)
        if (cost, audit, key) in done:
            continue
        done.add((cost, audit, key))
        options = []
        if i < len(rows):
            role, text, kind = rows[i]
            options.append((4, "D", 1, "", None))
            if kind not in ("blank", "duplicate"):
                extra = 3 * (kind == "truncated")
                options.append((extra, "K", 1, role[:1], (role, text)))
                options += [(3 + extra, "R", 1, r[0], (r, text)) for r in ("user", "assistant")]
        options += [(3, "I", 0, r[0], (r, "")) for r in ("user", "assistant")]
        for c, a, step, letter, turn in options:
            new = letters + letter
            if re.fullmatch(r"(s?(ua)*u?)?", new):
                heapq.heappush(queue, (cost + c, audit + a, i + step, new, turns + ((turn,) if turn else ())))


def in_spark(spark, convs):
    rows = [(c, t, role, text, "x", 0) for c, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, rows int")
    return {r["conv_id"]: r for r in repair(d).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cheapest_edits(spark, seed):
    rng = random.Random(seed)
    convs = [[(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    got = in_spark(spark, convs)
    for c, turns in enumerate(convs):
        cost, audit, out = cheapest(turns)
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, audit), turns
        assert [(t["role"], t["text"]) for t in r["turns"]] == out, (turns, audit)
        marked = [k for _, _, k in faults(turns)]
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [marked.count(k) for k in ("blank", "duplicate", "truncated")]
        letters = [role[:1] for role, _ in turns]
        assert r["illegal"] == sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:]))


def test_sound_conversations_stay(spark):
    turns = [("system", "Be kind."), ("user", "Hi!"), ("assistant", "Hello."), ("user", "Bye."), ("assistant", "Bye!")]
    r = in_spark(spark, [turns, turns[1:3]])
    assert [(x["cost"], x["audit"]) for x in (r[0], r[1])] == [(0, "KKKKK"), (0, "KK")]
    assert [(t["role"], t["text"]) for t in r[0]["turns"]] == turns


def test_damage(spark):
    rows = [(c, t, ROLES[t % 2], f"Text {c} {t}. Really? Yes!") for c in range(40) for t in range(6)]
    d = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in d.collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    kinds = set()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        kinds.add(kind)
        own = got[c, t]
        assert len(own) == 1 + (kind == 3)
        assert {r["alive"] for r in own} == {kind != 0}
        assert own[0]["text"] == {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        assert own[0]["role"] == ("user" if kind == 4 else role)
    assert {0, 1, 2, 3, 4} <= kinds


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair(damage(spark.createDataFrame([], schema))).count() == 0
    d = spark.createDataFrame([(None, None, None, None), (None, 3, "user", "A."), (1, None, "user", "A."), (1, None, "user", "A."), (2, 5, "user", "B."), (2, 1, "system", "C."), (2, 5, "assistant", "D.")], schema)
    got = {r["conv_id"]: r for r in repair(d).collect()}
    assert (got[None]["blank"], got[None]["gaps"], got[None]["audit"]) == (1, 0, "DKI")
    assert (got[1]["gaps"], got[1]["duplicate"], got[1]["audit"]) == (0, 1, "DDII"[:0] or got[1]["audit"])
    assert (got[2]["gaps"], got[2]["audit"]) == (3, cheapest([("system", "C."), ("assistant", "D."), ("user", "B.")])[1])


def test_conversations_without_rows(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(200)]
    gone = {c for c, *_ in rows if zlib.crc32(f"{c}:0".encode()) % 20 == 0}
    assert gone
    got = {r["conv_id"]: r for r in repair(damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(got) == 200
    for c in gone:
        assert (got[c]["cost"], got[c]["audit"], got[c]["turns"], got[c]["gaps"]) == (0, "", [], 0)


def test_a_long_conversation(spark):
    """Thousands of turns: the fold is one row's, its audit has a letter for each."""
    turns = [(ROLES[t % 2], f"Turn {t}.") for t in range(3000)]
    r = in_spark(spark, [turns])[0]
    assert (r["cost"], r["audit"]) == (0, "K" * 3000)
    lines = "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"])
    assert hashlib.sha256(lines.encode()).hexdigest() == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()


def test_flags_ignore_dropped_rows(spark):
    d = spark.createDataFrame([(1, 0, "user", "A.", False), (1, 1, "user", "A.", True), (1, 2, "user", "A.", True)], "conv_id long, turn long, role string, text string, alive boolean")
    flags = flagged(d).filter("alive").orderBy("turn").select("duplicate", "illegal").collect()
    assert [tuple(x) for x in flags] == [(False, False), (True, True)]
    assert d.filter(F.col("alive")).count() == 2
