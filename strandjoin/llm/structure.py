"""Repair of conversation structure, in DataFrame operations only.

A conversation's rows, in order of turn, are read as the first letters of their roles; a sound one is
s?(ua)+ or nothing. Window functions flag each row's first fault: blank (no character but ASCII white
space), duplicate (role and text came before), truncated (the last such character doesn't end a
sentence). A fold over the sorted turns then finds the cheapest edits: it carries four (cost, audit)
structs, for nothing kept yet, after a leading system turn, after a user's and after an assistant's,
and least() of structs picks the cheaper and then the ASCII-smaller audit of the ways into each. An
audit has a letter for each edit: K keeps a turn, R gives it the role that is due, D deletes it, I
inserts an empty turn of the role that is due. As the letters and the turns fix what comes out, the
repaired turns are read off the audit.

That one audit is never worth more than another which it is the beginning of holds because what is
behind it would be insertions, which cost; so the smaller of two at a state stays the smaller.

Rows are ordered by turn (nulls first), then role and text. A null role or text is one space, and so
a blank text or a role with no due place; a null conv_id is a conversation. Further columns are
ignored, whatever their names. Rows that repeat are rows each. A conversation without rows left has
zeros, an empty audit and no turns. Empty tables give no rows. A conversation is one row while it is
folded, so its text has to fit in one, and a fold takes time with the square of its turns' number, as
audits grow by a letter a turn; conversations don't share tasks' memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What an edit costs, and what an undeleted truncated turn adds.
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
#: The cost of what can't be.
NEVER = 1 << 40


def damage(turns: DataFrame, modulus: int = 20) -> DataFrame:
    """Rows with faults, decided by crc32 of conv_id:turn: conv_id, turn, role, text and alive, which is false for dropped rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % modulus
    d = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), F.explode(copies).alias("copy"))
    return d.drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, alive, place, turn, role, text and the faults blank, duplicate, truncated, illegal and the flag new_turn; rows that aren't alive stay without faults."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.col("alive") if "alive" in rows.columns else F.lit(True).alias("alive"))
    own = Window.partitionBy("conv_id", "alive")
    order = own.orderBy("turn", "role", "text")
    d = rows.withColumn("place", F.row_number().over(order))
    by_place = own.orderBy("place")
    again = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy("place")) > 1
    first = F.substring("role", 1, 1)
    before = F.lag(first).over(by_place)
    legal = F.concat(before, F.lit("/"), first).isin("s/u", "u/a", "a/u")
    stripped = F.regexp_replace("text", f"{WS}+$", "")
    d = d.withColumns({
        "again": again, "empty": stripped == "", "illegal": F.col("alive") & before.isNotNull() & ~legal,
        "new_turn": F.col("alive") & F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(by_place) == F.col("turn"), F.lit(False)),
        "open": ~F.substring(stripped, -1, 1).isin(".", "!", "?"),
    })
    alive, empty, again, open_ = (F.col(c) for c in ("alive", "empty", "again", "open"))
    faults = {"blank": alive & empty, "duplicate": alive & ~empty & again, "truncated": alive & ~empty & ~again & open_}
    return d.select("conv_id", "alive", "place", "turn", "role", "text", *[c.alias(n) for n, c in faults.items()], "illegal", "new_turn")


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost, letters: str) -> Column:
    return _way(state["cost"] + cost, F.concat(state["audit"], F.lit(letters)))


def _inserted(a: Column) -> tuple[Column, Column]:
    """The ways to stand behind a user's and behind an assistant's turn, with turns inserted where that is cheaper."""
    one, two = COSTS[INSERT], 2 * COSTS[INSERT]
    user = F.least(a["u"], _then(a["e"], one, INSERT), _then(a["s"], one, INSERT), _then(a["a"], one, INSERT))
    assistant = F.least(a["a"], _then(a["u"], one, INSERT), _then(a["e"], two, INSERT * 2), _then(a["s"], two, INSERT * 2))
    return user, assistant


def _step(a: Column, turn: Column) -> Column:
    """The four ways behind a turn, of those before it."""
    user, assistant = _inserted(a)
    kept = F.when(turn["doomed"], F.lit(NEVER)).otherwise(turn["extra"])
    gone = lambda s: _then(s, COSTS[DELETE], DELETE)

    def taken(state: Column, due: str) -> Column:
        fits = turn["initial"] == due
        cost = state["cost"] + kept + F.when(fits, COSTS[KEEP]).otherwise(COSTS[REROLE])
        return _way(cost, F.concat(state["audit"], F.when(fits, KEEP).otherwise(REROLE)))

    led = _way(a["e"]["cost"] + kept + F.when(turn["initial"] == "s", COSTS[KEEP]).otherwise(NEVER), F.concat(a["e"]["audit"], F.lit(KEEP)))
    return F.struct(
        gone(a["e"]).alias("e"), F.least(gone(a["s"]), led).alias("s"),
        F.least(gone(user), taken(a["e"], "u"), taken(a["s"], "u"), taken(assistant, "u")).alias("u"),
        F.least(gone(assistant), taken(user, "a")).alias("a"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns, the repaired ones (role, text) in order."""
    d = flagged(rows)
    kept = F.struct("place", "role", "text", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("duplicate")).alias("doomed"), F.when(F.col("truncated"), TRUNCATED).otherwise(0).alias("extra"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    turn = F.when(F.col("alive"), F.col("turn"))
    gaps = F.coalesce((F.max(turn) - F.min(turn) + 1).cast("long") - F.sum(F.col("new_turn").cast("long")), F.lit(0).cast("long"))
    convs = d.groupBy("conv_id").agg(gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated", "illegal")), F.array_sort(F.collect_list(F.when(F.col("alive"), kept))).alias("rows"))
    start, never = _way(F.lit(0), F.lit("")), _way(F.lit(NEVER), F.lit(""))
    zero = F.struct(start.alias("e"), never.alias("s"), never.alias("u"), never.alias("a"))
    best = F.aggregate("rows", zero, _step, lambda a: F.least(a["e"], _inserted(a)[1]))
    # exploded, so that the fold isn't run again for each column made of it
    convs = convs.select("*", F.explode(F.array(best)).alias("best"))
    audit = F.col("best.audit")
    until = lambda k, letter: F.length(F.replace(F.substring(audit, F.lit(1), k - 1), F.lit(letter), F.lit("")))
    row = lambda k: F.get("rows", until(k, INSERT))
    led = F.col("led")

    def due(k: Column) -> Column:
        return F.when((until(k, DELETE) - led) % 2 == 0, "user").otherwise("assistant")

    def edited(k: Column) -> Column:
        letter = F.substring(audit, k, F.lit(1))
        role = F.when(letter == KEEP, row(k)["role"]).otherwise(due(k))
        return F.when(letter != DELETE, F.struct(role.alias("role"), F.when(letter == INSERT, "").otherwise(row(k)["text"]).alias("text")))

    # the first letter that isn't D stands for the first turn that comes out
    first = F.length(audit) - F.length(F.ltrim(audit, F.lit(DELETE))) + 1
    convs = convs.withColumn("led", ((F.substring(audit, first, F.lit(1)) == KEEP) & (F.get("rows", first - 1)["initial"] == "s")).cast("int"))
    convs = convs.withColumn("led", F.coalesce("led", F.lit(0)))
    places = F.when(F.length(audit) > 0, F.sequence(F.lit(1), F.length(audit))).otherwise(F.array().cast("array<int>"))
    turns = F.filter(F.transform(places, edited), lambda t: t.isNotNull())
    return convs.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), turns.alias("turns"))
