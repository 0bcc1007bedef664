"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation's turns are laid out as <|im_start|>role, newline, text, <|im_end|>, newline. Control
strings inside roles and texts are escaped: & is written &amp; and <| is written &lt;|, and in roles
a newline is &#10; - the reverse is exact. Prefix sums of turn tokens cut a conversation into windows
of whole turns of at most `budget` tokens, what is repeated included: each later window repeats the
leading system turn and of the `history` turns before it the last ones that leave room for its first
own turn. The loss covers the text of assistant turns, in their own window only: what is repeated is
masked. A turn that is over the budget, with the system turn, has a window of its own without history.

Turns are ordered by turn, then role and text, nulls first; rows that repeat are turns of their own.
Null roles and texts are empty, a null conv_id is a conversation. A conversation is one row while it
is cut, so its text has to fit in one. Further columns are ignored, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_chats(turns: DataFrame, budget: int = 2048, history: int = 2, conv_col: str = "conv_id") -> DataFrame:
    """A row for each window: conv_id, window, text, n_repeated (turns of context at its start), n_tokens, loss (spans: start from 0, length; in code points of text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tokens = F.size(F.array_remove(F.split(text, f"{WS}+"), "")) + 4
    rows = turns.select(F.col(conv_col).alias("conv_id"), "turn", role.alias("role"), text.alias("text"), tokens.cast("long").alias("tokens"))
    # the same order as the array's, so that the sums fit
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("tokens").over(order))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens", "upto"))).alias("turns"))
    led = F.col("turns")[0]["role"] == "system"
    convs = convs.withColumn("lead", led.cast("int")).withColumn("system", F.when(led, F.col("turns")[0]["tokens"]).otherwise(F.lit(0).cast("long")))
    convs = convs.withColumn("sums", F.transform("turns", lambda t: t["upto"]))
    upto = lambda i: F.when(i >= 0, F.get("sums", i)).otherwise(F.lit(0).cast("long"))
    # a window: its first own turn and how many turns of history are before it
    window = "array<struct<from:int,back:int>>"
    state = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"), F.array(F.struct(F.lit(0).alias("from"), F.lit(0).alias("back"))).cast(window).alias("wins"))

    def place(a: Column, t: Column) -> Column:
        i, own = a["i"], t["tokens"]
        again = lambda h: upto(i - 1) - upto(i - 1 - h)  # noqa: E731  tokens of the h turns before i
        back = F.lit(0)
        for h in range(1, history + 1):
            back = F.when((i - h >= F.col("lead")) & (F.col("system") + again(F.lit(h)) + own <= budget), F.lit(h)).otherwise(back)
        new = (i > 0) & (a["used"] + own > budget)
        start = F.struct(i.alias("from"), back.alias("back"))
        wins = F.when(new, F.concat(a["wins"], F.array(start).cast(window))).otherwise(a["wins"])
        used = F.when(new, F.col("system") + again(back) + own).otherwise(a["used"] + own)
        return F.struct((i + 1).alias("i"), used.alias("used"), wins.alias("wins"))

    convs = convs.withColumn("wins", F.aggregate("turns", state, place)["wins"])
    ends = F.transform("wins", lambda w, k: F.coalesce(F.get("wins", k + 1)["from"], F.size("turns")))
    convs = convs.select("conv_id", "turns", "sums", "lead", "system", F.posexplode(F.arrays_zip("wins", ends.alias("ends"))).alias("window", "w"))
    begin, back, n = F.col("w.wins.from"), F.col("w.wins.back"), F.col("w.ends") - F.col("w.wins.from")
    lead = F.when(begin > 0, F.col("lead")).otherwise(0)
    used = F.concat(F.slice("turns", F.lit(1), lead), F.slice("turns", begin - back + 1, back + n))
    n_tokens = upto(begin + n - 1) - upto(begin - back - 1) + F.when(begin > 0, F.col("system")).otherwise(F.lit(0).cast("long"))
    convs = convs.select("conv_id", "window", (lead + back).alias("n_repeated"), n_tokens.alias("n_tokens"), used.alias("used"))
    parts = F.transform("used", lambda t: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("target")))
    convs = convs.select("conv_id", "window", "n_repeated", "n_tokens", parts.alias("parts"))
    tail = f"{CLOSE}\n"
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def span(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        own = p["target"] & (a["k"] >= F.col("n_repeated"))
        loss = F.when(own, F.concat(a["loss"], F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["loss"])
        return F.struct((start + F.length(p["body"]) + len(tail)).alias("at"), (a["k"] + 1).alias("k"), loss.alias("loss"))

    return convs.select("conv_id", "window", whole.alias("text"), "n_repeated", "n_tokens", F.aggregate("parts", zero, span)["loss"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """From the formatted windows alone: conv_id, turns (role, text; each once, in order), loss_text, formatted_chars."""
    # a control string can't stand inside a role or text, so splitting at it is exact
    parts = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1 << 30)
    own = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(CLOSE) - 1)
        return F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(body).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    rows = windows.select("conv_id", "window", F.transform(own, turn).alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    sets = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return sets.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
