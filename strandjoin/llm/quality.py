"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule compares a measure of a document with a cutoff. Labelled documents are the holdout: for
each stratum, rule and candidate cutoff, the number of good documents it would reject gives an
exact (Clopper-Pearson) test of "the rule rejects more than alpha of the good ones"; a cutoff can
be selected only where that is refuted. The cutoffs of a rule are tested in a fixed sequence from
the loosest, each at the full level of its sequence; as p values grow towards the strictest, that is
the same as testing each at that level. The level is delta / (number of sequences), Bonferroni over
strata, rules and the pool. Of those refuted, the one that rejects most wins. Each rule may so reject
at most alpha of the good documents of a stratum, with probability 1 - delta for all at once; all
five rules together may reject five times alpha of them.

A stratum without a cutoff of its own for a rule gets one certified at alpha on all labelled strata
together, if its own labels reject at most alpha of the good and refute a loss above pooled_alpha;
the bounds are then alpha for the pool and pooled_alpha for the stratum. A stratum with too few
labels for that gets no cutoff, which keeps its documents.

Null text has no words and fails the base rule. Empty tables give empty results. A document with
several labels counts as good if one says so; a null label or id counts for nothing. A null stratum
is one of its own. Rows that repeat are measured each by itself. Very long texts are measured whole.
The result's own columns take the place of input columns of their names; accepted() returns the
input's columns as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, materialise

#: measure -> candidate cutoffs, from the strictest; a document above the cutoff is rejected.
CUTOFFS = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "long_word_mean": (6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0),
    "short_word_mean": (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0),
}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _covered(at: Column) -> Column:
    """Words covered by windows found twice or more. at: (hash, position) of a document's windows, sorted."""
    before = F.zip_with(at, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), at), lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), p["h"].alias("p")))
    flagged = F.zip_with(before, F.slice(at, F.lit(2), F.size(at)), lambda x, n: F.struct(x["i"].alias("i"), F.coalesce((x["h"] == x["p"]) | (x["h"] == n["h"]), x["h"] == x["p"], x["h"] == n["h"], F.lit(False)).alias("d")))
    places = F.array_sort(F.transform(F.filter(flagged, lambda x: x["i"].isNotNull() & x["d"]), lambda x: x["i"]))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words in place of columns so named."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c != text_col and c not in (*MEASURES, *CUTOFFS)]
    d = docs.select(*keep, text.alias("__text")).withColumn("__words", F.array_remove(F.split("__text", f"{WS}+"), ""))
    d = d.withColumn("__n", F.size("__words"))
    windows = F.when(F.col("__n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("__n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    d = d.select(
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"), windows.alias("__windows"),
    )
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("__at"),
    )
    return d.withColumn("n_repeat_words", F.when(F.size("__at") > 0, _covered(F.col("__at"))).otherwise(0).cast("long")).drop("__at")


def _ratios(d: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return d.withColumns({"symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_ratio": F.col("n_repeat_words") / words, "long_word_mean": mean, "short_word_mean": -mean})


def binomial_tail(rejected: Column, n: Column, p: float) -> Column:
    """P(X <= rejected) of a binomial (n, p), by its terms' logarithms relative to the largest; exact to rounding."""
    step = F.lit(math.log(p) - math.log1p(-p))
    ahead = F.struct((n * F.lit(math.log1p(-p))).alias("t"), (n * F.lit(math.log1p(-p))).alias("m"), F.lit(1.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + step
        m = F.greatest(a["m"], t)
        return F.struct(t.alias("t"), m.alias("m"), (a["s"] * F.exp(a["m"] - m) + F.exp(t - m)).alias("s"))

    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    sums = F.aggregate(terms, ahead, add)
    return F.least(F.lit(1.0), F.exp(sums["m"]) * sums["s"])


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, id_col: str = "doc_id", stratum_col: str = "lang", pooled_alpha: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, n_good, rejected_good, rejected, pooled: the selected cutoff of each stratum and rule that has one."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("good"))
    held = _ratios(measured).join(marks, F.col(id_col) == F.col("__id"))
    held = held.select(F.col(stratum_col).alias("stratum"), "good", *CUTOFFS)
    counts = [F.sum((F.col("good") > 0).cast("long")).alias("n_good")]
    for rule, cuts in CUTOFFS.items():
        for k, c in enumerate(cuts):
            hit = F.col(rule) > c
            counts += [F.sum((hit & (F.col("good") > 0)).cast("long")).alias(f"{rule}_g{k}"), F.sum(hit.cast("long")).alias(f"{rule}_a{k}")]
    table = held.groupBy("stratum").agg(*counts)
    tests = [F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_g{k}").alias("rejected_good"), F.col(f"{rule}_a{k}").alias("rejected")) for rule, cuts in CUTOFFS.items() for k, c in enumerate(cuts)]
    table = table.select("stratum", "n_good", F.explode(F.array(*tests)).alias("t")).select("stratum", "n_good", "t.*")
    strata = table.select(F.count("*")).first()[0] // sum(map(len, CUTOFFS.values()))
    # for each rule a sequence at alpha and one at pooled_alpha in each stratum, and one in the pool
    level = delta / (len(CUTOFFS) * (2 * strata + 1))

    def refuted(rejected: Column, n: Column, p: float) -> Column:
        # where as much as p of the good ones are rejected the test can't succeed
        return F.when(rejected < p * n, binomial_tail(rejected, n, p) <= level).otherwise(F.lit(False))

    pool = Window.partitionBy("rule", "cutoff")
    table = table.withColumns({f"pool_{c}": F.sum(c).over(pool) for c in ("n_good", "rejected_good", "rejected")})
    shared = refuted(F.col("pool_rejected_good"), F.col("pool_n_good"), alpha) & (F.col("rejected_good") <= alpha * F.col("n_good")) & refuted(F.col("rejected_good"), F.col("n_good"), pooled_alpha)
    sound = table.withColumn("own", refuted(F.col("rejected_good"), F.col("n_good"), alpha)).filter(F.col("own") | shared)
    rank = F.struct(F.col("own"), F.when(F.col("own"), F.col("rejected")).otherwise(F.col("pool_rejected")), F.col("cutoff"))
    best = F.max_by(F.struct("cutoff", "n_good", "rejected_good", "rejected", (~F.col("own")).alias("pooled")), rank)
    return sound.groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", "b.*")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _verdicts(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str, stratum_col: str) -> DataFrame:
    """measured with base_failed and kept."""
    cutoffs = select_cutoffs(measured, labels, alpha, delta, id_col, stratum_col)
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    d = _ratios(measured).join(by_stratum, F.col(stratum_col).eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col("__cut")[rule], F.lit(False))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("__stratum", "__cut", *CUTOFFS)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """docs, without its text, with the measures, base_failed and kept in place of columns so named."""
    own = (*MEASURES, *CUTOFFS, "base_failed", "kept")
    rows = docs.select(*[c for c in docs.columns if c not in own or c in (id_col, text_col, stratum_col)])
    return _verdicts(materialise(measures(rows, text_col), "quality"), labels, alpha, delta, id_col, stratum_col)


def accepted(docs: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__row_id"), F.col(stratum_col).alias("__lang"), F.col(text_col).alias("__input"))
    marks = labels.withColumnRenamed(id_col, "__row_id")
    measured = materialise(measures(rows, "__input"), "quality")
    return _verdicts(measured, marks, alpha, delta, "__row_id", "__lang").filter("kept").select("__row.*")
