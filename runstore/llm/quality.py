"""Quality rules with risk-controlled thresholds (operator 7); DataFrame operations only.

Signals of the whole text (larger is worse) are cut at thresholds that labelled holdouts justify.  For each
stratum (language and length band) and each signal, a fixed grid runs from lenient to strict.  A cutoff is
certified if the exact binomial tail P(X <= false rejections | n good rows, rate) is at most
``delta`` / (strata x signals): then the chance that it rejects more than ``rate`` of the good documents is that small
(a Clopper-Pearson bound).  Along a grid testing stops at the first failure (fixed-sequence testing), over
strata and signals the level is divided (Bonferroni), so with probability 1 - delta all cutoffs hold at
once.  Each signal gets an equal share of ``alpha``, so a stratum loses at most alpha of its good documents.
Among the certified cutoffs the one is used that gains most bad rows for the good ones it costs; without
enough labels nothing is certified and nothing more is rejected than by the base rules.

Windows of words are compared by their words; their hashes only tell in which texts any can be equal.

Defined cases: null text has no words (and so fails the base rule); null lang is a stratum of its own;
labels without quality or id count for nothing, of several labels of an id the lowest counts; without labels or on an empty
table only the base rules work; repeated rows are judged each; of cutoffs that gain alike the more lenient is used; a very long text is judged whole, in
one row's memory; extra columns pass through, one named like an output (the base columns, base_failed, kept, in any case) or like a signal is replaced by
``judged``; ``accepted`` returns all columns of docs as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runstore.llm.common import WORD, columns_but, kept, quoted

ALPHA, DELTA = 0.05, 0.05
WINDOW = 8
#: Good rows lost weigh this many times bad rows gained when a certified cutoff is picked.
COST = 5.0
#: Strata up to this many are broadcast; beyond, cutoffs are joined by shuffle.
BROADCAST_STRATA = 10_000
#: Signals and their grids, lenient first.
GRIDS = {
    "marks": [4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeats": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4],
    "echoes": [0.29, 0.25, 0.2, 0.15, 0.1, 0.05],
    "lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_made = [*BASE, "base_failed", "kept", "_w", "_lines", "_h", "_stratum", "_row", *[f"_{g}" for g in GRIDS]]


def signals(docs: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """docs plus the base columns, base_failed, the signals as ``_name`` and the ``_stratum``."""
    own = [quoted(c) for c in columns_but(docs, _made)]
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    one = docs.select(
        *own,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        left(r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        left(r"[\p{L}\p{N}\x20\x09-\x0D]+").cast("double").alias("_marks"),
        left(r"\P{Lu}+").cast("double").alias("_capitals"),
        left(r"\P{L}+").cast("double").alias("_letters"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    two = one.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.when(F.size("_w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Windows that occur twice, found side by side in the order of their words; then each covers the words up to the next one.
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(F.concat_ws(" ", F.slice("_w", i + 1, WINDOW)).alias("h"), i.alias("i"))))
    three = two.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    n = F.size("_o")
    twice = F.filter(F.sequence(F.lit(1), n), lambda i: ((i > 1) & (F.element_at("_o", i)["h"] == F.element_at("_o", F.greatest(i - 1, F.lit(1)))["h"])) | ((i < n) & (F.element_at("_o", i)["h"] == F.element_at("_o", F.least(i + 1, n))["h"])))
    at = F.sort_array(F.transform(twice, lambda i: F.element_at("_o", i)["i"]))
    four = three.withColumn("_p", F.when(F.col("_o").isNotNull(), at))
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")), lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    five = four.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("_marks") / words).alias("_marks"),
        (F.col("_capitals") / F.greatest("_letters", F.lit(1.0))).alias("_capitals"),
        (1 - F.size(F.array_distinct("_w")) / words).alias("_repeats"),
        F.greatest(F.size("_lines"), F.lit(1)).alias("_n_lines"),
    )
    band = F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "medium").otherwise("long")
    stratum = F.concat(F.coalesce(F.concat(F.lit("="), F.col(quoted(lang))), F.lit("")) if lang else F.lit(""), F.lit("/"), band)
    return five.select(
        *own,
        *BASE,
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        "_marks",
        "_capitals",
        "_repeats",
        (F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("_echoes"),
        (F.col("n_dup_lines") / F.col("_n_lines")).alias("_lines"),
        stratum.alias("_stratum"),
        # a column that isn't deterministic: no filter is pushed below, where it would copy the signals' expressions
        F.monotonically_increasing_id().alias("_row"),
    )


def tail(n, k, rate: float):
    """P(X <= k) for X binomial (n, rate), summed exactly in logarithms."""
    odds, stay = math.log(rate / (1 - rate)), math.log1p(-rate)
    start = F.struct((n * F.lit(stay)).alias("term"), (n * F.lit(stay)).alias("sum"))

    def add(acc, j):
        term = acc["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        high, low = F.greatest(term, acc["sum"]), F.least(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    counts = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(counts, start, add, lambda acc: acc["sum"]))


def cutoffs(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, rule, level, cutoff): the cutoff used for each stratum and signal that has a certified one."""
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    rows = found.where("not base_failed").join(label, F.col(quoted(doc_id)) == F.col("_id"))
    rate = alpha / len(GRIDS)
    # the number of the first (most lenient) grid value that a row exceeds: it is rejected there and further on
    first = F.array(*[F.struct(F.lit(g).alias("rule"), (F.lit(len(grid) + 1) - sum((F.col(f"_{g}") > v).cast("int") for v in grid)).alias("level")) for g, grid in GRIDS.items()])
    counts = rows.select("_stratum", (F.col("_q") >= 1).alias("good"), F.explode(first).alias("x")).groupBy("_stratum", "x.rule", "x.level", "good").agg(F.count("*").alias("n"))
    totals = counts.groupBy("_stratum", "rule").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("n_bad"))
    grids = F.array(*[F.struct(F.lit(g).alias("rule"), F.lit(j + 1).alias("to"), F.lit(float(v)).alias("cutoff")) for g, grid in GRIDS.items() for j, v in enumerate(grid)])
    levels = counts.select("_stratum", "rule", "level", "good", "n", F.explode(F.filter(grids, lambda x: (x["rule"] == F.col("rule")) & (x["to"] >= F.col("level")))).alias("g"))
    sums = levels.groupBy("_stratum", "rule", "g.to", "g.cutoff").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("gained"))
    tests = totals.agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    at_all = sums.join(totals, ["_stratum", "rule"]).crossJoin(F.broadcast(tests))  # tests: one row
    passes = F.when(F.col("lost") >= rate * F.col("n_good"), False).otherwise(tail(F.col("n_good").cast("double"), F.col("lost"), rate) <= delta / F.col("tests"))
    judged = at_all.withColumn("passes", passes)
    stop = judged.where("not passes").groupBy("_stratum", "rule").agg(F.min("to").alias("stop"))
    gain = F.col("gained") / F.greatest("n_bad", F.lit(1)) - COST * F.col("lost") / F.greatest("n_good", F.lit(1))
    sound = judged.join(stop, ["_stratum", "rule"], "left").where("stop is null or to < stop").where("gained > 0").withColumn("gain", gain).where("gain > 0")
    return sound.groupBy("_stratum", "rule").agg(F.max_by(F.struct(F.col("to").alias("level"), "cutoff"), F.struct("gain", -F.col("to"))).alias("best")).select("_stratum", "rule", "best.level", "best.cutoff")


def judge(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``found`` plus ``kept``."""
    chosen = kept(chosen, "cutoffs")
    table = chosen.groupBy(F.col("_stratum").alias("_for")).pivot("rule", list(GRIDS)).agg(F.first("cutoff"))
    if chosen.select("_stratum").distinct().limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        table = F.broadcast(table)
    all_ = found.join(table, F.col("_stratum") == F.col("_for"), "left")
    bad = F.col("base_failed")
    for g in GRIDS:
        bad = bad | F.coalesce(F.col(f"_{g}") > F.col(g), F.lit(False))
    return all_.withColumn("kept", ~bad).drop("_for", *GRIDS)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs without the text, plus base columns, base_failed and kept."""
    cols = [c for c in columns_but(docs, [*_made, *GRIDS])]
    found = kept(signals(docs.select(*[quoted(c) for c in cols]), text, lang).drop(text), "signals")
    out = judge(found, cutoffs(found, labels, doc_id, alpha, delta))
    return out.select(*[quoted(c) for c in cols if c.lower() != text.lower()], *BASE, "base_failed", "kept")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs that pass; each row is written once with its signals, so nothing is computed twice or joined by id."""
    few = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"), *([F.col(quoted(lang)).alias("lang")] if lang else []))
    found = kept(signals(few, "text", "lang" if lang else None).drop("text"), "signals")
    chosen = cutoffs(found.drop("_doc"), labels, "doc_id", alpha, delta)
    return judge(found, chosen).where("kept").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
